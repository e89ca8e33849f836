"""Byte-level BPE against the tiktoken library, shards against a plain filling of the table."""

from __future__ import annotations

import base64
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from barloom.llm import byte_bpe
from barloom.llm.byte_bpe import Codec, RankQueue, encode_decode, merge, parse_ranks
from barloom.llm.common import pieces
from barloom.llm.sharding import lookup_table, place

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(data):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    pick = random.Random(3)
    parts = ["a", "b", "  ", " ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "!", "..", "\x00", "\x1c", "　",
             "日本", "🎉", "aaaa", "\r\n", "the", "tion", "\x85", "<|endoftext|>"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(1500)]
    return [*texts, "a" * 30_000, "ab" * 20_000, " " * 3000, "", " ", " a", "a "]


def test_codec_equals_library(data, library):
    texts = odd_texts()
    together, single = Codec(data, public_tokenizers.PATTERN), Codec(data, public_tokenizers.PATTERN)
    for text, ids in zip(texts, together.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert together.decode(ids) == text.encode()
    for text in texts[:200]:
        assert np.frombuffer(single.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_many_pre_tokens_equal_one_by_one(data):
    ranks = parse_ranks(data)
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdeghinorst") for _ in range(pick.randint(1, 40))).encode() for _ in range(4000)]
    got = Codec(data, public_tokenizers.PATTERN).merger.run(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [merge(w, ranks) for w in words]


def test_merge_that_brings_up_a_lower_rank():
    """A vocabulary in which a merge makes a pair of lower rank than its own: the lowest must go first."""
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"ab", b"abcab", b"ca"]
    ranks = {t: i for i, t in enumerate(tokens)}
    codec = Codec(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()), r"[a-z]+")
    library = tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcabc", "ababcab", "cabab", "abab", "abcababc"]
    raw = [w.encode() for w in words]
    for one, many, word in zip([merge(w, ranks) for w in raw], codec.merger.run(raw), words, strict=True):
        assert one == np.frombuffer(many, "<u4").tolist() == library.encode_ordinary(word)


def test_queue_order():
    queue, pick, waiting = RankQueue(), random.Random(1), []
    for _ in range(3000):
        if waiting and pick.random() < 0.4:
            assert queue.pop() == min(waiting)
            waiting.remove(min(waiting))
        else:
            pair = (pick.randrange(60_000), pick.randrange(1000))
            queue.push(*pair)
            waiting.append(pair)


def test_rows_of_all_kinds(spark, library):
    rows = [(1, "the the", 7), (None, "x", 7), (3, None, 7), (4, "", 7), (1, "the the", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in got) == Counter(
        (i, len(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert encode_decode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_a_worker_remembers_nothing_after_its_task(spark, monkeypatch):
    """The codec stays in the worker for later tasks; ids of chunks and pre-tokens, which take far more memory, do not."""
    monkeypatch.setattr(byte_bpe, "by_piece", lambda docs, make, schema, **how: make)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    make = encode_decode(docs, PATH, public_tokenizers.PATTERN)
    piece = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words of a text", "some zzyzx"]})
    work = make()
    assert work(piece)["n_tokens"] == work(piece)["n_tokens"]
    assert [len(c.chunks) + len(c.known) for c in byte_bpe._codecs.values()] == [0]
    assert make()(piece)["ids"] == work(piece)["ids"]


def test_chunks_of_many_texts_are_not_held_at_once(data):
    texts = [" the word" * 100] * 2000
    codec = Codec(data, public_tokenizers.PATTERN)
    tracemalloc.start()
    try:
        ids = codec.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * sum(map(len, ids)) < 3 * 2000 * 801  # 400,000 chunks as strings would be 20 MB


def test_texts_are_encoded_in_pieces_of_two_megabytes(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(byte_bpe, "by_piece", lambda docs, make, schema, **how: seen.update(how))
    encode_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, public_tokenizers.PATTERN)
    batch = pa.RecordBatch.from_pydict({"text": ["x" * (1 << 19)] * 9 + ["y" * (5 << 20), None, ""]})
    assert [p.num_rows for p in pieces(iter([batch]), **seen)] == [4, 4, 1, 1, 2]


def test_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    owner = lookup_table(names, 1009)
    sizes = Counter(owner)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009  # what did not belong to the shard that went stays mostly where it was
    weighted = Counter(lookup_table(names, 1009, [3, 1, 1, 1, 1, 1, 0]))
    assert weighted[6] == 0 and 2.8 < weighted[0] / weighted[1] < 3.2
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        lookup_table(["a"], 1000)


def test_placement(spark):
    rows = [(i % 50 if i % 10 else None, "old", i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, shard string, x int")
    got = place(df, "id", ["a", "b", "c"], 1009).collect()
    assert len(got) == 500 and [r.x for r in got] == list(range(500))
    assert all(len({r.shard for r in got if r.id == k}) == 1 for k in {r.id for r in got})
    assert place(df.limit(0), "id", ["a"], 1009).collect() == []
