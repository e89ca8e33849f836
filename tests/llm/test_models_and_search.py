"""Classifiers on held-out rows, benchmark items and nearest neighbours against brute force, the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import barloom.llm.queries  # noqa: F401
import corpus_pipeline
from barloom.llm import contamination, quality, toxicity
from barloom.llm.catalog import LLM_QUERIES
from barloom.llm.common import crc_mod, text_shingles
from barloom.llm.contamination import contained_items, drop_contaminated, word_shingles
from barloom.llm.hnsw import nearest_neighbours

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_on_odd_tables(spark, module):
    label = "quality" if module is quality else "toxic"
    docs = spark.createDataFrame([(1, "a", 5), (None, "b", 5), (3, None, 5), (1, "a", 5), (5, "", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], f"doc_id long, {label} int")
    got = module.score(docs, module.train(docs, labels, F.lit(True))).collect()  # no usable label at all
    assert Counter(r.doc_id for r in got) == Counter([1, 1, None, 3, 5]) and {r.score for r in got} == {0.5}
    assert module.score(docs.limit(0), module.train(docs, labels, F.lit(True))).collect() == []


@pytest.mark.parametrize("name,module,label,parts,out", [
    ("op5_quality", quality, "quality", 3, 1), ("op10_toxicity", toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, name, module, label, parts, out):
    got = LLM_QUERIES[name](spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    score, y = rows.score.to_numpy(), rows[label].to_numpy()
    ranks = score.argsort().argsort()
    ones = int(y.sum())
    auc = (ranks[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))
    assert auc > 0.93 and (rows.predicted == y).mean() > 0.93
    assert got.where((F.col("held_out")) != (crc_mod("doc_id", parts) == out)).isEmpty()


def test_pairs_of_terms_count():
    """Toxic only if both an insult and a group are named: no sum of single weights says that."""
    pick = random.Random(8)
    features, texts, labels = toxicity._Lazy(), [], []
    for i in range(1200):
        words = [f"w{pick.randrange(400)}" for _ in range(30)]
        if i % 3 != 1:
            words.append("insulting")
        if i % 3 != 2:
            words.append("groupname")
        pick.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(i % 3 == 0))
    score = toxicity.make_score(toxicity.fit([features(t) for t in texts[:900]], np.array(labels[:900])))
    right = [(score(t) >= 0.5) == bool(y) for t, y in zip(texts[900:], labels[900:], strict=True)]
    assert np.mean(right) > 0.97


def test_items_in_documents(spark):
    pick = random.Random(12)
    word = lambda: "".join(pick.choice("abcdefghijkl") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 6, 9, 15, 22, 40, 59, 120])]
    docs = []
    for i, text in items * 3:
        words = text.split()
        keep = words if pick.random() < 0.5 else words[:max(3, int(len(words) * pick.choice([0.6, 0.9, 0.95])))]
        at = pick.choice([0, 7, 400, 9000])
        docs.append((len(docs), " ".join([word() for _ in range(at)] + [w.upper() for w in keep] + [word() for _ in range(at)]), 1))
    docs += [(None, items[4][1], 1), (98, None, 1), (99, "", 1), (0, docs[0][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (20, None), (21, ""), (None, "x y z"), (4, items[4][1])], "item_id long, text string")
    want = Counter()
    for d, text, _ in docs:
        words = (text or "").lower().encode().split()
        for i, item in [*items, items[4]]:
            wanted = word_shingles(item.encode().split(), 5)
            n = len(next(iter(wanted)))
            both = len(wanted & (word_shingles(words, n) if len(words) >= n else frozenset()))
            if 100 * both >= 80 * len(wanted):
                want[d, i, both, len(wanted)] += 1
    assert Counter(map(tuple, contained_items(df, bench).collect())) == want
    # a benchmark beyond the bound is searched in parts, to the same end; parts without an item do no harm
    assert Counter(map(tuple, contained_items(df, bench, part_bytes=700).collect())) == want
    left = drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {w[0] for w in want}
    # a row of the same id with a clean text stays, rows without an id are judged too
    dirty = next(d for d in docs if d[0] in {w[0] for w in want} and d[0] is not None)
    mixed = spark.createDataFrame([dirty, (dirty[0], "nothing of the kind", 2), (None, dirty[1], 3), (None, "clean", 4), (None, None, 5)],
                                  "doc_id long, text string, item_id int")
    assert sorted(r.item_id for r in drop_contaminated(mixed, bench).collect()) == [2, 4, 5]
    assert contained_items(df.limit(0), bench).collect() == [] and contained_items(df, bench.limit(0)).collect() == []


@pytest.mark.parametrize("chunk,short", [(1 << 15, 128), (64, 8), (1 << 15, 1), (8, 128)])
def test_texts_are_cut_into_shingles_once(monkeypatch, chunk, short):
    """One pass for all sizes of items, and the same items found in pieces of any size and in either layout."""
    made = []
    monkeypatch.setattr(contamination, "text_shingles", lambda text, width: made.append(width) or text_shingles(text, width))
    monkeypatch.setattr(contamination, "CHUNK", chunk)
    monkeypatch.setattr(contamination, "SHORT", short)
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 15, 22, 40, 59, 120, 700])]
    index = contamination.Index(items, 5, 80)
    texts, want = [], []
    for i, text in items * 2:
        words = text.split()
        for n in (len(words), len(words) - len(words) // 12, len(words) // 2):
            before, after = ([word() for _ in range(pick.choice([0, 3, 200]))] for _ in range(2))
            texts.append(" ".join([*before, *words[:n], *after]).encode())
            wanted = word_shingles(text.encode().split(), 5)
            size = len(next(iter(wanted)))
            both = len(wanted & word_shingles(texts[-1].split(), size)) if n + len(before) + len(after) >= size else 0
            want += [(len(texts) - 1, i)] if 100 * both >= 80 * len(wanted) else []
    made.clear()
    found = {(at, index.sets[k][0]) for at, k in index.search([*texts, b"", b"x"])}
    assert set(want) <= found and len(want) > 30
    assert len(made) == (len(texts) + 2) * 3  # widths 5, 1 and 3


def brute(rows, every, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    out = []
    for q, u in good.items():
        if q % every == 0:
            found = sorted((-(v @ u) / np.sqrt((v @ v) * (u @ u)), i) for i, v in good.items() if i != q and len(v) == len(u))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_neighbours_of_odd_vectors(spark):
    pick = np.random.default_rng(2)
    rows = [(i, pick.normal(size=6).tolist(), 1) for i in range(300)]
    rows += [(i, rows[7][1], 1) for i in range(300, 340)]  # one common vector
    rows += [(340, None, 1), (341, [0.0] * 6, 1), (342, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (343, [float("nan")] * 6, 1),
             (None, [1.0] * 6, 1), (350, [float("inf")] + [1.0] * 5, 1), (400, [1.0, 2.0], 1), (401, [2.0, 1.0], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, nearest_neighbours(df, every=50, k=5).collect()))
    want = brute(rows, 50, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert nearest_neighbours(df.limit(0)).collect() == []


def test_recall(spark):
    got = LLM_QUERIES["op9_hnsw"](spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = asked = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        hit += len(best & set(got[got.query_id == ids[q]].vec_id))
        asked += 5
    assert len(got) == asked and hit / asked >= 0.95


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.withColumn("score", F.lit(1)).unionByName(
        spark.createDataFrame([(None, None, None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf_dir)
        assert out.columns == extra.columns, name
        assert out.where("doc_id IS NULL").count() == 1, name
        assert stage(spark, extra.limit(0), sf_dir).collect() == [], name


def test_pipeline_equals_its_parts(spark, sf_dir):
    """Each filter by brute force or by the operator's own checked result, in the order of the stages."""
    from test_duplicates import groups

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    first = {i: c for i, _, c in groups(rows, 5, 80)}
    rows = [r for r in rows if first[r[0]] == r[0]]
    items = [word_shingles(r.text.encode().lower().split(), 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = lambda t: any(100 * len(s & word_shingles((t or "").encode().lower().split(), 5)) >= 80 * len(s) for s in items)
    want = {i for i, t in rows if not leaks(t)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < docs.count()
