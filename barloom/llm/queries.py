"""One query per operator, over the whole of its table, in the form its contract states."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from barloom.llm import oracles, quality, suffixes, toxicity
from barloom.llm import secrets as secret_scan
from barloom.llm.byte_bpe import encode_decode
from barloom.llm.catalog import registered
from barloom.llm.common import crc_mod, table
from barloom.llm.contamination import contained_items
from barloom.llm.divergence import source_divergence
from barloom.llm.hnsw import nearest_neighbours
from barloom.llm.near_dup import near_duplicates
from barloom.llm.sharding import lookup_table, place
from barloom.llm.simhash import simhash_duplicates
from barloom.llm.substrings import remove_repeats
from barloom.llm.whitening import whitened

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _sharding_sql() -> str:
    return (
        "SELECT doc_id, slot, 'shard-' || lpad(CAST(owners[slot + 1] AS VARCHAR), 3, '0') AS shard FROM ("
        "SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 65537"
        " AS INTEGER) AS slot FROM documents), "
        f"(SELECT {lookup_table(SHARDS)} AS owners)"
    )


@registered(sql=oracles.REPEATED_BYTES)
def op1_suffix_dedup(spark, sf_dir):
    """Documents without byte strings of 400 that start anywhere else."""
    return _digested(suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400))


@registered(sql=oracles.SUBSTRINGS)
def op2_substring_dedup(spark, sf_dir):
    """Documents without passages of 20 words that start earlier."""
    return _digested(remove_repeats(table(spark, sf_dir, "documents"), width=20))


def _digested(rows):
    return rows.withColumn("kept_sha256", F.sha2(F.col("kept"), 256)).drop("kept")


@registered(sql=_sharding_sql())
def op3_sharding(spark, sf_dir):
    """Documents over 64 shards by their doc_id."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@registered()
def op4_secrets(spark, sf_dir):
    """Known kinds of secrets and strings of high entropy in every document."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = [secret_scan.of_kind(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


@registered()
def op5_quality(spark, sf_dir):
    """Every document's quality; rows with remainder 1 are kept out of training."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return _predicted(quality.score(docs, model), crc_mod("doc_id", 3) == 1, 0.5)


@registered(sql=oracles.CONTAINED)
def op6_decontamination(spark, sf_dir):
    """Benchmark items of which four fifths of the five-word shingles are in a document."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered(sql=oracles.NEAR)
def op7_near_dup(spark, sf_dir):
    """Groups of near copies, by four-word shingles, linked from a similarity of 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@registered()
def op8_byte_bpe(spark, sf_dir):
    """Every document as token ids, and decoded again."""
    docs = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN)
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@registered()
def op9_hnsw(spark, sf_dir):
    """The five nearest other vectors of every fiftieth one."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=50, k=5)


@registered()
def op10_toxicity(spark, sf_dir):
    """Every document's toxicity; rows with remainder 2 are kept out of training."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return _predicted(toxicity.score(docs, model), crc_mod("doc_id", 4) == 2, 0.3)


@registered()
def op11_simhash(spark, sf_dir):
    """Groups of documents whose fingerprints of three-word shingles differ in two bits or fewer."""
    found = simhash_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@registered(sql=oracles.DIVERGENCE)
def op12_divergence(spark, sf_dir):
    """How far the sources of each language differ, and the terms that each has more than its language."""
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=10, best=10)


@registered()
def op13_whitening(spark, sf_dir):
    """Every embedding along the first four components of all distinct ones."""
    return whitened(table(spark, sf_dir, "embeddings"), most=4)


def _predicted(scores, held_out, threshold):
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
