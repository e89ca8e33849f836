"""A corpus made ready for training: toxic texts, near copies and leaked test items go, secrets are masked,
what is left is turned to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage is written as Parquet and read again as the next one's input. Rows with a null text
are kept by the filters (nothing speaks against them) and have no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import toxicity
from barloom.llm.byte_bpe import encode_decode
from barloom.llm.common import crc_mod, table
from barloom.llm.contamination import drop_contaminated
from barloom.llm.near_dup import keep_one
from barloom.llm.secrets import mask_secrets
from barloom.session import scratch_path

#: Probability from which a text counts as toxic.
TOXIC = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is trained on the labelled rows that are not held out."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.drop_toxic(docs, model, TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8, smallest doc_id."""
    return keep_one(docs, width=5, percent=80)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: fewer than 0.8 of the five-word shingles of each."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=5, percent=80)


def with_secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets and strings of high entropy replaced."""
    return mask_secrets(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    done = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_test_items),
    ("secrets", with_secrets_masked),
    ("tokens", as_tokens),
]

#: A trained classifier and a byte-pair encoder are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; every result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
