"""Bounded samples of labelled texts, models as one binary row, and scoring of whole tables with them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_piece, id_text, pieces, raw

#: Labelled rows that a model is fitted on at most: those of lowest hash of their key, so a fixed choice.
SAMPLE_ROWS = 20_000
#: Runs of letters, digits and bytes above ASCII, and runs of other characters that are not white space.
TERM = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled documents as (label, text).

    Labels other than 0 and 1 are left out, and so are keys with contradicting labels. The chosen keys are at
    most ``rows`` rows of two numbers and so may be broadcast; the texts are not shuffled.
    """
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
             .groupBy(F.col("doc_id").cast("long").alias("key"))
             .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most"))
             .where("label = most").drop("most"))
    chosen = marks.orderBy(F.xxhash64("key"), "key").limit(rows)
    return (id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("key"))
            .select("label", "text"))


def fitted(sample: DataFrame, features: Callable[[bytes], np.ndarray],
           fit: Callable[[list[np.ndarray], np.ndarray], bytes]) -> bytes:
    """Turn texts to features where they lie, bring the bounded sample's features to one task, fit there."""

    def extract(batches: Iterator[pa.RecordBatch]):
        for piece in pieces(batches):
            found = [features(x).astype(np.int32).tobytes() for x in raw(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("label"), pa.array(found, pa.binary())],
                                             names=["label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]):
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[1], r[0]))  # any order of arrival gives the same model
        order = np.random.default_rng(7).permutation(len(rows))
        found = [np.frombuffer(rows[i][1], np.int32) for i in order]
        model = fit(found, np.array([rows[i][0] for i in order], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    rows = (sample.mapInArrow(extract, "label int, features binary").repartition(1)
            .mapInArrow(learn, "model binary").collect())
    return rows[0].model if rows else fit([], np.empty(0))


def scored(docs: DataFrame, model: bytes, make: Callable[[bytes], Callable[[bytes], float]]) -> DataFrame:
    """(doc_id, score) of every row. The model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = make(shared.value)

        def work(piece: pa.RecordBatch) -> dict:
            return {"doc_id": piece.column("doc_id"),
                    "score": np.fromiter(map(score, raw(piece.column("text"))), np.float64, piece.num_rows)}

        return work

    return by_piece(id_text(docs), start, "doc_id long, score double")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
