"""Bounded training samples, and the batching that text classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, trimmed

#: Texts are scored in groups of about so many characters, which bounds a worker's memory.
GROUP_CHARS = 2_000_000


def training_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels: at most ``per_class`` labelled rows of either class that are not held out.

    They are those of least xxhash64(doc_id) among the labelled rows that have a text of at most ``max_chars``
    characters in ``docs``, so reruns agree. Longer texts are left out of the fit (never of the scoring), and so are
    rows whose label is null or neither 0 nor 1. However often labels or documents repeat an id, it counts once: with
    its least text, and class 1 over class 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    there = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = there.where("y = 0").orderBy(*order).limit(per_class).unionByName(there.where("y = 1").orderBy(*order).limit(per_class))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas()
    rows = rows.sort_values("doc_id")
    return rows["text"].tolist(), rows["y"].to_numpy(dtype=np.int64)


def in_groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= most:
            yield group
            group, chars = [], 0
    if group:
        yield group


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted; ``score`` turns a list of texts into an array of scores."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).to_pylist()
            s = np.concatenate([score(g) for g in in_groups(texts)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, type=pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(trimmed(batches), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
