"""What the classifiers share: held-out rows, bounded labelled samples, logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import slices


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text (a null: empty text) leaves ``remainder``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, total_bytes: int, key: str = "doc_id", text: str = "text") -> tuple[pd.DataFrame, float]:
    """Texts of at most ``per_class`` rows of each label, by a hash of the key, and the share of 1 among all usable labels.

    Rows are taken in the order of the hash; one that would bring the texts over ``total_bytes`` is passed over, and the next is tried. A key
    labelled more than once has its greatest label, and a key with several texts the one with the least hash.
    """
    usable_labels = labels.where(usable & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    share = usable_labels.agg(F.avg("y")).first()[0]
    chosen = [usable_labels.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(per_class) for y in (0, 1)]
    # 2 * per_class rows at most
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen[0].union(chosen[1]).withColumnRenamed(key, "key")), "key")
    rows = rows.withColumns({"mark": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})
    sizes = rows.groupBy("key").agg(F.min(F.struct("mark", "size")).alias("one")).select("key", "one.*").orderBy(F.xxhash64("key"), "key")
    taken, total = [], 0
    for key_, mark, size in sizes.collect():  # keys, hashes and sizes of those rows
        if total + size <= total_bytes:
            taken.append((key_, mark))
            total += size
    schema = T.StructType([rows.schema["key"], T.StructField("mark", T.LongType())])
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, schema)), ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"])
    sample = rows.select("key", "text", "y").toPandas()
    return sample.sort_values(["key", "text"], ignore_index=True), float(share if share is not None else 0.5)


class Logistic:
    """Logistic regression by Newton steps with a small ridge; ``share`` resets the prior of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            penalty = np.r_[0, np.full(len(w) - 1, ridge)]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        share = np.clip(share, 1e-3, 1 - 1e-3)
        w[0] += np.log(share / (1 - share)) - np.log(ones / (1 - ones))
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of each row, for a fitted model with ``score(list of raw texts)``."""
    return _scored(docs.select(key, text), model, text, [key])


def with_score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """All columns and ``score``; a column of that name gives way."""
    docs = docs.drop("score")
    return _scored(docs, model, text, docs.columns)


def _scored(docs: DataFrame, model, text: str, kept: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw = [x or b"" for x in pc.cast(batch.column(text), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(held.value.score(raw), pa.float64())], [*kept, "score"])

    return docs.mapInArrow(run, docs.select(kept).schema.add("score", "double"))
