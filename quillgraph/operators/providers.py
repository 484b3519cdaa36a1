"""Injected language and embedding models: called in batches inside tasks, with errors kept by row.

A provider is a picklable function from a list of texts to a list of answers (strings or vectors).
``hashed_vectors`` is a deterministic stand-in for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.answer_store import AnswerStore
from quillgraph.operators.cut import discarded, kept

BATCH = 64


def hashed_vectors(texts: list[str], size: int = 16) -> list[list[float]]:
    out = []
    for x in texts:
        raw = hashlib.sha256(x.encode()).digest()
        out.append([(raw[i % 32] - 127.5) / 127.5 for i in range(size)])
    return out


def called(rows: DataFrame, key: str, text: str, provider: Callable[[list[str]], list], kind: str = "string", batch: int = BATCH, spread: bool = False) -> DataFrame:
    """key, value, error: the provider's answer for each row; a batch that fails is tried row by row.

    ``spread`` deals the rows out to every core first: short texts lie in few tasks, by their bytes, and calls take time by their number.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                texts = some[text].fillna("").tolist()
                values, errors = [None] * len(texts), [None] * len(texts)
                try:
                    values = list(provider(texts))
                except Exception:  # noqa: BLE001  a provider may fail in any way; the row says how
                    for i, x in enumerate(texts):
                        try:
                            values[i] = provider([x])[0]
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({key: some[key].tolist(), "value": values, "error": errors})

    kind_of_key = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, text)
    if spread:
        spark = rows.sparkSession
        rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.mapInPandas(run, f"{key} {kind_of_key}, value {kind}, error string")


def with_embeddings(nodes: DataFrame, provider: Callable[[list[str]], list], key: str = "element_id", text: str = "embedding_text", held: AnswerStore | None = None) -> DataFrame:
    """Nodes whose embedding is missing get one, from each distinct text once; others keep theirs.

    With ``held``, texts that it knows aren't embedded again, in later runs neither; a text that fails leaves its nodes without.
    """
    missing = nodes.where("embedding IS NULL")
    texts = missing.select(text).where(F.col(text).isNotNull()).distinct().withColumn("id", F.col(text))
    made = called(texts, "id", text, provider, "array<float>") if held is None else held.answered(texts, ["id"], text, "embeddings", provider, "array<float>")
    made = made.select(F.col("id").alias(text), F.col("value").alias("new"))
    return nodes.join(made, text, "left").withColumn("embedding", F.coalesce("embedding", "new")).drop("new").select(nodes.columns)


def write_embeddings(nodes: DataFrame, path: str, key: str = "element_id") -> int:
    """Add the nodes that have an embedding and aren't there with one to the table under ``path``, a folder for each label; how many were added."""
    spark = nodes.sparkSession
    rows = nodes.where("embedding IS NOT NULL").select(key, "label", "embedding").dropDuplicates([key, "label"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.schema(rows.schema).parquet(path).select(key, "label")
        rows = rows.join(there, [key, "label"], "left_anti")
    rows = kept(rows)
    rows.write.mode("append").partitionBy("label").parquet(path)
    n = rows.count()
    discarded(rows)
    return n
