"""Answers of providers, kept so that each distinct text is asked once.

A store is a folder of Parquet tables, one for each provider's name: the text's hash, the answer, and the error where there was none. Rows meet the
store by the hash before anything is asked; only texts without an answer go to the provider, each once, however many rows have it. What was asked is written before
it is used, so neither the branches of a plan nor a later run ask again; a text whose call failed is asked again in the next run.

Inside a task several calls are in flight at one time. A call holds up to ``batch`` texts; one that fails is tried again text by text, each ``retries`` times
more, and the last error is kept. Before each further try there is one wait for all texts of a batch of rows that failed, not one for each text. A lost executor's tasks run again, and may repeat the calls that it had not written.

A null text is an empty one. Answers for one text are the same for all its rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.cut import discarded, kept, scratch

BATCH, IN_FLIGHT, RETRIES = 16, 4, 2


def asked_texts(texts: list[str], provider: Callable[[list[str]], list], batch: int, in_flight: int, retries: int, wait: float) -> list[tuple]:
    """(answer, error) of each text, by calls in threads; what failed is tried again in rounds, with one wait for all of it."""

    def many(some: list[str]) -> list[tuple] | None:
        if len(some) > 1:
            try:
                answers = list(provider(some))
                if len(answers) == len(some):
                    return [(a, None) for a in answers]
            except Exception:  # noqa: BLE001  tried again text by text
                pass
        return None

    def one(text: str) -> tuple:
        try:
            return provider([text])[0], None
        except Exception as e:  # noqa: BLE001  a provider may fail in any way; the row says how
            return None, f"{type(e).__name__}: {e}"

    found: list[tuple] = []
    with ThreadPoolExecutor(in_flight) as pool:
        calls = [texts[a : a + batch] for a in range(0, len(texts), batch)]
        for some, part in zip(calls, pool.map(many, calls), strict=True):
            found += part or [(None, "")] * len(some)
        left = [i for i, (_, error) in enumerate(found) if error is not None]
        for attempt in range(retries + 1):
            if attempt and left:
                time.sleep(wait * 2 ** (attempt - 1))
            for i, told in zip(left, pool.map(one, [texts[i] for i in left]), strict=True):
                found[i] = told
            left = [i for i in left if found[i][1] is not None]
    return found


@dataclass(frozen=True)
class AnswerStore:
    spark: SparkSession
    path: str

    def _table(self, name: str, kind: str) -> DataFrame:
        schema = f"hash string, value {kind}, error string"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def answered(self, rows: DataFrame, key: list[str], text: str, name: str, provider: Callable[[list[str]], list], kind: str = "string", batch: int = BATCH, in_flight: int = IN_FLIGHT, retries: int = RETRIES, wait: float = 0.1, tasks: int | None = None) -> DataFrame:
        """``key``, value, error: a row for each of ``rows``. ``tasks`` bounds how many tasks call the provider at one time; else there is one a core, however small the texts are."""
        filled = F.coalesce(text, F.lit(""))
        hashed = rows.select(*key, F.sha2(filled, 256).alias("hash"))
        known = self._table(name, kind).where("error IS NULL").dropDuplicates(["hash"])
        missing = rows.select(filled.alias("text")).distinct().withColumn("hash", F.sha2("text", 256)).join(known.select("hash"), "hash", "left_anti")
        missing = missing.repartition(tasks or self.spark.sparkContext.defaultParallelism)  # calls wait: their number counts, not their bytes

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = asked_texts(part["text"].tolist(), provider, batch, in_flight, retries, wait)
                yield pd.DataFrame({"hash": part["hash"].to_numpy(), "value": pd.Series([a for a, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

        fresh = kept(missing.mapInPandas(run, f"hash string, value {kind}, error string"))
        fresh.write.mode("append").parquet(f"{self.path}/{name}")
        found = hashed.join(known.unionByName(fresh), "hash").select(*key, "value", "error")
        out = kept(found)
        discarded(fresh)
        return out


def store(spark: SparkSession, path: str | None = None) -> AnswerStore:
    """The store under ``path``, or a fresh one in the shared folder."""
    return AnswerStore(spark, path or scratch(spark))
