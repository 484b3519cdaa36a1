"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes inside a task, so that
#: word lists and work arrays stay small whatever the Arrow batch size is.
SLICE_BYTES = 2 << 20
#: About so many bytes of rows go to a Python worker at once. Executors and workers hold a few such batches, so memory doesn't follow the size of texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have about ``BATCH_BYTES``, unless the session says how many."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a temporary folder takes its
    place in local mode, as in tests; on a cluster each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillgraph/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, partition_by: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joinable(*columns: str) -> list[Column]:
    """Expressions that are equal where the columns are, nulls too, and never null: windows and joins on them share one shuffle."""
    return [e for c in columns for e in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())]


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns renamed that are called like what an operator uses, and what gives them their names back."""
    used, taken = {n.lower() for n in names}, {c.lower() for c in df.columns}
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in used:
            new = f"{c}_own"
            while new.lower() in taken | used:
                new += "_"
            moved[c] = new
            taken.add(new.lower())
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({new: c for c, new in moved.items()})


_kept: dict[str, object] = {}


def kept_in_worker(name: str, build: Callable[[], object]) -> object:
    """A thing that a Python worker keeps between tasks; it gives way to the next operator's."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    return _kept[name]


def give_back() -> None:
    """Return memory that allocators hold after a task: workers live on, beside those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
