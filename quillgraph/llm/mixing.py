"""Mixing sources to target weights.

Each source's texts, in key order, are one stream of words, cut into blocks of a fixed
number of words. A source's target is turned into a number of slots, one block each. Slots
are dealt to output shards by multinomial draws without replacement, so that every source
meets its total. Slot ``j`` of a source takes block ``p(j mod n)``, where ``p`` is the
source's own pseudorandom permutation of its ``n`` blocks: every block is taken once
before any is taken twice, and none more than ``cap`` times. Blocks and texts meet by index.

The driver holds one row per source, and one number per source and output shard
(``MOST_SHARDS`` at most). Streams are numbered by range partitions, so a source of any
size spreads over many tasks.

Null and empty texts have size 0 and nothing is taken from them. A null source is a source
of its own, the last. Repeated rows are separate texts. Without words, all targets are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import joinable, saved, set_aside, slices, table

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
MOST_SHARDS = 1024
#: Slots that one row stands for before they are spread over tasks.
SLOT_RUN = 1 << 13
WORDS = r"[^\x20\x09-\x0D]+"


def target_sizes(sizes: dict, weights: tuple = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> dict:
    """Words to take from each source: shares of ``ratio`` times all words, by weight, up to ``cap`` times its size.

    Sources in code point order, null last, have the weights in turn; what is beyond a cap is shared anew.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict = {}
    rest, open_ = ratio * sum(sizes.values()), order
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        rest -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def shard_counts(slots: np.ndarray, seed: int) -> list[np.ndarray]:
    """Slots of each source in each output shard: multinomial draws by what is left of each source."""
    rng = np.random.default_rng(seed)
    left = slots.copy()
    total = int(left.sum())
    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_SLOTS)))
    out = []
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        drawn = np.zeros_like(left)
        while want:
            more = np.minimum(rng.multinomial(want, left / left.sum()), left)
            drawn, left, want = drawn + more, left - more, want - int(more.sum())
        out.append(drawn)
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(x) for x in np.random.default_rng(key).integers(1, 1 << 62, 4)]

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = walk(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = walk(out[outside])
    return out.astype(np.int64)


def numbered(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Per row: key, source, text_hash, size, row (unique, in stream order) and offset in its source's stream."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, source, F.xxhash64(text).alias("text_hash"), size.alias("size"))
    rows = saved(rows, "sizes")
    rows = rows.repartitionByRange(parts, source, key, "text_hash").sortWithinPartitions(source, key, "text_hash")
    rows = saved(rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "stream")
    sums = rows.groupBy(source, "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy(source).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(source).alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy(source, "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # a row per source and range partition
    rows = rows.join(F.broadcast(sums), rows[source].eqNullSafe(sums["s"]) & (rows["part"] == sums["p"]))
    return saved(rows.select(key, source, "text_hash", "size", "row", (F.col("base") + F.col("inner")).alias("offset")), "numbered")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), ratio: float = 1.5, cap: int = 2, block: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, slots, pieces).

    texts: key, source, text_hash, size, row, source_size, target. slots: source_no, block,
    shard, one row for each block an output shard takes. pieces: row, first and last
    (words of the text, last excluded), times: what the mix takes of each text.
    """
    spark = docs.sparkSession
    rows = numbered(docs, key, text, source)
    sizes = {r[0]: int(r[1]) for r in rows.groupBy(source).agg(F.sum("size")).collect()}  # a row per source
    target = target_sizes(sizes, weights, ratio, cap)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = np.asarray([-(-sizes[s] // block) for s in order], np.int64)
    slots = np.asarray([min(cap * n, round(target[s] * n / sizes[s])) if n else 0 for s, n in zip(order, blocks.tolist(), strict=True)], np.int64)
    keys = [zlib.crc32(f"{seed}:{s}".encode()) for s in order]
    facts = spark.createDataFrame([(s, i, sizes[s], target[s]) for i, s in enumerate(order)], "name string, source_no int, source_size long, target double")
    rows = rows.join(F.broadcast(facts), rows[source].eqNullSafe(facts["name"])).drop("name")  # a row per source

    runs, first = [], np.zeros(len(order), np.int64)
    for shard, counts in enumerate(shard_counts(slots, seed) if len(order) else []):
        for i in np.flatnonzero(counts):
            runs.append((shard, int(i), int(first[i]), int(first[i] + counts[i])))
        first += counts

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = int(blocks[r["source_no"]])
                at = permuted(np.arange(r["begin"], r["end"]) % n, n, keys[r["source_no"]])
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, r["source_no"], np.int32)), pa.array(at), pa.array(np.full(m, r["shard"], np.int32))], ["source_no", "block", "shard"])

    plan = spark.createDataFrame(runs, "shard int, source_no int, first long, stop long")
    plan = plan.where("first < stop").withColumn("begin", F.explode(F.expr(f"sequence(first, stop - 1, {SLOT_RUN})")))
    plan = plan.select("shard", "source_no", "begin", F.least("stop", F.col("begin") + SLOT_RUN).alias("end"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = plan.repartition(parts, "source_no", "begin").mapInArrow(take, "source_no int, block long, shard int")
    # Spark takes what grows from a small plan for small; the hints keep it from broadcasting it.
    times = taken.groupBy("source_no", "block").agg(F.count("*").alias("times"))

    end = F.col("offset") + F.col("size")
    at = rows.where("size > 0").select("row", "source_no", "offset", "size", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("block"))
    first_word = F.greatest(F.col("block") * block, "offset") - F.col("offset")
    last_word = F.least((F.col("block") + 1) * block, end) - F.col("offset")
    pieces = at.select("row", "source_no", "block", first_word.alias("first"), last_word.alias("last")).join(times.hint("merge"), ["source_no", "block"]).select("row", "first", "last", "times")
    return rows, taken, pieces


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None, **how) -> DataFrame:
    """The mix as rows like those of ``docs``: a text's pieces that are taken once, and again those taken twice.

    Neighbouring pieces stay as they stand in the text; others are joined by a line end. ``length`` is a
    column that holds the number of characters. Repeated rows have their own pieces each; columns of any name stay.
    """
    import re

    own = {key.lower(), text.lower(), source.lower()}
    docs, named_back = set_aside(docs, {"pieces", "row", "nth", "text_hash", "at0", "at1", "at2", "at3"} - own)
    names = docs.columns
    rows, _, pieces = mix(docs.select(key, text, source), key, text, source, **how)
    piece = F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), F.col("times").cast("int").alias("times"))
    listed = pieces.groupBy("row").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    # Rows with equal key, source and text are told apart by their number, so that each has its own pieces.
    marks = ["at0", "at1", "at2", "at3", "text_hash"]
    at = [e.alias(m) for m, e in zip(marks, joinable(key, source), strict=False)]
    nth = F.row_number().over(Window.partitionBy(*marks).orderBy("row"))
    by_row = rows.select("row", *at, "text_hash").withColumn("nth", nth).join(listed.hint("merge"), "row").drop("row")
    rest = [c for c in names if c not in (key, source, text)]
    marked = docs.select("*", *at, F.xxhash64(text).alias("text_hash"))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy(*marks).orderBy(*(rest or marks))))
    joined = marked.join(by_row.hint("merge"), [*marks, "nth"]).select(*names, "pieces")
    word = re.compile(WORDS.encode())

    def copies(raw: bytes, pieces: list) -> Iterator[str]:
        at = [m.span() for m in word.finditer(raw)]
        for t in range(1, max(p["times"] for p in pieces) + 1):
            runs: list[list[int]] = []
            for p in pieces:
                if p["times"] >= t:
                    if runs and runs[-1][1] == p["first"]:
                        runs[-1][1] = p["last"]
                    else:
                        runs.append([p["first"], p["last"]])
            if runs == [[0, len(at)]]:
                yield raw.decode()
            else:
                yield b"\n".join(raw[at[a][0] : at[b - 1][1]] for a, b in runs).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows, texts = [], []
            for i, (raw, taken) in enumerate(zip(batch.column(text).to_pylist(), batch.column("pieces").to_pylist(), strict=True)):
                for x in copies(raw.encode(), taken):
                    rows.append(i)
                    texts.append(x)
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            new = {text: pa.array(texts, pa.string())}
            if length:
                new[length] = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(c, kept.column(c)) for c in names], names)

    return named_back(joined.mapInArrow(run, docs.schema))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, pieces = mix(table(spark, sf_dir, "documents"))
    words = pieces.groupBy("row").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("words"))
    joined = rows.join(words.hint("merge"), "row", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))
