"""Exact top-k search by a pivot-distance index.

Vectors become integers, ``floor(1024 x)``; the score is the integer inner product. With
``m`` the greatest squared length, a vector ``x`` lifted by one more component to squared length ``m`` has
``|q - x|^2 = |q|^2 + m - 2 q.x`` from a query ``q`` lifted by 0: the highest products are the nearest
vectors. So every vector is keyed by its nearest pivot and its distance from it, and the index is
sorted by that key.

Queries go to the index in blocks of neighbours, one after the other. The vectors of a block give each of its queries a
first bound of its k-th score; pivots whose annulus can't reach any of these bounds aren't read. Inside a partition, each pivot's run of
sorted distances is an annulus cut into short segments. By the triangle inequality a segment with distances in
``[a, b]`` holds nothing nearer to ``q`` than ``max(0, a - d, d - b)``, ``d`` being the distance from ``q`` to
the pivot; segments are visited from the smallest bound, and the search of a query stops when the bound says that
no further vector can reach its k-th score. Ties with the k-th score are always visited. Each
partition's best k meet in one ranking.

Pivots are chosen from a bounded sample (``PIVOT_SAMPLE`` vectors by a hash of the id); they
change the cost, never the result. Vectors that are null, or hold null or non-finite
components, take no part. A query sees only vectors of its own length. Copies of a vector are spread by id.
Repeated ids are separate rows: each is a query of its own and a candidate for the others, and a row never finds itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, saved, table

SCALE = 1024
PIVOTS = 64
PIVOT_SAMPLE = 2048
#: Queries that one broadcast holds.
QUERY_BLOCK = 4096
#: Vectors in a segment of an annulus.
SEGMENT = 128


def integer_vectors(rows: DataFrame, key: str, vector: str, asked: Column) -> DataFrame:
    """key, ``asked`` (whether it is a query) and ``v``: components as floor(1024 x), whole and finite vectors only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return rows.where(F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def choose_pivots(vectors: DataFrame, top: float) -> np.ndarray:
    """Far-apart vectors of a bounded sample, lifted."""
    sample = [r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()]
    if not sample:
        return np.zeros((0, 1))
    points = lifted(np.asarray(sample), top)
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < min(PIVOTS, len(points)):
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return points[chosen]


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    rest = np.maximum(top - (v * v).sum(axis=1), 0)
    return np.column_stack([v, np.sqrt(rest)])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class _Best:
    """The k best of each query so far: by score, ties by smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.scores[who], scores], axis=1)
        i = np.concatenate([self.ids[who], np.broadcast_to(ids, scores.shape)], axis=1)
        by = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def search_partition(queries: tuple[np.ndarray, np.ndarray], seeds: np.ndarray, pivots: np.ndarray, top: float, index: tuple, best: _Best) -> None:
    """Add to ``best`` from a part of the index: (rows, ids, vectors, pivot numbers, distances), sorted by pivot and distance.

    ``queries``: row numbers and vectors; ``seeds``: scores that their k-th one can't be less than.
    """
    query_rows, q = queries
    rows, ids, v, pivot, distance = index
    cut = np.concatenate([[True], pivot[1:] != pivot[:-1]])
    run = np.arange(len(ids)) - np.maximum.accumulate(np.where(cut, np.arange(len(ids)), 0))
    starts = np.flatnonzero(cut | (run % SEGMENT == 0))
    ends = np.append(starts[1:], len(ids))
    to_pivot = _distances(np.column_stack([q, np.zeros(len(q))]), pivots)[:, pivot[starts]]
    bound = np.maximum(0, np.maximum(distance[starts] - to_pivot, to_pivot - distance[ends - 1]))
    # An inner product that a segment can't exceed; rounding is given one unit and a small part.
    square = (q * q).sum(axis=1)[:, None] + top
    reach = (square - bound**2) / 2 + 1 + 1e-9 * square
    order = np.argsort(-reach, axis=1, kind="stable")
    live = np.arange(len(q))
    for step in range(len(starts)):
        segment = order[live, step]
        live = live[reach[live, segment] >= np.maximum(best.scores[live, -1], seeds[live])]
        if not len(live):
            break
        segment = order[live, step]
        for s in np.unique(segment):
            who = live[segment == s]
            a, b = starts[s], ends[s]
            scores = q[who] @ v[a:b].T
            scores[query_rows[who][:, None] == rows[a:b]] = -np.inf
            best.add(who, scores, ids[a:b])


def seed_scores(q: np.ndarray, k: int) -> np.ndarray:
    """For each query of a block, the k-th best score among the others of the block; too few give no bound."""
    if len(q) <= k:
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    for a in range(0, len(q), 512):
        scores = q[a : a + 512] @ q.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a : a + 512] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def top_k(rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for each row where ``asked`` holds."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, key, vector, asked)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for (length,) in vectors.where("asked").select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # one pass for each vector length, as a rule one
        same = vectors.where(F.size("v") == length)
        top = float(same.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0)
        pivots = spark.sparkContext.broadcast(choose_pivots(same, top))

        def keyed(batches: Iterator[pa.RecordBatch], top: float = top, pivots=pivots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _distances(lifted(_matrix(batch.column("v")), top), pivots.value)
                    near = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "asked", "v")), pa.array(near.astype(np.int32)), pa.array(d.min(axis=1))], ["vec_id", "asked", "v", "pivot", "distance"])

        index = same.mapInArrow(keyed, "vec_id long, asked boolean, v array<double>, pivot int, distance double")
        index = index.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
        index = saved(index.withColumn("row", F.monotonically_increasing_id()), "pivot-index")
        annuli = index.groupBy("pivot").agg(F.min("distance"), F.max("distance")).collect()  # PIVOTS rows at most
        for query_rows, query_ids, q in _blocks(index):
            seeds = seed_scores(q, k)
            near, least, most = (np.asarray(x, y) for x, y in zip(zip(*annuli, strict=True), (np.int64, float, float), strict=True))
            away = _distances(np.column_stack([q, np.zeros(len(q))]), pivots.value)[:, near]
            square = (q * q).sum(axis=1)[:, None] + top
            reach = (square - np.maximum(0, np.maximum(least - away, away - most)) ** 2) / 2 + 1 + 1e-9 * square
            wanted = near[(reach >= seeds[:, None]).any(axis=0)].tolist()
            held = spark.sparkContext.broadcast((query_rows, query_ids, q, seeds))

            def search(batches: Iterator[pa.RecordBatch], top: float = top, pivots=pivots, held=held) -> Iterator[pa.RecordBatch]:
                query_rows, query_ids, q, seeds = held.value
                best = _Best(len(q), k)
                for batch in batches:
                    if batch.num_rows:
                        rows, ids, pivot, distance = (batch.column(c).to_numpy() for c in ("row", "vec_id", "pivot", "distance"))
                        search_partition((query_rows, q), seeds, pivots.value, top, (rows, ids, _matrix(batch.column("v")), pivot, distance), best)
                row, place = np.nonzero((best.scores > -np.inf) & (best.scores >= seeds[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(query_rows[row]), pa.array(query_ids[row]), pa.array(best.ids[row, place]), pa.array(best.scores[row, place].astype(np.int64))], ["query_row", "query_id", "vec_id", "score"])

            found = saved(index.where(F.col("pivot").isin(wanted)).mapInArrow(search, "query_row long, query_id long, vec_id long, score long").withColumn("n", F.lit(length)), "matches")
            held.destroy()
            out = found if out is None else out.union(found)
        dropped(index)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("n", "query_row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(index: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, ids, vectors) of queries in the order of the index, a block of bounded size at a time."""
    rows, ids, held = [], [], []
    for r in index.where("asked").select("row", "vec_id", "v").orderBy("row").toLocalIterator():
        rows.append(r[0])
        ids.append(r[1])
        held.append(r[2])
        if len(ids) == QUERY_BLOCK:
            yield np.asarray(rows), np.asarray(ids), np.asarray(held)
            rows, ids, held = [], [], []
    if ids:
        yield np.asarray(rows), np.asarray(ids), np.asarray(held)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 100 == 0)


TOPK_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
