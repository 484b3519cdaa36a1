"""Centroid clustering by sort-means, in whole numbers.

Vectors become integers, ``floor(scale * x)``, and distances are squared and exact. Each round orders, for every centroid, the others by
their distance from it. A vector starts from the centroid it was assigned to and scans the others in that order; as soon as one is
strictly further from its centroid than twice the vector is, no later one can be as near, and the scan stops. Ties go to the smaller number, so
what is exactly twice as far is still looked at. Then every centroid with vectors becomes their mean, rounded down by component.

A task handles the vectors of one former centroid together: ordered by their distance, those that still scan are a prefix. Centroids
are the only thing that reaches the driver: ``k`` rows of sums a round, added up before the shuffle. The assignment of a round is
written to the shared folder and starts the next one.

Rows: a vector that is null, of another length, or holds null or non-finite components takes no part and has no row. Repeated ids are rows of
their own; a null id is hashed as an empty text for the choice of the first centroids. With fewer vectors than ``k``, all are first
centroids. An empty table has no rows. Components beyond ``LARGEST`` in whole numbers, whose distances would leave 64 bits, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, saved, table

#: Absolute value of a component beyond which squared distances of long vectors might leave 64 bits.
LARGEST = 1 << 26
SEED = 1


def whole_vectors(rows: DataFrame, key: str, vector: str, length: int, scale: int) -> DataFrame:
    """key and ``v``, components as floor(scale * x), of the vectors that take part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    small = lambda x: F.when(F.abs(x) <= LARGEST, x.cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    whole = F.transform(vector, lambda x: small(F.floor(x.cast("double") * scale)))
    return rows.where((F.size(vector) == length) & usable).select(key, whole.alias("v"))


def first_centroids(vectors: DataFrame, key: str, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose hashes of seed and key are smallest, in that order; rows of one key by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(mark, "v").limit(k).select("v").collect()
    return np.asarray([r[0] for r in rows], np.int64)


def _distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


def assigned(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector, scanning from its centroid of the round before.

    ``seen`` collects how many distances each scan worked out.
    """
    between = np.stack([_distances(centroids, c) for c in centroids])
    order = np.argsort(between, axis=1, kind="stable")
    cluster, distance = before.copy(), np.empty(len(vectors), np.int64)
    for own in np.unique(before):
        rows = np.flatnonzero(before == own)
        start = _distances(vectors[rows], centroids[own])
        far_first = np.argsort(-start, kind="stable")
        rows, start = rows[far_first], start[far_first]
        members = vectors[rows]
        best, nearest = start.copy(), np.full(len(rows), own)
        live = len(rows)
        for other in order[own][order[own] != own]:
            # The gap is strictly beyond twice the distance where its square is beyond four times the squared one.
            live = int(np.searchsorted(-4 * start[:live], -between[own, other], side="right"))
            if not live:
                break
            d = _distances(members[:live], centroids[other])
            if seen is not None:
                seen.append(live)
            closer = (d < best[:live]) | ((d == best[:live]) & (other < nearest[:live]))
            best[:live][closer], nearest[:live][closer] = d[closer], other
        cluster[rows], distance[rows] = nearest, best
    return cluster, distance


def _assign(vectors: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """key, v, cluster and distance by the given centroids; ``vectors`` has the cluster of the round before."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                cluster, distance = assigned(v, batch.column("cluster").to_numpy().astype(np.int64), held.value)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], [key, "v", "cluster", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "v", "cluster").mapInArrow(run, f"`{key}` {kind}, v array<long>, cluster int, distance long")


def moved(placed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' means; those without vectors stay."""
    length = centroids.shape[1]
    sums = placed.groupBy("cluster").agg(F.count("*"), F.array(*(F.sum(F.col("v")[i]) for i in range(length))))
    out = centroids.copy()
    for cluster, count, total in sums.collect():  # a row for each centroid at most
        out[cluster] = [s // count for s in total]
    return out


def sort_means(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """key, v (whole numbers), cluster and squared distance of each vector that takes part, and the final centroids."""
    vectors = whole_vectors(rows, key, vector, length, scale)
    centroids = first_centroids(vectors, key, k)
    placed = saved(vectors.withColumn("cluster", F.lit(0)), "vectors")
    if not len(centroids):
        return placed.withColumn("distance", F.lit(0).cast("long")), centroids
    for left in range(rounds, -1, -1):
        before, placed = placed, saved(_assign(placed, key, centroids), "assignment")
        dropped(before)
        if left:
            centroids = moved(placed, centroids)
    return placed, centroids


def inertia(placed: DataFrame) -> tuple[dict[int, int], int]:
    """Sum of squared distances by cluster (``k`` rows at most), and over all."""
    own = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.sum("distance")).collect()}
    return own, sum(own.values())


def _by_cluster(values: dict[int, object], kind: str) -> Column:
    """A value by the cluster's number."""
    return F.element_at(F.array(*(F.lit(values.get(i)).cast(kind) for i in range(max(values) + 1))), F.col("cluster") + 1) if values else F.lit(None).cast(kind)


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hashlib import sha256

    placed, centroids = sort_means(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    own, total = inertia(placed)
    marks = {i: sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for i, c in enumerate(centroids)}
    return placed.select(
        "vec_id", "cluster", "distance",
        _by_cluster(own, "long").alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        _by_cluster(marks, "string").alias("centroid_sha256"),
    )


def _sql() -> str:
    """Every distance of every round, by joins."""
    steps = []
    for r in range(4):
        steps.append(
            f"""d{r} AS (
  SELECT n, vec_id, v, c.i, list_sum(list_transform(list_zip(v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM kept, c{r} c
), a{r} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(i, (distance, i)) AS i, min(distance) AS distance FROM d{r} GROUP BY n
)"""
        )
        if r < 3:
            steps.append(
                f"""s{r} AS (
  SELECT i, place, sum(x) AS s, count(*) AS n FROM (SELECT i, unnest(v) AS x, unnest(range(64)) AS place FROM a{r}) GROUP BY i, place
), m{r} AS (
  SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM s{r} GROUP BY i
), c{r + 1} AS MATERIALIZED (
  SELECT c.i, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.i = c.i
)"""
            )
    return (
        """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark, v) - 1 AS i, v AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS mark, v FROM kept ORDER BY mark, v LIMIT 16)
), """
        + ", ".join(steps)
        + """
SELECT a.vec_id, CAST(a.i AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.i = a.i
"""
    )


SORT_MEANS_SQL = _sql()
