"""A stored vector index: an inverted file for each label's index, with approximate and exact search.

Each index has coarse centroids, trained on a bounded sample of its vectors (``SAMPLE`` by a hash of the id). Every vector
belongs to the list of its nearest centroid by angle. A list is stored in chunks, one row each: ids, and the vectors as 64-bit floats, packed
in a binary column of about ``CHUNK_BYTES`` (32-bit ones, if the vectors came so). So no row, and no task for one list, grows with a hot vector's copies. The table is
bucketed by index and list. Queries go over it in blocks of about ``QUERY_BLOCK``, whose vectors are broadcast; a search shuffles a bit for each list and query, and of a
task the best of each query: no vector.

A search looks at the ``probes`` lists whose centroids are nearest to a query. An exact one then takes its k-th score so far, and looks at
every other list that may hold a better or equal one: with the angle from query to centroid and the list's radius, none of its vectors is nearer
than the difference. Vectors of length zero have no score and a list of their own (-1), looked at where hits are missing.

Rows: nodes without an embedding are left out; those of a length other than the index's first centroid's raise an error; queries without a vector, and no queries,
give no rows. Only ``MOST_LISTS`` centroids an index are broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.cut import discarded, kept

SAMPLE, MOST_LISTS, ROUNDS = 8192, 512, 8
CHUNK_BYTES, QUERY_BLOCK = 1 << 20, 4096
#: Queries that are compared with a chunk at once.
AT_ONCE = 1024
NO_DIRECTION = -1


def _units(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of one index differ in length")
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), int(sizes[0]) if len(sizes) else 0)


def _train(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means, from the sample's own order."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    centroids = np.unique(sample, axis=0) if len(sample) <= lists else sample[:: max(1, len(sample) // lists)][:lists].copy()
    for _ in range(ROUNDS if len(sample) > lists else 0):
        near = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        moved = _units(sums)
        whole = np.isfinite(moved).all(axis=1)
        centroids[whole] = moved[whole]
    return centroids


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass(frozen=True)
class VectorIndex:
    """An index under ``path``: ``chunks`` (a bucketed table) and ``lists`` (index, list, centroid, radius); ``kind``: of packed numbers."""

    spark: SparkSession
    path: str
    chunks: DataFrame
    lists: DataFrame
    kind: str

    def search(self, queries: DataFrame, settings: DataFrame, default_k: int = 3, prefix: str = "vector", unit: bool = True, probes: int = 24, exact: bool = False) -> DataFrame:
        """The best matches of each query in each index: qid, element_id, index, source, score, as ``search.vector_lookup`` has them.

        queries: qid, query (vector), and maybe ``index`` where a query asks one index only. settings: index, k, min_score, a row per index. The k best by score
        (ties, told by 12 decimals, by id) come first, then the threshold.
        """
        columns = ["qid", "query", *(["index"] if "index" in queries.columns else [])]
        asked = kept(queries.where("query IS NOT NULL").select(columns))
        own = {r["index"]: r["k"] for r in settings.select("index", "k").collect() if r["k"] is not None}  # a row per index
        first = kept(self._best(self._probed(asked, probes), own, default_k, unit))
        found = first
        if exact:
            k = F.coalesce(F.element_at(F.create_map(*(x for i, n in own.items() for x in (F.lit(i), F.lit(n)))), F.col("index")), F.lit(default_k)) if own else F.lit(default_k)
            raw = F.col("score") * 2 - 1 if unit else F.col("score")
            worst = first.groupBy("qid", "index").agg(F.when(F.count("*") >= F.first(k), F.min(F.coalesce(raw, F.lit(-2.0)))).alias("least"))
            rest = self._probed(asked, probes, worst)
            found = first.unionByName(self._best(rest, own, default_k, unit))
        scored = found.join(F.broadcast(settings), "index", "left")  # a row per index
        rank = F.row_number().over(Window.partitionBy("qid", "index").orderBy(F.desc(F.round("score", 12)), "element_id"))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= F.coalesce("k", F.lit(default_k)))
        out = kept(best.where("score IS NULL OR min_score IS NULL OR score >= min_score").select("qid", "element_id", "index", F.concat_ws(":", F.lit(prefix), "index").alias("source"), "score"))
        discarded(asked, first)
        return out

    def _probed(self, asked: DataFrame, probes: int, worst: DataFrame | None = None) -> list[tuple[Broadcast, DataFrame, str]]:
        """Blocks of queries, which of them look at which lists (index, list, asked: a bit for each query), and the type of their ids; with ``worst``, those beyond the first ``probes`` that may matter."""
        tables: dict[str, tuple] = {}
        for r in self.lists.orderBy("index", "list").toArrow().to_pylist():  # MOST_LISTS + 1 an index at most
            tables.setdefault(r["index"], ([], [], []))
            for held, value in zip(tables[r["index"]], (r["list"], r["centroid"], r["radius"]), strict=True):
                held.append(value)
        tables = {i: (np.asarray(n), np.asarray([c for c, m in zip(cs, n, strict=True) if m >= 0]), np.asarray(r)) for i, (n, cs, r) in tables.items()}
        held = self.spark.sparkContext.broadcast(tables)
        rows = asked if "index" in asked.columns else asked.withColumn("index", F.lit(None).cast("string"))
        later = worst is not None
        if later:
            bounds = worst.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("index", "least"))).alias("least"))  # an entry per index
            rows = rows.join(bounds, "qid", "left")
        else:
            rows = rows.withColumn("least", F.create_map().cast("map<string,double>"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
        return [self._block(rows.where(part == b) if blocks > 1 else rows, held, probes, later) for b in range(blocks)]

    def _block(self, rows: DataFrame, held: Broadcast, probes: int, later: bool) -> tuple[Broadcast, DataFrame, str]:
        table = rows.select("qid", "query", "index", "least").toArrow()  # about QUERY_BLOCK rows
        queries = _units(_matrix(table.column("query").combine_chunks()))
        block = self.spark.sparkContext.broadcast((table.column("qid").combine_chunks(), queries, table.column("index").to_pylist(), [dict(x or ()) for x in table.column("least").to_pylist()]))

        def looks(name: str) -> np.ndarray:
            """Whether each query looks at each list of an index."""
            _, q, only, least = block.value
            numbers, centroids, radius = held.value[name]
            out = np.zeros((len(only), len(numbers)), bool)
            some = np.asarray([i for i, x in enumerate(only) if x is None or x == name], np.int64)
            if not len(some):
                return out
            real = numbers >= 0
            cosine = np.nan_to_num(q[some] @ centroids.T, nan=-2.0) if real.any() else np.zeros((len(some), 0))
            order = np.argsort(-cosine, axis=1, kind="stable")
            first = np.zeros((len(some), len(numbers)), bool)
            near = np.zeros(cosine.shape, bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            first[:, real] = near
            if later:
                reach = np.full(first.shape, -2.0)
                reach[:, real] = np.cos(np.maximum(0, _angle(cosine) - radius[real]))
                bound = np.asarray([least[i].get(name) for i in some], float)
                bound = np.where(np.isnan(bound), -9.0, bound)
                nowhere = ~np.isfinite(q[some]).all(axis=1)  # no score with anything: ties by id, everywhere
                first = ((reach >= bound[:, None] - 1e-9) | nowhere[:, None]) & ~first
            out[some] = first
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for batch in batches:
                names, lists, bits = batch.column("index").to_pylist(), batch.column("list").to_pylist(), []
                for name, n in zip(names, lists, strict=True):
                    if name not in found:
                        found[name] = looks(name)
                    asks = found[name][:, np.searchsorted(held.value[name][0], n)]
                    bits.append(np.packbits(asks).tobytes() if asks.any() else None)
                yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("list"), pa.array(bits, pa.binary())], ["index", "list", "asked"]).filter(pa.array([x is not None for x in bits], pa.bool_()))

        return block, self.lists.select("index", "list").mapInArrow(run, "`index` string, list int, asked binary"), rows.schema["qid"].dataType.simpleString()

    def _best(self, probed: list[tuple[Broadcast, DataFrame, str]], own: dict[str, int], default_k: int, unit: bool) -> DataFrame:
        """qid, element_id, index, score: of each task, its best for each query; then the best over tasks."""
        found = reduce(DataFrame.union, [self._block_best(*x, own, default_k, unit) for x in probed])
        most = max([default_k, *own.values()])
        rank = F.row_number().over(Window.partitionBy("qid", "index").orderBy(F.desc(F.round("score", 12)), "element_id"))
        return found.withColumn("n", rank).where(F.col("n") <= most).drop("n")

    def _block_best(self, block: Broadcast, looks: DataFrame, qid_kind: str, own: dict[str, int], default_k: int, unit: bool) -> DataFrame:
        joined = looks.join(self.chunks.hint("merge"), ["index", "list"])  # copies are small in files, so their size there would have them sent through the driver
        id_kind = joined.schema["ids"].dataType.elementType.simpleString()
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, queries, *_ = block.value
            best: dict[str, pa.Table] = {}
            bound: dict[str, np.ndarray] = {}

            def kept_of(name: str) -> None:
                """Of an index, each query's first rows by score and id."""
                k = own.get(name, default_k)
                rows = best[name].take(pc.sort_indices(best[name], [("q", "ascending"), ("told", "descending"), ("element_id", "ascending")], null_placement="at_start"))
                q = rows.column("q").to_numpy()
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                last = np.flatnonzero(nth == k - 1)
                bound[name][q[last]] = rows.column("score").to_numpy()[last]
                best[name] = rows.filter(pa.array(nth < k)).combine_chunks()

            for batch in batches:
                for name, asked, ids, packed in zip(*(batch.column(c) for c in ("index", "asked", "ids", "packed")), strict=True):
                    name, ids, k = name.as_py(), ids.values, own.get(name.as_py(), default_k)
                    least = bound.setdefault(name, np.full(len(qids), -2.0))
                    vectors = _units(np.frombuffer(packed.as_py(), kind).astype(np.float64).reshape(len(ids), -1))
                    asks = np.flatnonzero(np.unpackbits(np.frombuffer(asked.as_py(), np.uint8), count=len(qids)))
                    for a in range(0, len(asks), AT_ONCE):
                        at = asks[a : a + AT_ONCE]
                        score = vectors @ queries[at].T
                        score = np.where(np.isnan(score), -2.0, score)
                        here = np.partition(score, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(len(at), -2.0)
                        i, j = np.nonzero(score >= np.maximum(here, least[at]) - 1e-11)  # ties are kept
                        value = score[i, j]
                        told = np.where(value < -1.5, -9.0, np.round((value + 1) / 2 if unit else value, 12))
                        rows = pa.table({"q": pa.array(at[j]), "told": pa.array(told), "score": pa.array(value), "element_id": ids.take(pa.array(i))})
                        best[name] = pa.concat_tables([best[name], rows]) if name in best else rows
                        if len(best[name]) > 2 * k * len(qids) + 4096:
                            kept_of(name)
            for name in best:
                kept_of(name)
                rows = best[name]
                value = rows.column("score").to_numpy()
                value = np.where(value < -1.5, np.nan, (value + 1) / 2 if unit else value)
                columns = [pc.take(qids, rows.column("q").combine_chunks()), rows.column("element_id").combine_chunks(), pa.array([name] * len(rows), pa.string()), pa.array(value, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "element_id", "index", "score"])

        return joined.mapInArrow(run, f"qid {qid_kind}, element_id {id_kind}, `index` string, score double")


def build(nodes: DataFrame, path: str, most_lists: int = MOST_LISTS, buckets: int | None = None) -> VectorIndex:
    """Index the nodes (element_id, index, embedding) that have an embedding, under ``path`` in a folder that executors share."""
    spark = nodes.sparkSession
    number = "float" if nodes.schema["embedding"].dataType.elementType == T.FloatType() else "double"
    kind = "<f4" if number == "float" else "<f8"
    rows = nodes.where("embedding IS NOT NULL AND `index` IS NOT NULL").select("element_id", "index", F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    order = Window.partitionBy("index").orderBy(F.xxhash64("element_id"), "element_id")
    # Ids are numbered without their vectors; SAMPLE an index are broadcast.
    first = lambda x: x.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    sample = first(rows.join(F.broadcast(first(rows.select("element_id", "index")).select("element_id", "index")), ["element_id", "index"], "left_semi"))
    counts = rows.groupBy("index").agg(F.count("*").alias("rows"))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        lists = int(min(most_lists, max(1, np.sqrt(part["rows"].iloc[0])), max(1, len(part) // 4)))
        centroids = _train(_units(np.stack(part["embedding"].to_list()).astype(np.float64)), lists)
        return pd.DataFrame({"index": pd.Series([part["index"].iloc[0]] * len(centroids), dtype=object), "list": np.arange(len(centroids), dtype=np.int32), "centroid": pd.Series(centroids.tolist(), dtype=object)})

    trained = kept(sample.join(F.broadcast(counts), "index").groupBy("index").applyInPandas(train, "`index` string, list int, centroid array<double>"))  # a row per index
    held: dict[str, list] = {}
    for r in trained.orderBy("index", "list").toArrow().to_pylist():
        held.setdefault(r["index"], []).append(r["centroid"])
    centroids = spark.sparkContext.broadcast({i: np.asarray(c) for i, c in held.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column("index").to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                some = pa.array(np.flatnonzero(names == name))
                own = centroids.value.get(name)
                v = _units(_matrix(batch.column("embedding").take(some)))
                whole = np.isfinite(v).all(axis=1)
                if own is not None and v.shape[1] != own.shape[1]:
                    raise ValueError("vectors of one index differ in length")
                cosine = v @ own.T if own is not None else np.zeros((len(v), 1))
                near = np.where(whole, np.nan_to_num(cosine, nan=-2.0).argmax(axis=1), NO_DIRECTION)
                angle = np.where(whole, _angle(np.nan_to_num(cosine, nan=-1.0).max(axis=1)), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("element_id").take(some), batch.column("index").take(some), batch.column("embedding").take(some), pa.array(near.astype(np.int32)), pa.array(angle)], ["element_id", "index", "embedding", "list", "angle"])

    id_kind = nodes.schema["element_id"].dataType.simpleString()
    placed = kept(rows.mapInArrow(place, f"element_id {id_kind}, `index` string, embedding array<{number}>, list int, angle double"))
    sizes = placed.groupBy("index", "list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.max(F.size("embedding")).alias("length"))
    parts = F.ceil(F.col("n") * F.col("length") * 8 / CHUNK_BYTES)
    lists = sizes.join(trained, ["index", "list"], "left").select("index", "list", "radius", "centroid")
    lists.write.mode("overwrite").parquet(f"{path}/lists")

    def pack(batch: pa.Table) -> pa.Table:
        v = _matrix(batch.column("embedding").combine_chunks())
        ids = pa.array([batch.column("element_id").to_pylist()], pa.list_(batch.schema.field("element_id").type))
        return pa.table([batch.column("index")[:1], batch.column("list")[:1], ids, pa.array([v.astype(kind).tobytes()], pa.binary())], ["index", "list", "ids", "packed"])

    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = placed.join(F.broadcast(sizes.select("index", "list", parts.alias("parts"))), ["index", "list"]).withColumn("chunk", F.pmod(F.xxhash64("element_id"), F.col("parts")))
    # Vectors are shuffled once, to their bucket: chunks are made there.
    packed = chunked.select("element_id", "index", "embedding", "list", "chunk").repartition(n, "index", "list").groupBy("index", "list", "chunk").applyInArrow(pack, f"`index` string, list int, ids array<{id_kind}>, packed binary")
    name = f"quillgraph_vectors_{uuid.uuid4().hex}"
    packed.write.bucketBy(n, "index", "list").sortBy("index", "list").option("path", f"{path}/chunks").saveAsTable(name)
    spark.range(1).select(F.lit(n).alias("buckets"), F.lit(id_kind).alias("id_kind"), F.lit(kind).alias("kind")).write.mode("overwrite").parquet(f"{path}/about")
    discarded(trained, placed)
    return VectorIndex(spark, path, spark.table(name), spark.read.parquet(f"{path}/lists"), kind)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` wrote, in a later session too."""
    buckets, id_kind, kind = spark.read.parquet(f"{path}/about").first()
    name = f"quillgraph_vectors_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (`index` STRING, list INT, ids ARRAY<{id_kind}>, packed BINARY) USING parquet OPTIONS (path '{path}/chunks') CLUSTERED BY (`index`, list) SORTED BY (`index`, list) INTO {buckets} BUCKETS")
    return VectorIndex(spark, path, spark.table(name), spark.read.parquet(f"{path}/lists"), kind)


def targeted(entities: DataFrame, index: VectorIndex, hints: DataFrame, settings: DataFrame, provider, exact: bool = False) -> DataFrame:
    """qid, id, element_id, source, score: entities looked up by the text of their properties in their label's index.

    entities: qid, id, label, props. hints: label, index; a label without an index isn't looked up. ``provider`` embeds each distinct text once.
    """
    from quillgraph.operators.providers import called

    text = F.array_join(F.map_values("props"), " ")
    wanted = entities.join(F.broadcast(hints), "label").select("qid", "id", "index", text.alias("text")).where("text <> ''")  # a row per label
    texts = wanted.select("text").distinct().withColumn("key", F.col("text"))
    vectors = kept(called(texts, "key", "text", provider, "array<double>").select(F.col("key").alias("text"), F.col("value").alias("query")))
    asked = kept(wanted.join(vectors, "text").select(F.struct("qid", "id").alias("qid"), "index", "query"))
    found = index.search(asked, settings, prefix="vector_targeted", exact=exact)
    discarded(vectors, asked)
    return found.select("qid.qid", "qid.id", "element_id", "source", "score")
