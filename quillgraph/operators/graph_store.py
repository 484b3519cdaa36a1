"""A graph kept in buckets, into which loads are merged without rewriting what they don't touch.

Nodes and edges lie in buckets by a hash of their identity. A load reads and writes only the buckets that its records fall into, each into a folder of the load's version;
its commit, written last and in one piece, says for every bucket which version holds it. Readers follow the latest commit, so they see the graph before a load or
after it, and a load that was broken off leaves no trace but files that ``vacuum`` removes.

Records are those of ``graph``: nodes label, node_id, props, seq; edges type, src_label, src_id, dst_label, dst_id, props, seq. ``seq`` orders a load's records (below
2 ** 40); a later load comes after all before. Of two values of a property the later stays, a null value removes it. An edge needs both ends, in the graph or in
the load; others are dropped and counted, as are records without a whole identity.

One load runs at a time. A load under a name that was committed before changes nothing and gives the counts it had.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.operators.cut import discarded, kept

IDENTITY = {"nodes": ["label", "node_id"], "edges": graph.EDGE}
SCHEMA = {
    "nodes": "label string, node_id string, props map<string,string>, seq long",
    "edges": "type string, src_label string, src_id string, dst_label string, dst_id string, props map<string,string>, seq long",
}
SCHEMA_COLUMNS = {t: [c.split(" ")[0] for c in s.split(", ")] for t, s in SCHEMA.items()}
COUNTS = ["nodes_processed", "nodes_dropped", "nodes_created", "edges_processed", "edges_dropped", "edges_created", "buckets_written"]
_COMMIT = "name string, version long, held map<string,array<struct<bucket:int,version:long>>>, counts map<string,long>"


@dataclass(frozen=True)
class GraphStore:
    spark: SparkSession
    path: str
    buckets: int = 64

    # -- what is there -------------------------------------------------------------

    def _commits(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")

    def _latest(self) -> tuple[int, dict[str, dict[int, int]]]:
        """The latest version, and the version of each bucket that has rows."""
        last = self._commits().orderBy(F.desc("version")).first()  # a row a load
        if last is None:
            return 0, {t: {} for t in IDENTITY}
        return last.version, {t: {r.bucket: r.version for r in last.held.get(t, [])} for t in IDENTITY}

    def _read(self, table: str, held: dict[int, int], only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{table}/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA[table])
        return self.spark.read.schema(SCHEMA[table]).parquet(*folders)

    def nodes(self) -> DataFrame:
        return self._read("nodes", self._latest()[1]["nodes"])

    def edges(self) -> DataFrame:
        return self._read("edges", self._latest()[1]["edges"])

    def history(self) -> DataFrame:
        """name, version, counts of each load."""
        return self._commits().select("name", "version", "counts")

    # -- loads -----------------------------------------------------------------------

    def _bucket(self, table: str):
        return F.pmod(F.xxhash64(*IDENTITY[table]), F.lit(self.buckets)).cast("int")

    def _merged(self, table: str, fresh: DataFrame, held: dict[int, int], version: int) -> tuple[dict[int, int], int]:
        """Write the buckets that ``fresh`` (with bucket) falls into; the buckets' versions, and how many rows are new."""
        touched = {r[0] for r in fresh.select("bucket").distinct().collect()}  # as many as there are buckets
        if not touched:
            return held, 0
        before = self._read(table, held, touched)
        merged = graph.upsert(before.unionByName(fresh.drop("bucket")), IDENTITY[table]).withColumn("bucket", self._bucket(table))
        merged.select(*SCHEMA_COLUMNS[table], "bucket").repartition("bucket").sortWithinPartitions("bucket", *IDENTITY[table]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/version={version}")
        held = held | {b: version for b in touched}
        return held, self._read(table, held, touched).count() - before.count()

    def load(self, nodes: DataFrame, edges: DataFrame, name: str) -> dict[str, int]:
        """Merge records in and commit; counts of records processed and dropped, of rows created, and of buckets written."""
        done = self._commits().where(F.col("name") == name).first()
        if done is not None:
            return dict(done.counts)
        last, held = self._latest()
        version = last + 1
        later = F.lit(version * 2**40).cast("long") + F.col("seq")
        fresh = {}
        for table, rows in (("nodes", nodes), ("edges", edges)):
            fresh[table] = kept(rows.select(*SCHEMA_COLUMNS[table]).withColumns({"seq": later, "bucket": self._bucket(table)}))
        whole = {t: F.lit(True) for t in IDENTITY}
        for t, names in IDENTITY.items():
            for c in names:
                whole[t] = whole[t] & F.col(c).isNotNull()
        counts = dict.fromkeys(COUNTS, 0)
        counts["nodes_processed"], counts["edges_processed"] = (f.count() for f in fresh.values())
        good = fresh["nodes"].where(whole["nodes"])
        node_buckets, counts["nodes_created"] = self._merged("nodes", good, held["nodes"], version)
        # Ends are looked up in the buckets they fall into alone.
        ends = None
        for side in ("src", "dst"):
            one = fresh["edges"].where(whole["edges"]).select(F.col(f"{side}_label").alias("label"), F.col(f"{side}_id").alias("node_id"))
            ends = one if ends is None else ends.union(one)
        asked = {r[0] for r in ends.select(self._bucket("nodes")).distinct().collect()}
        known = self._read("nodes", node_buckets, asked)
        resolved = kept(graph.resolved(fresh["edges"].where(whole["edges"]), known))
        edge_buckets, counts["edges_created"] = self._merged("edges", resolved, held["edges"], version)
        counts["nodes_dropped"] = counts["nodes_processed"] - good.count()
        counts["edges_dropped"] = counts["edges_processed"] - resolved.count()
        counts["buckets_written"] = sum(v == version for h in (node_buckets, edge_buckets) for v in h.values())
        told = {"nodes": [{"bucket": b, "version": v} for b, v in node_buckets.items()], "edges": [{"bucket": b, "version": v} for b, v in edge_buckets.items()]}
        self.spark.createDataFrame([(name, version, told, counts)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        discarded(*fresh.values(), resolved)
        return counts

    def cleared(self, name: str) -> None:
        """Commit an empty graph."""
        last, _ = self._latest()
        self.spark.createDataFrame([(name, last + 1, {"nodes": [], "edges": []}, dict.fromkeys(COUNTS, 0))], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def vacuum(self) -> int:
        """Delete the buckets that the latest commit doesn't hold; how many there were. No reader may be on an older commit."""
        _, held = self._latest()
        gone = 0
        conf = self.spark._jsc.hadoopConfiguration()
        for table in IDENTITY:
            top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            fs = top.getFileSystem(conf)
            if not fs.exists(top):
                continue
            for at in fs.listStatus(top):
                for bucket in fs.listStatus(at.getPath()):
                    folder = bucket.getPath()
                    if folder.getName().startswith("bucket="):
                        b, v = int(folder.getName()[7:]), int(at.getPath().getName()[8:])
                        if held[table].get(b) != v:
                            fs.delete(folder, True)
                            gone += 1
        return gone
