"""Entities of chunks by six groups of providers, and from chunks to a graph.

Each group's provider answers for a chunk with a JSON object of arrays, one per kind. Groups fail apart: a chunk keeps
what the others gave, and lists the groups that failed, with what was wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import answer_store, emit, graph
from quillgraph.operators.answer_store import AnswerStore
from quillgraph.operators.cut import discarded, kept

# Which kinds each group extracts.
GROUPS: dict[str, list[str]] = {
    "group1": ["legal_acts", "articles", "clauses", "resolutions"],
    "group2": ["institutions", "companies", "persons", "courts", "legal_parties"],
    "group3": ["court_cases", "penalties", "complaints"],
    "group4": ["tenders", "awards", "contracts", "change_orders", "auctions", "assets"],
    "group5": ["documents", "sections", "topics", "corrections", "addendums"],
    "group6": ["meetings", "votes"],
}


def extracted(chunks: DataFrame, providers: dict[str, Callable[[list[str]], list]], concurrency: int | None = None, store: AnswerStore | None = None, retries: int = 0) -> DataFrame:
    """The columns of ``chunks`` but for ``chunk_json``, and entities (struct of arrays), failed_groups, errors (map from group to what was wrong).

    chunks: document_id, chunk_id, maybe more, and what a provider is to read, as JSON in ``chunk_json``. An answer that isn't a whole JSON object of
    the group's arrays fails its group: cut off, of other types, or no object at all. Each provider answers a distinct text once, and what it has answered is
    in ``store`` before it is used, under the group's name. ``concurrency`` bounds the tasks that call providers at one time.
    """
    held = store or answer_store.store(chunks.sparkSession)
    rest = [c for c in chunks.columns if c != "chunk_json"]
    rows = kept(chunks.withColumn("chunk_row", F.monotonically_increasing_id()))
    schema = emit.schema()["entities"].dataType
    parsed = rows
    for name, kinds in GROUPS.items():
        fields = ", ".join(f"{k}: {schema[k].dataType.simpleString()}" for k in kinds)
        if name not in providers:
            parsed = parsed.withColumns({name: F.from_json(F.lit("{}"), f"struct<{fields}>"), f"{name}_error": F.lit(None).cast("string")})
            continue
        answers = held.answered(rows, ["chunk_row"], "chunk_json", name, providers[name], retries=retries, tasks=concurrency)
        parsed = parsed.join(answers, "chunk_row")
        read = F.from_json("value", f"struct<{fields}, unread: string>", {"columnNameOfCorruptRecord": "unread"})
        wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("value").isNull(), "no answer").when(~F.ltrim("value").startswith("{"), "not a JSON object")
        parsed = parsed.withColumn(name, read).withColumn(f"{name}_error", wrong.when(F.col(name).isNull() | F.col(f"{name}.unread").isNotNull(), "broken JSON")).drop("value", "error")
        parsed = parsed.withColumn(name, F.when(F.col(f"{name}_error").isNull(), F.col(name)))
    failed = F.array_compact(F.array(*(F.when(F.col(f"{n}_error").isNotNull(), n) for n in GROUPS)))
    errors = F.map_filter(F.create_map(*(x for n in GROUPS for x in (F.lit(n), F.col(f"{n}_error")))), lambda k, v: v.isNotNull())
    group_of = {k: n for n, kinds in GROUPS.items() for k in kinds}
    arrays = [F.coalesce(F.col(f"{group_of[k]}.{k}"), F.array().cast(schema[k].dataType)).alias(k) for k in emit.ENTITIES]
    found = parsed.select(*rest, F.struct(*arrays).alias("entities"), failed.alias("failed_groups"), errors.alias("errors"))
    out = kept(found)
    discarded(rows)
    return out


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number by ``order`` (from 0), by a range partitioning and the counts of its parts; a written table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"order_part": F.spark_partition_id(), "order_at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("order_part").agg(F.count("*").alias("n"), F.min("order_at").alias("first"))  # a row a part
    before = F.sum("n").over(Window.orderBy("order_part")) - F.col("n") - F.col("first")
    shift = counts.select("order_part", before.alias("shift"))
    out = kept(ranged.join(F.broadcast(shift), "order_part").withColumn(name, (F.col("order_at") + F.col("shift")).cast("long")).drop("order_part", "order_at", "shift"))
    discarded(ranged)
    return out


def records_of(found: DataFrame, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what was extracted as records with ``seq``, the number of their chunk by ``order``.

    Else chunks go by document, then chunk id, shorter ones first, so that chunk 10 follows chunk 9. A record of a node has its key among its properties.
    """
    return _records(_ranked(found, order))


def _ranked(found: DataFrame, order: list[Column] | None) -> DataFrame:
    return numbered(found, order or [F.col("document_id"), F.length("chunk_id"), F.col("chunk_id")], "seq")


def _records(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranked = ranked.select("document_id", "chunk_id", "entities", "seq")
    whole = F.map_concat("key", F.map_filter("props", lambda k, v: ~F.map_contains_key("key", k)))
    fresh = emit.nodes(ranked).select("label", graph.node_id().alias("node_id"), whole.alias("props"), "seq")
    links = emit.edges(ranked).select("type", "src_label", graph.node_id("src_key").alias("src_id"), "dst_label", graph.node_id("dst_key").alias("dst_id"), "props", "seq")
    return fresh, links


def graph_of(found: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the graph with what was extracted merged in; edges need both ends.

    The last value wins: by ``order`` of the chunks (see ``records_of``), and within a chunk by the order of the rules. What is merged in is later
    than all that the graph holds.
    """
    last = 0
    for stored in (nodes, edges):
        if stored is not None:
            last = max(last, stored.agg(F.max("seq")).first()[0] or 0)
    ranked = _ranked(found, order)
    fresh, links = (r.withColumn("seq", F.col("seq") + last + 1) for r in _records(ranked))
    all_nodes = kept(graph.upsert_nodes(fresh if nodes is None else nodes.unionByName(fresh)))
    all_edges = kept(graph.upsert_edges(links if edges is None else edges.unionByName(links), all_nodes))
    discarded(ranked)
    return all_nodes, all_edges


def written(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Write a graph as Parquet under ``path`` and count what stands there."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    return {name: spark.read.parquet(f"{path}/{name}").count() for name in ("nodes", "edges")}


def cleared(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Leave an empty graph of the same columns under ``path``."""
    nodes.limit(0).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.limit(0).write.mode("overwrite").parquet(f"{path}/edges")


def summary(status: DataFrame) -> DataFrame:
    """stage, done, failed: how many documents each stage handled. status: path, stage, error (null: done)."""
    return status.groupBy("stage").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def failures(status: DataFrame) -> DataFrame:
    """stage, path, error: a row for each document that a stage failed on."""
    return status.where("error IS NOT NULL").select("stage", "path", "error")
