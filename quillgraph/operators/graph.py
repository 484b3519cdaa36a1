"""Property graphs in DataFrames: idempotent upserts, endpoints, labels, expansion.

nodes: label, node_id, props (map), seq; edges: type, src_label, src_id, dst_label, dst_id,
props, seq. Of two values of a property the one with the greater ``seq`` stays; a null value
removes the property.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import pascal_case

EDGE = ["type", "src_label", "src_id", "dst_label", "dst_id"]
#: Records that a task merges: more of them are dealt out to more tasks.
SHARE = 500_000


def node_id(key: str = "key"):
    """A node's id from its key map: values by key name."""
    entries = F.sort_array(F.map_entries(key))
    return F.array_join(F.transform(entries, lambda e: F.coalesce(e["value"], F.lit(""))), "|")


def upsert(rows: DataFrame, identity: list[str], n: int | None = None) -> DataFrame:
    """Merge records of equal identity, property by property; ``seq`` becomes the latest.

    Running it over its own result changes nothing. Records are dealt out once, by a hash of their identity, to as many tasks as their number
    asks for; they are counted, unless ``n`` says how many there are at most.
    """
    n = rows.count() if n is None else n
    tasks = max(-(-n // SHARE), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(*identity, "props", "seq", F.xxhash64(*identity).alias("deal")).repartition(tasks, "deal")
    each = dealt.select("deal", *identity, "seq", F.explode_outer("props").alias("k", "v"))
    last = each.groupBy("deal", *identity, "k").agg(F.max_by(F.struct("v"), "seq")["v"].alias("v"), F.max("seq").alias("seq"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull() & F.col("v").isNotNull(), F.struct("k", "v")))  # an entity's properties
    return last.groupBy("deal", *identity).agg(F.max("seq").alias("seq"), F.map_from_entries(F.sort_array(pairs)).alias("props")).drop("deal")


def upsert_nodes(rows: DataFrame) -> DataFrame:
    return upsert(rows, ["label", "node_id"])


def upsert_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Merged edges of which both ends exist."""
    return upsert(resolved(rows, nodes), EDGE, rows.count())


def resolved(edges: DataFrame, nodes: DataFrame, with_labels: bool = True) -> DataFrame:
    """Edges of which both ends exist; without labels an end is found by id alone."""
    for side in ("src", "dst"):
        keys = [f"{side}_label", f"{side}_id"] if with_labels else [f"{side}_id"]
        ends = nodes.select(*(F.col(k.replace(f"{side}_id", "node_id").replace(f"{side}_label", "label")).alias(k) for k in keys)).distinct()
        edges = edges.join(ends.hint("shuffle_hash"), keys, "left_semi")  # a task holds its share of nodes and sorts no edges
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that miss an end."""
    marks = nodes.select("label", "node_id").distinct().withColumn("there", F.lit(True))
    for side in ("src", "dst"):
        edges = edges.join(marks.toDF(f"{side}_label", f"{side}_id", f"{side}_there"), [f"{side}_label", f"{side}_id"], "left")
    return edges.where("src_there IS NULL OR dst_there IS NULL").drop("src_there", "dst_there")


def allowed(edges: DataFrame, relations: DataFrame, last_only: bool = False) -> DataFrame:
    """Edges that the schema allows; ``last_only`` keeps one target for each (from, type), the last by ``ord``."""
    if last_only:
        relations = relations.groupBy("from_label", "type").agg(F.max_by("to_label", "ord").alias("to_label"))
    rules = relations.select(F.col("from_label").alias("src_label"), "type", F.col("to_label").alias("dst_label"))
    return edges.join(F.broadcast(rules), ["src_label", "type", "dst_label"], "left_semi")  # the schema's rules


def strict_relations(relations: DataFrame, labels: list[str]) -> DataFrame:
    """Rules between chosen labels; all rules if none is chosen."""
    return relations.where(F.col("from_label").isin(labels) & F.col("to_label").isin(labels)) if labels else relations


def _new_name(migrations: dict[str, str]):
    """A label's new name: by a table, or else in Pascal case, if it is in upper case."""
    names = F.create_map(*(F.lit(x) for pair in migrations.items() for x in pair))
    return lambda x: F.when(x == F.upper(x), F.coalesce(F.try_element_at(names, x), pascal_case(x))).otherwise(x)


def relabelled(nodes: DataFrame, migrations: dict[str, str]) -> DataFrame:
    """Nodes with upper-case labels renamed: in the array ``labels``, and in ``label``, where there is one."""
    new = _new_name(migrations)
    out = nodes.withColumn("labels", F.array_sort(F.array_distinct(F.transform("labels", new)))) if "labels" in nodes.columns else nodes
    return out.withColumn("label", new(F.col("label"))) if "label" in nodes.columns else out


def relabelled_edges(edges: DataFrame, migrations: dict[str, str]) -> DataFrame:
    """Edges whose ends have the new labels."""
    new = _new_name(migrations)
    return edges.withColumns({c: new(F.col(c)) for c in ("src_label", "dst_label")})


def relabel_report(nodes: DataFrame, migrations: dict[str, str]) -> DataFrame:
    """old, new, n for labels that change."""
    names = F.create_map(*(F.lit(x) for pair in migrations.items() for x in pair))
    old = nodes.select(F.explode("labels").alias("old")).where(F.col("old") == F.upper("old"))
    return old.withColumn("new", F.coalesce(F.try_element_at(names, F.col("old")), pascal_case("old"))).groupBy("old", "new").agg(F.count("*").alias("n"))


def ids_by_label(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """label, n, ids: sorted distinct ids of all nodes that carry a label (element_id, labels).

    Nodes with a ``qid`` are grouped for each question apart; with ``most``, only a question's first nodes by id are told.
    """
    by = ["qid"] if "qid" in nodes.columns else []
    each = nodes.select(*by, "element_id", F.explode("labels").alias("label")).distinct()
    if most is not None:
        rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("element_id"))
        each = each.withColumn("rank", rank).where(F.col("rank") <= most)
    return each.groupBy(*by, "label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("element_id")).alias("ids"))


def expand(nodes: DataFrame, edges: DataFrame, hops: list[tuple[str, str, str]], start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """Paths along ``hops`` (from label, type, to label): id_0, id_1, ...; ends may be held to given ids (``element_id``)."""
    paths = nodes.where(F.col("label") == hops[0][0]).select(F.col("node_id").alias("id_0"))
    if start is not None:
        paths = paths.join(start.select(F.col("element_id").alias("id_0")).distinct(), "id_0", "left_semi")
    for i, (source, kind, target) in enumerate(hops):
        step = edges.where((F.col("type") == kind) & (F.col("src_label") == source) & (F.col("dst_label") == target))
        step = step.select(F.col("src_id").alias(f"id_{i}"), F.col("dst_id").alias(f"id_{i + 1}"))
        there = nodes.where(F.col("label") == target).select(F.col("node_id").alias(f"id_{i + 1}"))
        paths = paths.join(step, f"id_{i}").join(there, f"id_{i + 1}", "left_semi")
    last = f"id_{len(hops)}"
    if end is not None:
        paths = paths.join(end.select(F.col("element_id").alias(last)).distinct(), last, "left_semi")
    return paths.select(*(f"id_{i}" for i in range(len(hops) + 1)))
