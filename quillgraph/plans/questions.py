"""A batch of questions through decomposition, linking, pattern search, review and answers.

The state is a row per question. Each attempt runs for all questions on its route at once: routes are
columns, and a loop of at most five attempts filters the batch by them. Providers answer in batches inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph import catalog
from quillgraph.operators import answer, decompose, link
from quillgraph.operators.cut import discarded, kept
from quillgraph.operators.providers import called
from quillgraph.plans import conjunctive, routing
from quillgraph.plans.patterns import EDGE_ALIASES, ROW_LIMIT

#: Context nodes of a question; characters of its rows that an answer is written from.
CONTEXT_NODES, DATA_LENGTH = 10, 12_000
NO_ENTRY = "Entity linking returned no entry nodes."
WRITTEN = "struct<links:array<struct<source:string,target:string,type:string>>>"
NODES = "array<struct<name:string,label:string,element_id:string>>"

Provider = Callable[[list[str]], list]


def asked_links(links: DataFrame) -> DataFrame:
    """qid, ord, source, target, type, src_label, dst_label: valid links, by the names under which ingestion writes their types."""
    aliases = F.create_map(*(F.lit(x) for pair in EDGE_ALIASES.items() for x in pair))
    return links.select("qid", "ord", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.coalesce(F.try_element_at(aliases, "type"), "type").alias("type"), "src_label", "dst_label")


def link_rows(links: DataFrame, held: DataFrame, required: DataFrame, edges: DataFrame) -> DataFrame:
    """The first rows of each question that meet all its links together; a written table."""
    found = conjunctive.matched(links, held, edges, required)
    label = links.select("qid", F.col("source").alias("name"), F.col("src_label").alias("label")).union(links.select("qid", "target", "dst_label")).distinct()
    each = found.select("qid", "ord", F.explode("ids").alias("name", "element_id")).join(label, ["qid", "name"])
    rows = kept(each.groupBy("qid", "ord").agg(F.sort_array(F.collect_list(F.struct("name", "label", "element_id"))).alias("nodes")))  # a question's variables
    discarded(found)
    return rows


def _both_ways(running: DataFrame, asked: DataFrame, held: DataFrame, context_held: DataFrame, required: DataFrame, edges: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``link_rows`` of ``running`` with free ends held to context, and of ``asked`` without, matched together: what the driver plans and keeps is that of one search."""
    key = T.StructType().add("way", T.IntegerType()).add("qid", asked.schema["qid"].dataType)
    told = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    of_way = lambda rows, n: rows.withColumn("qid", F.to_json(F.struct(F.lit(n).alias("way"), "qid"), told))
    links = of_way(running, 0).unionByName(of_way(asked, 1))
    ends = of_way(held.unionByName(context_held), 0).unionByName(of_way(held, 1))
    rows = hold(link_rows(links, ends, of_way(required, 0).unionByName(of_way(required, 1)), edges)).withColumn("key", F.from_json("qid", key, told))
    return tuple(rows.where(F.col("key.way") == n).select("key.qid", "ord", "nodes") for n in (0, 1))


def written_links(questions: DataFrame, valid: DataFrame, planner: Provider, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, errors): links between a question's entities as a provider writes them, and qid, error where it wrote none that can run.

    ``planner`` gives JSON with links of source, target (ids of entities) and type.
    """
    told = kept(called(questions, "qid", "question", planner, spread=True).withColumn("read", F.from_json("value", WRITTEN)))
    each = told.select("qid", F.posexplode("read.links").alias("ord", "x")).select("qid", "ord", F.col("x.source").alias("source_id"), F.col("x.target").alias("target_id"), F.col("x.type").alias("type"))
    links = kept(decompose.valid_links(each, valid, relations))
    unknown = each.join(links.select("qid", "ord"), ["qid", "ord"], "left_anti").groupBy("qid").agg(F.min_by("type", "ord").alias("wrong"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("read.links").isNull(), "SyntaxError: not a pattern").when(F.col("wrong").isNotNull(), F.concat(F.lit("Invalid: no such relation: "), "wrong"))
    errors = told.join(unknown, "qid", "left").select("qid", error.alias("error")).where("error IS NOT NULL")
    return links.join(errors, "qid", "left_anti"), errors


def adjacent(edges: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """element_id, and the first ``limit`` edges by ids at it on either side.

    Edges are ranked by node before the shuffle too, so those of a hub never meet in one task; what follows reads ``2 * limit`` edges a node at most.
    """
    edge = edges.select("type", "src_label", "src_id", "dst_label", "dst_id").distinct()
    out = None
    for side in ("src_id", "dst_id"):
        rank = F.row_number().over(Window.partitionBy(side).orderBy(*_EDGE_ORDER))
        one = edge.withColumn("n", rank).where(F.col("n") <= limit).select(F.col(side).alias("element_id"), *edge.columns)
        out = one if out is None else out.union(one)
    return out


_EDGE_ORDER = ["src_id", "dst_id", "type", "src_label", "dst_label"]


def neighbour_rows(anchors: DataFrame, near: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """The first edges by ids at a question's anchors (qid, element_id), on either side. near: what ``adjacent`` gives, for at least ``limit``."""
    found = anchors.select("qid", "element_id").distinct().join(near, "element_id").drop("element_id").distinct()
    rows = found.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(*_EDGE_ORDER))).where(F.col("ord") <= limit)
    node = lambda name, side: F.struct(F.lit(name).alias("name"), F.col(f"{side}_label").alias("label"), F.col(f"{side}_id").alias("element_id"))
    return rows.select("qid", "ord", F.array(node("source", "src"), node("target", "dst")).cast(NODES).alias("nodes"))


def _first_nodes(found: DataFrame, most: int = CONTEXT_NODES) -> DataFrame:
    """The best nodes of each question: qid, element_id, score."""
    best = found.groupBy("qid", "element_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "element_id"))
    return best.withColumn("n", rank).where(F.col("n") <= most).drop("n")


def answered(
    questions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    decomposer: Provider,
    reviewer: Provider | None = None,
    context: Callable[[DataFrame], DataFrame] | None = None,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
    generalized: Callable[[DataFrame], DataFrame] | None = None,
    planner: Provider | None = None,
    writer: Provider | None = None,
) -> DataFrame:
    """qid, question, attempt, n_entry, n_context, n_rows, rounds, verdict_ok, error, citations, answer: what became of each question.

    questions: qid, question. nodes: element_id, label, labels, props; edges: type, src_label, src_id, dst_label, dst_id.
    ``decomposer`` gives a question's graph as JSON, ``planner`` the links to match instead of that graph's. ``lookup`` finds entities that neither a key nor a
    property does; ``generalized`` gives entry nodes (qid, element_id, score) to questions that then have none; ``context`` gives them for all questions.
    ``reviewer`` reads a summary of the rows; nothing written is a good verdict. ``writer`` reads the question with its rows and sources, or with what went
    wrong, and writes the answer.

    Attempts: ``intersection``: all the question's links together, from its entry nodes, other variables held to its context nodes of their
    label; it needs context nodes, if there is ``context``. By route then ``context_explore`` (edges at context nodes; without entry nodes) or ``fallback`` (the links from entry nodes
    alone, or else edges at entry nodes; after no rows, or a pattern that can't run; the links alone are matched beside the first attempt, for all questions at once). An entity that was asked for and isn't there gives its links no rows. After a poor verdict
    ``reformulation``: first the links from entry nodes alone, then edges at entry and context nodes; after both, the rows stand. A round without rows changes nothing.
    """
    spark = questions.sparkSession
    held_tables: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held_tables.append(made := df if hasattr(df, "scratch_path") else kept(df))
        return made

    qid_type = questions.schema["qid"].dataType
    none = spark.createDataFrame([], "qid string, element_id string, score double").select(F.col("qid").cast(qid_type), "element_id", "score")
    entities, links = decompose.question_graph(hold(called(questions, "qid", "question", decomposer, spread=True)))
    valid = hold(decompose.valid_entities(entities, catalog.entities(spark)))
    wanted = hold(decompose.normalized_entities(valid))
    asked, errors = decompose.valid_links(links, valid, catalog.relations(spark)), spark.createDataFrame([], "qid string, error string").select(F.col("qid").cast(qid_type), "error")
    if planner is not None:
        asked, errors = written_links(questions, valid, planner, catalog.relations(spark))
    asked, errors = hold(asked_links(asked)), hold(errors)
    matches = hold(link.linked(wanted, nodes, catalog.property_lookups(spark), lookup))
    entry = link.entry_nodes(matches, wanted).select("qid", "element_id")
    if generalized is not None:
        entry = entry.unionByName(_first_nodes(generalized(questions.join(entry.select("qid").distinct(), "qid", "left_anti"))).select("qid", "element_id"))
    entry = hold(entry)
    around = hold(_first_nodes(context(questions)) if context is not None else none)

    held = hold(matches.select("qid", F.col("id").alias("var"), "element_id").distinct())
    required = hold(link.looked_up(wanted, catalog.property_lookups(spark)).select("qid", F.col("id").alias("var")))
    variables = asked.select("qid", F.col("source").alias("var"), F.col("src_label").alias("label")).union(asked.select("qid", "target", "dst_label")).distinct()
    free = variables.join(held.select("qid", "var").union(required).distinct(), ["qid", "var"], "left_anti")
    around_labels = around.join(nodes.select("element_id", F.explode("labels").alias("label")), "element_id").select("qid", "label", "element_id")
    context_held = free.join(around_labels, ["qid", "label"]).select("qid", "var", "element_id")

    number = lambda rows, name: rows.groupBy("qid").agg(F.count("*").alias(name))
    state = questions.join(number(entry, "n_entry"), "qid", "left").join(number(around, "n_context"), "qid", "left").join(number(asked, "n_links"), "qid", "left").join(errors, "qid", "left")
    state = state.fillna(0, ["n_entry", "n_context", "n_links"]).withColumn("attempt", F.lit("intersection"))
    ready = (F.col("n_entry") > 0) & (F.lit(context is None) | (F.col("n_context") > 0)) & ((F.col("n_links") > 0) | F.col("error").isNotNull())
    state = state.withColumn("query", F.when(ready, "links"))
    state = hold(state.withColumn("route", routing.after_planning(F.col("query"), F.col("attempt"), F.col("n_entry"), F.col("n_context"))))

    of = lambda rows, ids: rows.join(ids.select("qid"), "qid", "left_semi")
    running = state.where("route = 'run' AND error IS NULL")
    first, relaxed_rows = _both_ways(of(asked, running), asked, held, context_held, required, edges, hold)
    found = state.join(number(first, "n_rows"), "qid", "left").fillna(0, ["n_rows"])
    after = routing.after_execution(F.col("error"), F.col("attempt"), F.col("n_rows"))
    found = hold(found.withColumn("route", F.when(F.col("route") == "run", F.when(after == "retry", "fallback").otherwise(after)).otherwise(F.col("route"))))
    near = hold(adjacent(edges))
    retried = found.where("route = 'fallback'")
    relaxed = hold(of(relaxed_rows, retried))
    second = relaxed.unionByName(neighbour_rows(of(entry, retried).join(relaxed.select("qid").distinct(), "qid", "left_anti"), near))
    third = neighbour_rows(of(around, found.where("route = 'context_explore'")), near)
    rows = hold(first.withColumn("attempt", F.lit("intersection")).unionByName(second.withColumn("attempt", F.lit("fallback"))).unionByName(third.withColumn("attempt", F.lit("context_explore"))))

    verdicts = rows.select("qid").distinct().withColumn("verdict_ok", F.lit(True)) if reviewer is None else hold(_reviewed(rows, nodes, reviewer))
    rounds = spark.createDataFrame([], "qid string, round int").select(F.col("qid").cast(qid_type), "round")
    for nth in (1, 2) if reviewer is not None else ():
        poor = hold(verdicts.where(routing.after_evaluation(F.col("verdict_ok")) == "reformulate").select("qid"))
        if poor.isEmpty():
            break
        rounds = rounds.unionByName(poor.select("qid", F.lit(nth).alias("round")))
        again = of(relaxed_rows, poor) if nth == 1 else neighbour_rows(of(entry.unionByName(around.select("qid", "element_id")), poor), near)
        again = hold(again.withColumn("attempt", F.lit("reformulation")))
        rows = hold(rows.join(again.select("qid").distinct(), "qid", "left_anti").unionByName(again))
        fresh = hold(_reviewed(of(rows, again.select("qid").distinct()), nodes, reviewer))
        verdicts = hold(verdicts.join(fresh.select("qid"), "qid", "left_anti").unionByName(fresh))
    # What is poor after the last round stands.
    last = rows.groupBy("qid").agg(F.first("attempt").alias("reached"), F.count("*").alias("n_rows"))
    out = found.select("qid", "question", "n_entry", "n_context", "error", F.col("route").alias("planned")).join(last, "qid", "left").join(rounds.groupBy("qid").agg(F.max("round").alias("rounds")), "qid", "left")
    made = F.when(F.col("planned").isin("abort", "fallback", "context_explore"), F.col("planned")).otherwise("intersection")
    wrong = F.when(F.col("planned") == "abort", F.coalesce("error", F.lit(NO_ENTRY))).when(F.col("planned") == "answer", F.col("error"))
    out = out.select("qid", "question", F.coalesce("reached", made).alias("attempt"), "n_entry", "n_context", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("rounds", F.lit(0)).alias("rounds"), (F.coalesce("n_rows", F.lit(0)) > 0).alias("verdict_ok"), wrong.alias("error"))
    out = out.join(cited(rows, nodes), "qid", "left")
    if writer is None:
        out = kept(out.withColumn("answer", F.lit(None).cast("string")))
    else:
        state = hold(out)
        told = called(synthesis(state, _told(rows, nodes, answer.SUMMARY_ROWS)), "qid", "text", writer, spread=True)
        out = kept(state.join(told.select("qid", F.col("value").alias("answer")), "qid", "left"))
    discarded(*held_tables)
    return out


def synthesis(state: DataFrame, told: DataFrame) -> DataFrame:
    """qid, text: what an answer is written from: the question with its rows and sources, or that there are none, or what went wrong."""
    rows = state.join(told, "qid", "left")
    data = F.when(F.length("told") > DATA_LENGTH, F.concat(F.substring("told", 1, DATA_LENGTH), F.lit("\n...[truncated]"))).otherwise(F.col("told"))
    sources = F.when(F.size("citations") > 0, F.concat(F.lit("\nSources:\n"), F.array_join("citations", "\n"))).otherwise("")
    question = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")))
    text = F.when(F.col("error").isNotNull(), F.concat(question, F.lit("\nNote: "), "error")).when(F.col("n_rows") == 0, F.concat(question, F.lit("\nNo rows were found."))).otherwise(F.concat(question, F.lit("\nData:\n"), data, sources))
    return rows.select("qid", text.alias("text"))


def _named(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, ord, name, and the node's labels and props."""
    each = rows.select("qid", "ord", F.explode("nodes").alias("n")).select("qid", "ord", "n.*")
    return each.join(nodes.select("element_id", "label", "labels", "props"), ["label", "element_id"])


def _told(rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """qid, told: the first rows of each question as lines of JSON."""
    first = _named(rows.where(F.col("ord") <= most), nodes)
    lines = answer.summary(_row_maps(first), most=most)
    return lines.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), "\n").alias("told"))  # the first rows


def _row_maps(named: DataFrame) -> DataFrame:
    """qid, ord, nodes: a map from a row's names to their nodes."""
    entries = F.collect_list(F.struct("name", F.struct("labels", "props").alias("node")))  # a pattern's variables
    return named.groupBy("qid", "ord").agg(F.map_from_entries(entries).alias("nodes"))


def _reviewed(rows: DataFrame, nodes: DataFrame, reviewer: Provider) -> DataFrame:
    return called(_told(rows, nodes, 8), "qid", "told", reviewer, spread=True).select("qid", routing.verdict_ok(F.col("value")).alias("verdict_ok"))


def cited(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, citations: the titles or ids of the documents among a question's rows, sorted."""
    ends = rows.select("qid", F.explode("nodes").alias("e")).select("qid", "e.label", "e.element_id")
    documents = ends.where("label = 'Document'").distinct().join(nodes.select("element_id", "label", "props"), ["label", "element_id"])
    title = F.coalesce(F.nullif(F.try_element_at("props", F.lit("document_title")), F.lit("")), F.col("element_id"))
    return documents.groupBy("qid").agg(F.sort_array(F.collect_set(title)).alias("citations"))  # ROW_LIMIT rows at most
