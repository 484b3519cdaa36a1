"""Registered queries of single functions and file formats: inputs by case, with what each case must give stated as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.functions import language, text, titles
from quillgraph.operators import answer, chat, emit, graph, parse
from quillgraph.operators.cut import scratch
from quillgraph.plans import patterns
from quillgraph.queries import _t, registered
from quillgraph.sources import files


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _cases(name: str, function: Callable[[Column], Column], *cases: tuple[str | None, str | None]) -> None:
    """A query over all orders: each has a case's input; ``function`` of it, as text, must be the case's output."""
    listed = ", ".join(_literal(out) for _, out in cases)

    def query(spark: SparkSession, sf: str) -> DataFrame:
        given = F.element_at(F.array(*(F.lit(x).cast("string") for x, _ in cases)), (F.col("o_orderkey") % len(cases) + 1).cast("int"))
        rows = _t(spark, sf, "orders").select("o_orderkey", given.alias("given"))
        return rows.select("o_orderkey", function(F.col("given")).cast("string").alias("value"))

    query.__name__ = name
    registered(f"SELECT o_orderkey, ([{listed}])[1 + CAST(o_orderkey % {len(cases)} AS INTEGER)] AS value FROM orders")(query)


_SETTINGS = """('company_embeddings', 1, 0.35), ('legalparty_embeddings', 1, 0.35), ('institution_embeddings', 1, 0.3), ('legalact_embeddings', 2, 0.3),
  ('document_embeddings', 3, 0.25), ('section_embeddings', 3, 0.25), ('tender_embeddings', 2, 0.28), ('contract_embeddings', 2, 0.28), ('penalty_embeddings', 1, 0.32), ('award_embeddings', 2, 0.28)"""
_bar = lambda c: F.array_join(c, "|")
_fields = lambda s, *names: F.concat_ws("|", *(s[n] for n in names))
_act = lambda s: F.when(s.isNotNull(), _fields(s, "act_type", "act_number", "act_year"))

_cases("original_spans", text.strip_original, ("a <orig>x</orig> b", "a  b"), ("none", "none"), ("<orig>l\nm</orig>", ""), (None, ""))
_cases("page_artifacts", text.strip_page_artifacts, ("<header>h</header>x<page_start>2</page_start>\n---\ny", "x\n\ny"), ("a\n\n\n\nb", "a\n\nb"), ("<page_metadata>m</page_metadata>z", "z"))
_cases("number_words", text.number_from_word, ("twelve", "12"), ("7", "7"), ("Fifty", "50"), ("zz", None))
_cases("integers_or_words", text.integer_or_word, (" 12 ", "12"), ("Three", "3"), ("x", None))
_cases("act_keys", lambda c: _act(text.act_key(c)), ("Decree-46-2025", "Decree|46|2025"), ("Decree-x-2025", None), ("Decree-46", None))
_cases("key_parts", lambda c: F.concat_ws("|", text.key_parent(c), text.key_index(c)), ("Decree-46-2025-3", "Decree-46-2025|3"), ("Law-9-x", "Law-9"))
_cases("penalty_ids", lambda c: text.penalty_id(c, F.lit("Fine"), F.lit("late payment of the fees")), ("Acme Co", "acme_co_fine_late_payment_of_the_"), (None, "_fine_late_payment_of_the_"))
_cases("name_candidates", lambda c: _bar(text.lookup_candidates(c, "normalized_name")), ("Al-Watan Company", "al-watan company|watan company|watan-company"), ("Plain", "plain"))
_cases("id_candidates", lambda c: _bar(text.lookup_candidates(c, "tender_id")), (" T-7 ", "t-7"), ("", ""))
_cases("digits", text.digits_only, ("No. 46/2", "462"), ("none", None))
_cases("act_references", lambda c: _act(text.act_reference(c)), ("see decree no 46 of 2025", "Decree|46|2025"), ("Ministerial Resolution 5/1999", "MinisterialResolution|5|1999"), ("nothing", None))
_cases("query_bodies", text.query_body, ("```cypher\nMATCH (n)\n// c\n\nRETURN n\n```", "MATCH (n)\nRETURN n"), ("RETURN 1", "RETURN 1"))
_cases("directions", text.relation_directions, ("(i:Institution)-[r:IMPOSED_BY]->(p:Penalty)", "(p:Penalty)-[r:IMPOSED_BY]->(i:Institution)"), ("(p:Penalty)-[:IMPOSED_ON]->(c:Company)", "(p:Penalty)-[:IMPOSED_ON]->(c:Company)"))
_cases("pascal_cases", text.pascal_case, ("COURT_ROOM", "CourtRoom"), ("role", "Role"))
_cases("first_values", lambda c: text.first_filled(c, F.lit("rest")), ("", "rest"), (None, "rest"), ("x", "x"))
_cases("languages", lambda c: F.concat_ws("|", language.normalize_language(c), language.display_name(c)), (" EN-us", "en|English"), ("fr", "it|Italian"), (None, "it|Italian"), ("es", "es|Spanish"))
_cases("detectable", language.should_detect, ("short text", "false"), ("this is a message of more than eight words and of enough characters", "true"), ("averyveryveryveryverylongsinglewordwithoutanyspacesatall", "false"))
_cases("language_switches", lambda c: language.explicit_switch(c, F.lit("it")), ("please reply in English", "en"), ("escribe en español", "es"), ("rispondi in italiano", None), ("what is the penalty", None))
_cases("draft_requests", language.is_generation_request, ("generami un atto di opposizione", "true"), ("drafta", "true"), ("crea una lista", "false"))
_cases("placeholders", lambda c: F.concat_ws("|", *(language.field_or_placeholder(c, "Court", x) for x in ("it", "en", "es", "fr"))), (" ", "[DA COMPILARE] (Court)|[TO BE COMPLETED] (Court)|[COMPLETAR] (Court)|[DA COMPILARE] (Court)"), ("Rome ", "Rome|Rome|Rome|Rome"))
_cases("case_fields", lambda c: _bar(F.map_values(language.case_details(c))), ('```json\n{"court": "Roma", "amount": 5}\n```', "|||Roma|5||"), ("no json", "||||||"), ('{"plaintiff": "A", "date": null}', "A||||||"))
_cases("unclear_switches", lambda c: F.concat_ws("|", language.unclear_switch(c), language.switch_reply(c, F.lit("it"))), ("EN.", "false|en"), ("no", "false"), ("it", "false"))
_cases("article_numbers", lambda c: titles.article_number(titles.clean_title(c)), ("Article Five", "5"), ("Article (12)", "12"), ("Schedule (A)", None))
_cases("article_versions", lambda c: titles.article_version(titles.clean_title(c)), ("Text After Amendment", "After"), ("Article Text Before Amendment", "Before"), ("Notice", None))
_cases("metadata_blocks", lambda c: F.concat_ws("|", F.try_element_at(parse.document_metadata(c), F.lit("document_id")), F.try_element_at(parse.document_metadata(c), F.lit("language"))), ("<document_metadata>\ndocument_id: g-1\nlanguage: en\n# no\n</document_metadata>\nx", "g-1|en"), ('<document_metadata>{"document_id": "g-2", "language": "es"}</document_metadata>', "g-2|es"))
_cases("verdicts", lambda c: _verdict(c), ("POOR\nfew rows", "false"), (" ok", "true"), (None, "true"), ("poor", "false"))


def _verdict(c: Column) -> Column:
    from quillgraph.plans.routing import verdict_ok

    return verdict_ok(c)


# -- emission, schema ---------------------------------------------------------------


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    found = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("n"), "s_nationkey").alias("normalized_name"), F.col("s_name").alias("name"))).alias("institutions"), F.array(F.struct(F.concat(F.lit("m"), "s_suppkey").alias("meeting_id"), F.concat(F.lit("Company "), "s_nationkey").alias("company_name"), F.array(F.concat(F.lit("r"), "s_suppkey"), F.lit("r0")).alias("resolutions"))).alias("meetings")))
    schema = emit.schema()["entities"].dataType
    return _t(spark, sf, "supplier").select(F.lit("g").alias("document_id"), F.concat(F.lit("k"), "s_suppkey").alias("chunk_id"), F.from_json(found, schema).alias("entities"))


@registered("""SELECT 'k' || s_suppkey AS chunk_id, 'Institution' AS label, 'n' || s_nationkey AS id, 'name=' || s_name AS props FROM supplier
UNION ALL SELECT 'k' || s_suppkey, 'Meeting', 'm' || s_suppkey, '' FROM supplier""")
def emit_nodes(spark: SparkSession, sf: str) -> DataFrame:
    props = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return emit.nodes(_extracted(spark, sf)).select("chunk_id", "label", graph.node_id().alias("id"), props.alias("props"))


@registered("""SELECT 'k' || s_suppkey AS chunk_id, 'HOLDS_MEETING' AS type, 'Company' AS src_label, 'company-' || s_nationkey AS src_id, 'Meeting' AS dst_label, 'm' || s_suppkey AS dst_id FROM supplier
UNION ALL SELECT 'k' || s_suppkey, 'PASSES_RESOLUTION', 'Meeting', 'm' || s_suppkey, 'Resolution', r FROM (SELECT s_suppkey, unnest(['r' || s_suppkey, 'r0']) AS r FROM supplier)""")
def emit_links(spark: SparkSession, sf: str) -> DataFrame:
    return emit.edges(_extracted(spark, sf)).select("chunk_id", "type", "src_label", graph.node_id("src_key").alias("src_id"), "dst_label", graph.node_id("dst_key").alias("dst_id"))


@registered("""SELECT 'k' || s_suppkey AS chunk_id, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 2 END AS n_entities, 2 AS n_counted FROM supplier""")
def entity_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Some chunks have two sections besides, a kind that a load's log doesn't count."""
    section = F.from_json(F.lit('[{"title": "a"}, {"title": "b"}]'), emit.schema()["entities"].dataType["sections"].dataType)
    found = _extracted(spark, sf).withColumn("entities", F.col("entities").withField("sections", F.when(F.substring("chunk_id", 2, 9).cast("int") % 3 == 0, section)))
    return emit.entity_totals(found)


@registered("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'AWARDED_TO' WHEN 1 THEN 'REMOVED_FROM_TENDER' ELSE 'AWARD_OF' END AS type FROM orders WHERE o_orderkey % 5 IN (0, 1, 2)""")
def chosen_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Links between three chosen labels: of those that orders stand for, one leaves them and one goes the wrong way round."""
    asked = [("Award", "AWARDED_TO", "Company"), ("Tender", "REMOVED_FROM_TENDER", "Company"), ("Award", "AWARD_OF", "Tender"), ("Award", "RESULTS_IN_CONTRACT", "Contract"), ("Tender", "AWARD_OF", "Award")]
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in asked)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    links = _t(spark, sf, "orders").select("o_orderkey", pick(0).alias("src_label"), pick(1).alias("type"), pick(2).alias("dst_label"))
    rules = graph.strict_relations(catalog.relations(spark), ["Award", "Company", "Tender"])
    return graph.allowed(links, rules).select("o_orderkey", "type")


@registered("""
WITH i(n, index) AS (VALUES (0, 'company_embeddings'), (1, 'document_embeddings'), (2, 'penalty_embeddings'), (3, 'topic_embeddings')),
s(index, k, min_score) AS (VALUES RULES)
SELECT vec_id, index, coalesce(k, 3) AS k, CAST(min_score AS DOUBLE) AS min_score FROM embeddings JOIN i ON n = vec_id % 4 LEFT JOIN s USING (index)""".replace("RULES", _SETTINGS))
def vector_settings(spark: SparkSession, sf: str) -> DataFrame:
    """What a search of each vector's index keeps: its own number and least score, or the default number and no bound."""
    names = F.array(*map(F.lit, ("company_embeddings", "document_embeddings", "penalty_embeddings", "topic_embeddings")))
    rows = _t(spark, sf, "embeddings").select("vec_id", F.element_at(names, (F.col("vec_id") % 4 + 1).cast("int")).alias("index"))
    return rows.join(F.broadcast(catalog.vector_settings(spark)), "index", "left").select("vec_id", "index", F.coalesce("k", F.lit(catalog.DEFAULT_K)).alias("k"), "min_score")


# -- answers, anchors -----------------------------------------------------------------


@registered("""
WITH r AS (SELECT o_custkey AS qid, o_orderkey AS ord, '{"flag":"' || o_orderstatus || '"}' AS json FROM orders)
SELECT qid, ord, json FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ord) <= 5""")
def row_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("ord"), F.create_map(F.lit("flag"), "o_orderstatus", F.lit("none"), F.lit(None).cast("string")).alias("props"))
    return answer.summary(rows).select("qid", "ord", "json")


@registered("""
SELECT l_orderkey AS qid, l_returnflag AS title, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL""")
def distinct_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("title"), F.lit("d").alias("document_title"), F.lit("text").alias("text"), F.col("l_linenumber").alias("ord"))
    return answer.result_sections(rows).select("qid", "title", "ord")


@registered("""SELECT o_orderkey, '- Order,Sale ' || o_orderkey || ' [a, b] score=' || CASE WHEN o_orderkey % 2 = 0 THEN '0.5000' ELSE '0.0000' END AS line FROM orders""")
def context_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select("o_orderkey", F.array(F.lit("Order"), F.lit("Sale")).alias("labels"), F.col("o_orderkey").cast("string").alias("element_id"), F.array(F.lit("a"), F.lit("b")).alias("sources"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).alias("score"))
    return answer.node_lines(rows, with_score=True).select("o_orderkey", "line")


@registered("""
WITH e AS (SELECT o_custkey AS qid, 'e' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS element_id FROM orders), c AS (SELECT o_custkey AS qid, 'c' || o_orderkey AS element_id, o_totalprice AS score FROM orders)
SELECT qid, 'entry' AS kind, element_id FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY element_id) <= 8
UNION ALL SELECT qid, 'context', element_id FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, element_id) <= 6""")
def anchor_nodes(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders")
    entry = orders.select(F.col("o_custkey").alias("qid"), F.concat(F.lit("e"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("element_id"))
    around = orders.select(F.col("o_custkey").alias("qid"), F.concat(F.lit("c"), "o_orderkey").alias("element_id"), F.col("o_totalprice").alias("score"))
    first, second = patterns.anchors(entry, around)
    return first.select("qid", F.lit("entry").alias("kind"), "element_id").union(second.select("qid", F.lit("context"), "element_id"))


@registered("""SELECT conv_id, turn FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def last_answers(spark: SparkSession, sf: str) -> DataFrame:
    return chat.last_answers(_t(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn")


@registered("""SELECT event_id FROM events WHERE NOT ts < TIMESTAMP '2024-01-15 00:00:00'""")
def cache_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    cache = _t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("expiry"))
    return chat.cache_cleanup(cache, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("event_id")


# -- files ------------------------------------------------------------------------------


@registered("""SELECT 'node' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS other FROM customer UNION ALL SELECT 'edge', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders""")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    """Graph records written as JSON lines and read back."""
    key = lambda c: F.create_map(F.lit("id"), F.col(c).cast("string"))
    nodes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.lit("Customer").alias("label"), key("c_custkey").alias("key"), F.create_map(F.lit("name"), "c_name").alias("properties"))
    end = lambda label, c: F.struct(F.lit(label).alias("label"), key(c).alias("key"))
    edges = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("PLACED_BY").alias("type"), end("Order", "o_orderkey").alias("src"), end("Customer", "o_custkey").alias("dst"), F.create_map().cast("map<string,string>").alias("properties"))
    path = scratch(spark)
    files.write_graph(nodes, edges, path)
    nodes, edges = files.graph_records(spark, path)
    return nodes.select(F.lit("node").alias("kind"), F.col("key")["id"].alias("id"), F.col("properties")["name"].alias("other")).union(edges.select(F.lit("edge"), F.col("src.key")["id"], F.col("dst.key")["id"]))


@registered("""SELECT CAST(event_id AS VARCHAR) AS event, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' [' || event_type || '] ' || event_id || CASE WHEN user_id % 2 = 0 THEN ' | ' || user_id ELSE '' END AS line FROM events""")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), F.col("event_id").cast("string").alias("message"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("detail"))
    path = scratch(spark)
    files.append_log(rows, path)
    return spark.read.parquet(path).select(F.regexp_extract("line", r"\] (\d+)", 1).alias("event"), "line")


@registered("""SELECT count(*) AS total_queries, count(*) FILTER (WHERE o_orderstatus = 'F') AS successful, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed FROM orders""")
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return files.batch_counts(_t(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("success")))


@registered("""SELECT CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS INTEGER) AS qid, c_name AS question FROM customer""")
def question_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file of questions for each nation, in the three forms that a file may have."""
    names = F.sort_array(F.collect_list("c_name"))  # one file's questions
    rows = _t(spark, sf, "customer").groupBy("c_nationkey").agg(names.alias("q"))
    form = F.col("c_nationkey") % 3
    text = F.when(form == 0, F.to_json("q")).when(form == 1, F.to_json(F.struct(F.col("q").alias("questions")))).otherwise(F.to_json(F.struct(F.col("q").alias("queries"))))
    path = scratch(spark)
    rows.select("c_nationkey", text.alias("value")).write.partitionBy("c_nationkey").text(path)
    return files.questions(spark, path)


@registered("""
WITH l AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS seq, CASE WHEN c_custkey % 7 = 0 THEN 'blank' WHEN c_custkey % 11 = 0 THEN 'broken' WHEN c_custkey % 5 = 0 THEN 'edge' ELSE 'node' END AS kind FROM customer)
SELECT kind, c_custkey AS id FROM l WHERE kind IN ('edge', 'node') UNION ALL SELECT kind, count(*) FROM l WHERE kind = 'broken' GROUP BY kind""")
def ordered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of several files with nodes, edges, blanks and broken ones among them."""
    k = F.col("c_custkey")
    end = F.struct(F.lit("Company").alias("label"), F.create_map(F.lit("id"), k.cast("string")).alias("key"))
    node = F.to_json(F.struct(F.lit("Company").alias("label"), F.create_map(F.lit("id"), k.cast("string")).alias("key"), F.lit("no edge").alias("type")))
    edge = F.to_json(F.struct(F.lit("T").alias("type"), end.alias("from"), end.alias("to")))
    line = F.when(k % 7 == 0, "  ").when(k % 11 == 0, F.substring(node, 1, 20)).when(k % 5 == 0, edge).otherwise(node)
    path = scratch(spark)
    _t(spark, sf, "customer").select(line.alias("value")).repartition(3).write.text(path)
    nodes, edges, broken = files.graph_lines(spark, path)
    key = lambda c: F.col(c)["id"].cast("long").alias("id")
    return nodes.select(F.lit("node").alias("kind"), key("key")).union(edges.select(F.lit("edge"), key("src.key"))).union(broken.groupBy(F.lit("broken")).agg(F.count("*")))
