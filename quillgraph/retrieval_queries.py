"""Registered queries of conjunctive patterns and of stored indexes, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog, graph_queries, queries  # noqa: F401  its SQL is used again
from quillgraph.operators import graph_store, search, text_index, vector_index
from quillgraph.operators.cut import scratch
from quillgraph.plans import conjunctive, preparation
from quillgraph.queries import _t, registered
from quillgraph.sources import files

# -- conjunctive patterns ---------------------------------------------------------


def _trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents on customers (acts), customers and suppliers in nations (institutions)."""

    def edge(table: str, kind: str, src: str, src_id: str, dst: str, dst_id: str) -> DataFrame:
        name = lambda label, c: F.concat(F.lit(label[0].lower()), c)
        return _t(spark, sf, table).select(F.lit(kind).alias("type"), F.lit(src).alias("src_label"), name(src, src_id).alias("src_id"), F.lit(dst).alias("dst_label"), name(dst, dst_id).alias("dst_id"))

    orders = edge("orders", "HAS_CHUNK", "Document", "o_orderkey", "LegalAct", "o_custkey")
    acts = edge("customer", "ISSUED_BY", "LegalAct", "c_custkey", "Institution", "c_nationkey")
    return orders.union(acts).union(edge("supplier", "PART_OF", "Company", "s_suppkey", "Institution", "s_nationkey"))


#: Links of each kind of question: source, target, type, src_label, dst_label.
_DOC, _ISSUED, _SEAT = ("d", "a", "HAS_CHUNK", "Document", "LegalAct"), ("a", "i", "ISSUED_BY", "LegalAct", "Institution"), ("c", "i", "PART_OF", "Company", "Institution")
_KINDS = {0: [_DOC, _ISSUED], 1: [_ISSUED, _SEAT], 2: [_ISSUED, _SEAT], 3: [_DOC, _ISSUED, _SEAT], 4: [_DOC, _ISSUED], 5: [_DOC]}


@registered("""
WITH q AS (SELECT c_custkey AS qid, c_custkey % 6 AS kind FROM customer),
o AS (SELECT 'd' || o_orderkey AS d, 'l' || o_custkey AS a, o_custkey FROM orders), a AS (SELECT 'l' || c_custkey AS a, 'i' || c_nationkey AS i, c_custkey, c_nationkey FROM customer),
s AS (SELECT 'c' || s_suppkey AS c, s_suppkey, s_nationkey FROM supplier),
free AS (SELECT d, a, i FROM o JOIN a USING (a) ORDER BY d, a, i LIMIT 10),
m AS (
  SELECT qid, a || ' ' || d || ' ' || i AS row, [a, d, i] AS k FROM q JOIN a ON c_custkey = qid JOIN o USING (a) WHERE kind = 0
  UNION ALL SELECT qid, a || ' ' || i || ' ' || c, [a, i, c] FROM q JOIN a ON c_custkey = qid JOIN s ON s_nationkey = c_nationkey WHERE kind = 1
  UNION ALL SELECT qid, a || ' ' || i || ' ' || c, [a, i, c] FROM q JOIN a ON c_custkey = qid JOIN s ON s_nationkey = c_nationkey AND s_suppkey IN (qid % 10 + 1, qid % 7 + 1, qid % 3 + 1) WHERE kind = 2
  UNION ALL SELECT qid, i || ' ' || a || ' ' || c || ' ' || d, [i, a, c, d] FROM q JOIN a ON c_nationkey = qid % 25 JOIN o USING (a) JOIN s ON s_nationkey = c_nationkey WHERE kind = 3
  UNION ALL SELECT qid, d || ' ' || a || ' ' || i, [d, a, i] FROM q, free WHERE kind = 4),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k) AS ord FROM m)
SELECT qid, CAST(ord AS INTEGER) AS ord, row FROM n WHERE ord <= 10""")
def conjunctive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's question, of six kinds: links that share an act or an institution, held at one end, at both, in between, or nowhere.

    The last kind asks for an act that isn't there and has no rows.
    """
    asked = _t(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 6).alias("kind"))
    rules = [(k, i, *link) for k, links in _KINDS.items() for i, link in enumerate(links)]
    links = asked.join(F.broadcast(spark.createDataFrame(rules, "kind long, ord int, source string, target string, type string, src_label string, dst_label string")), "kind").drop("kind")
    act = asked.where("kind IN (0, 1, 2)").select("qid", F.lit("a").alias("var"), F.concat(F.lit("l"), "qid").alias("element_id"))
    seats = asked.where("kind = 2").select("qid", F.lit("c").alias("var"), F.explode(F.array(*(F.concat(F.lit("c"), F.col("qid") % n + 1) for n in (10, 7, 3)))).alias("element_id"))
    nation = asked.where("kind = 3").select("qid", F.lit("i").alias("var"), F.concat(F.lit("i"), F.col("qid") % 25).alias("element_id"))
    required = asked.where("kind = 5").select("qid", F.lit("a").alias("var"))
    found = conjunctive.matched(links, act.union(seats).union(nation), _trade_edges(spark, sf), required)
    order = F.when(F.col("kind") == 0, F.array(*map(F.lit, "adi"))).when(F.col("kind").isin(1, 2), F.array(*map(F.lit, "aic"))).when(F.col("kind") == 3, F.array(*map(F.lit, "iacd"))).otherwise(F.array(*map(F.lit, "dai")))
    told = found.join(asked, "qid").withColumn("row", F.array_join(F.transform(order, lambda v: F.try_element_at("ids", v)), " "))
    return told.select("qid", "ord", "row")


# -- stored vector index ------------------------------------------------------------


@registered(queries._VECTOR_SQL + "SELECT qid, element_id, index, source, round(score, 6) AS score FROM m")
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The exact search of a stored index has the rows of the search that compares everything."""
    nodes, asked = queries._vectors(spark, sf)
    index = vector_index.build(nodes, scratch(spark), buckets=8)
    return index.search(asked, queries._index_settings(spark), exact=True).withColumn("score", F.round("score", 6))


# -- stored full-text index -----------------------------------------------------------


def _asked_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), search.tokens("text").alias("terms"))


@registered(queries._SQL["fulltext_topk"])
def text_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of scoring every document, from a stored index that leaves out what can't be among the best."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), "text")
    return text_index.build(docs, scratch(spark)).search(_asked_texts(spark, sf)).withColumn("score", F.round("score", 4))


@registered(queries._SQL["fulltext_labels"])
def text_index_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), "text", F.array("lang").alias("labels"))
    return text_index.build(docs, scratch(spark)).search(_asked_texts(spark, sf), labels=["de", "fr"]).withColumn("score", F.round("score", 4))


# -- stored graph -------------------------------------------------------------------------


@registered("""
WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0))
SELECT 'Company' AS label, 'f' || c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN 'balance=' || CAST(c_acctbal AS VARCHAR) || ',' ELSE '' END || 'name=' || c_name || ',seen=' || CASE WHEN c_custkey % 2 = 1 THEN 'second' ELSE 'first' END AS told FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT 'Document', 'd' || o_orderkey, 'status=' || o_orderstatus FROM orders
UNION ALL SELECT 'ORDERED_BY', 'd' || o_orderkey || '>f' || o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'again=yes' ELSE '' END FROM e""")
def graph_store_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads, the second of every other firm and every third link: later values win, and links to firms that aren't there are dropped."""
    customers, orders = _t(spark, sf, "customer").where("c_custkey % 4 <> 0"), _t(spark, sf, "orders")
    id_of = lambda letter, c: F.concat(F.lit(letter), c)
    props = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))))
    firm = lambda seen, rows, **kv: rows.select(F.lit("Company").alias("label"), id_of("f", "c_custkey").alias("node_id"), props(name=F.col("c_name"), seen=F.lit(seen), **kv).alias("props"), F.lit(1).cast("long").alias("seq"))
    document = orders.select(F.lit("Document").alias("label"), id_of("d", "o_orderkey").alias("node_id"), props(status=F.col("o_orderstatus")).alias("props"), F.lit(1).cast("long").alias("seq"))
    link = lambda rows, p: rows.select(F.lit("ORDERED_BY").alias("type"), F.lit("Document").alias("src_label"), id_of("d", "o_orderkey").alias("src_id"), F.lit("Company").alias("dst_label"), id_of("f", "o_custkey").alias("dst_id"), p.alias("props"), F.lit(2).cast("long").alias("seq"))
    store = graph_store.GraphStore(spark, scratch(spark), 16)
    store.load(firm("first", customers).union(document), link(orders, F.create_map().cast("map<string,string>")), "one")
    store.load(firm("second", customers.where("c_custkey % 2 = 1"), balance=F.col("c_acctbal")), link(orders.where("o_orderkey % 3 = 0"), props(again=F.lit("yes"))), "two")
    told = F.array_join(F.transform(F.array_sort(F.map_keys("props")), lambda k: F.concat(k, F.lit("="), F.try_element_at("props", k))), ",").alias("told")
    return store.nodes().select("label", F.col("node_id").alias("id"), told).unionByName(store.edges().select(F.col("type").alias("label"), F.concat_ws(">", "src_id", "dst_id").alias("id"), told))


# -- preparation of questions and drafts ------------------------------------------------------


def _topic(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        n = int(t.rsplit("#", 1)[1])
        if n % 5 == 4:
            raise ValueError("no phrase")
        out.append("" if n % 5 == 3 else f" topic {n % 7} ")
    return out


def _topic_words(texts: list[str]) -> list[str]:
    return [f"{t}, , b,c,d" if t.startswith("topic") else "" for t in texts]


@registered("""
SELECT c_custkey AS qid, CASE WHEN c_custkey % 5 < 3 THEN 'topic ' || c_custkey % 7 ELSE c_name END AS phrase, CASE WHEN c_custkey % 5 < 3 THEN 'topic ' || c_custkey % 7 || ',b,c' ELSE '' END AS keywords FROM customer""")
def question_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases and keywords; where the provider fails or is silent, the question stands."""
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), "c_name")
    found = preparation.phrases(rows.select("qid", F.col("c_name").alias("question")), _by_number(_topic), _topic_words)
    return found.select("qid", "phrase", F.array_join("keywords", ",").alias("keywords"))


def _by_number(answer):
    """A provider that sees a customer's number, whatever its name is padded with."""
    return lambda texts: [x for t in texts for x in answer([f"#{int(t.rsplit('#', 1)[1])}"])]


def _labels_of(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        kind = int(t.split("Question: ", 1)[1].split("\n", 1)[0]) % 5
        if kind == 4:
            raise ValueError("no answer")
        out.append(['["Award", "Company", "Tender"]', "```json\n[\"Vote\"]\n```", "no list", '["Award", "Tender", "Nowhere"]'][kind])
    return out


def _types_of(texts: list[str]) -> list[str]:
    return ['["AWARD_OF"]' if "Company" in t.split("\n", 1)[0] and len(t.split("\n", 1)[0]) < 60 else "[]" for t in texts]


@registered("""
SELECT o_orderkey AS qid, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 25 END AS n_labels, CASE o_orderkey % 5 WHEN 0 THEN 'AWARD_OF' WHEN 1 THEN '' WHEN 3 THEN 'AWARD_OF' ELSE 'all' END AS types FROM orders""")
def schema_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and relation types for each question: picked, a label without relations, no list, an unknown label, and a provider that fails."""
    none = F.array().cast("array<string>")
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % 5).cast("string").alias("question"), none.alias("keywords"), none.alias("anchors"))
    found = preparation.chosen_schema(rows, _labels_of, _types_of)
    n_types = len({t for _, t, _ in catalog.RELATIONS})
    types = F.when(F.size("types") == n_types, "all").otherwise(F.array_join("types", ","))
    return found.select("qid", F.size("labels").alias("n_labels"), types.alias("types"))


def _details(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        out.append("I can't" if t.endswith("0") else '```json\n{"court": "Court of %s", "amount": ""}\n```' % t)
    return out


@registered("""
WITH r AS (SELECT c_custkey AS id, c_mktsegment || c_custkey % 10 AS message, (['en', 'es', 'it', 'fr'])[1 + CAST(c_custkey % 4 AS INTEGER)] AS lang FROM customer),
p AS (SELECT *, CASE lang WHEN 'en' THEN '[TO BE COMPLETED]' WHEN 'es' THEN '[COMPLETAR]' ELSE '[DA COMPILARE]' END AS mark FROM r)
SELECT id AS request_id, CASE WHEN message LIKE '%0' THEN mark || ' (tribunale / court)' ELSE 'Court of ' || message END AS court, mark || ' (importo / amount)' AS amount, CASE WHEN id % 3 = 0 THEN '[1] Part ' || id ELSE CASE lang WHEN 'en' THEN '(no sections retrieved from the knowledge base)' WHEN 'es' THEN '(ninguna seccion recuperada de la base de conocimiento)' ELSE '(nessuna sezione recuperata dalla knowledge base)' END END AS sections FROM p""")
def draft_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """Briefs of drafts in four languages, with details that are known, missing, or couldn't be read."""
    section = F.array(F.struct(F.concat(F.lit("Part "), "c_custkey").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source")))
    code = F.element_at(F.array(*map(F.lit, ("en", "es", "it", "fr"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.concat("c_mktsegment", F.col("c_custkey") % 10).alias("message"), code.alias("language"), F.when(F.col("c_custkey") % 3 == 0, section).alias("sections"))
    found = preparation.drafts(rows, _details, lambda texts: texts)
    part = lambda name: F.regexp_extract("draft", rf"(?m)^{name}: (.*)$", 1).alias(name)
    return found.select("request_id", part("court"), part("amount"), F.regexp_extract("draft", r"Sections:\n(.*)$", 1).alias("sections"))


# -- sinks ---------------------------------------------------------------------------------------


@registered("""SELECT 'counts' AS kind, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok FROM orders UNION ALL SELECT 'results', count(*), count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders""")
def batch_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A batch's answers and counts written as files and read back."""
    path = scratch(spark)
    files.write_report(_t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("success")), path)
    counts, results = files.report(spark, path)
    return counts.select(F.lit("counts").alias("kind"), F.col("total_queries").alias("n"), F.col("successful").alias("ok")).union(results.groupBy(F.lit("results").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("success").cast("long")).alias("ok")))
