"""Registered queries of questions, extraction and chat turns, each with the SQL that gives the same rows.

Customers stand for legal acts and orders for documents that have a chunk on them. Providers are small
deterministic functions of the texts they get.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.operators import answer, chat, decompose, extraction, link, search
from quillgraph.plans import questions
from quillgraph.queries import _t, registered

# -- questions ------------------------------------------------------------------


def _act_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customers, orders = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    text = lambda c: F.col(c).cast("string")
    acts = customers.select(F.concat(F.lit("c"), "c_custkey").alias("element_id"), F.lit("LegalAct").alias("label"), F.create_map(F.lit("act_type"), F.lit("Decree"), F.lit("act_number"), text("c_custkey"), F.lit("act_year"), F.lit("2025")).alias("props"))
    companies = customers.select(F.concat(F.lit("f"), "c_custkey"), F.lit("Company"), F.create_map(F.lit("normalized_name"), F.concat(F.lit("firm "), "c_custkey")))
    documents = orders.select(F.concat(F.lit("d"), "o_orderkey").alias("element_id"), F.lit("Document").alias("label"), F.create_map(F.lit("document_id"), text("o_orderkey"), F.lit("document_title"), F.concat(F.lit("Order "), "o_orderkey")).alias("props"))
    nodes = acts.union(companies).union(documents).withColumn("labels", F.array("label"))
    edges = orders.select(F.lit("HAS_CHUNK").alias("type"), F.lit("Document").alias("src_label"), F.concat(F.lit("d"), "o_orderkey").alias("src_id"), F.lit("LegalAct").alias("dst_label"), F.concat(F.lit("c"), "o_custkey").alias("dst_id"))
    return nodes, edges


def _decomposed(texts: list[str]) -> list[str]:
    """Of four kinds of questions: a linked act, an act alone, an unknown label, an act that isn't there."""
    out = []
    for text in texts:
        key = int(text.rsplit(" ", 1)[1])
        kind = key % 4
        act = {"id": "a", "label": "LegalAct", "properties": {"act_type": "Decree", "act_number": str(key if kind != 3 else -key), "act_year": "2025", "colour": "red"}}
        document = {"id": "b", "label": "Document", "properties": {"document_type": "order"}}
        company = {"id": "p", "label": "Company", "properties": {"name": f"Al-Nobody, {key}"}}
        empty = {"id": "q", "label": "Person", "properties": {"colour": "blue"}}
        nodes = [{"id": "x", "label": "Planet", "properties": {"name": "Mars"}}] if kind == 2 else [act, company, empty] if kind == 1 else [act, document]
        links = [{"source_id": "b", "target_id": "a", "type": "HAS_CHUNK"}, {"source_id": "a", "target_id": "b", "type": "HAS_CHUNK"}] if kind in (0, 3) else []
        out.append(json.dumps({"nodes": nodes, "relationships": links}))
    return out


def _poor_if_single(texts: list[str]) -> list[str]:
    return ["POOR\nonly one row" if "\n" not in t else "OK" for t in texts]


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("Which documents name customer "), "c_custkey").alias("question"))


def _written(texts: list[str]) -> list[str]:
    return ["from rows" if "\nData:\n" in t else "from a note" if "\nNote: " in t else "from nothing" for t in texts]


_LOOP = """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY 'd' || o_orderkey) AS n FROM orders),
c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY 'd' || o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 = 0),
m AS (SELECT c_custkey AS qid, c_custkey % 4 AS kind, (SELECT least(10, count(*)) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT least(10, count(*)) FROM c WHERE o_custkey = c_custkey) AS nc FROM customer),
s AS (SELECT *, kind IN (0, 1) OR qid % 8 IN (2, 7) AS runs, CASE WHEN nc > 0 THEN nc ELSE n END AS before FROM m),
r AS (SELECT qid, o_orderkey FROM s JOIN o ON o_custkey = qid AND o.n <= 10 WHERE runs AND nc < 2
      UNION ALL SELECT qid, o_orderkey FROM s JOIN c ON o_custkey = qid AND c.n <= 10 WHERE nc >= 2),
k AS (SELECT qid, count(*) AS n_rows, string_agg('Order ' || o_orderkey, ',' ORDER BY 'Order ' || o_orderkey) AS citations FROM r GROUP BY qid)
SELECT s.qid, CASE WHEN NOT runs THEN 'abort' WHEN before = 1 THEN 'reformulation' WHEN nc > 0 THEN 'intersection' WHEN kind = 2 THEN 'context_explore' ELSE 'fallback' END AS attempt,
  CAST(CASE WHEN kind IN (0, 1) OR qid % 8 = 7 THEN 1 ELSE 0 END AS BIGINT) AS n_entry, CAST(CASE WHEN s.qid % 8 = 2 THEN 1 ELSE nc END AS BIGINT) AS n_context,
  coalesce(n_rows, 0) AS n_rows, CASE WHEN NOT runs OR before <> 1 THEN 0 WHEN kind = 0 AND n > 1 THEN 1 ELSE 2 END AS rounds, coalesce(n_rows, 0) > 0 AS verdict_ok, coalesce(citations, '') AS citations,
  CASE WHEN NOT runs THEN 'from a note' WHEN n_rows > 0 THEN 'from rows' ELSE 'from nothing' END AS answer
FROM s LEFT JOIN k USING (qid)"""


@registered(_LOOP)
def question_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's question through decomposition, linking, context, patterns, review and an answer, by all routes.

    Linked acts are matched with the orders among their context (every third); acts alone fall back to their edges; unknown entities are explored from their
    context, if there is one; acts that aren't there have the entry nodes of a wider phrase, if there is one.
    """
    nodes, edges = _act_graph(spark, sf)
    orders = _t(spark, sf, "orders").where("o_orderkey % 3 = 0 AND o_custkey % 4 = 0").select(F.col("o_custkey").alias("qid"), F.concat(F.lit("d"), "o_orderkey").alias("element_id"), F.lit(0.5).alias("score"))
    act = lambda rows: rows.select("qid", F.concat(F.lit("c"), "qid").alias("element_id"), F.lit(0.5).alias("score"))
    context = lambda rows: orders.join(rows.select("qid"), "qid", "left_semi").unionByName(act(rows.where("qid % 8 = 2")))
    found = questions.answered(_questions(spark, sf), nodes, edges, _decomposed, _poor_if_single, context, generalized=lambda rows: act(rows.where("qid % 8 = 7")), writer=_written)
    return found.select("qid", "attempt", "n_entry", "n_context", "n_rows", "rounds", "verdict_ok", F.coalesce(F.array_join("citations", ","), F.lit("")).alias("citations"), "answer")


@registered("""
SELECT c_custkey AS qid, 'a' AS id, 'LegalAct' AS label, 'act_type=Decree,act_number=' || CASE c_custkey % 4 WHEN 3 THEN '-' ELSE '' END || c_custkey || ',act_year=2025' AS props FROM customer WHERE c_custkey % 4 <> 2
UNION ALL SELECT c_custkey, 'p', 'Company', 'normalized_name=nobody ' || c_custkey FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'b', 'Document', 'document_type=order' FROM customer WHERE c_custkey % 4 IN (0, 3)""")
def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown labels and properties are discarded, names made canonical, entities that lack their key kept as hints."""
    from quillgraph.operators.providers import called

    entities, _ = decompose.question_graph(called(_questions(spark, sf), "qid", "question", _decomposed))
    kept = decompose.normalized_entities(decompose.valid_entities(entities, catalog.entities(spark)))
    return kept.select("qid", "id", "label", F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("props"))


# What each customer's question links: from, type, to.
_LINKED = [("Document", "HAS_CHUNK", "Section"), ("Document", "HAS_CHUNK", "LegalAct"), ("Section", "HAS_CHUNK", "Document"), ("Penalty", "IMPOSED_ON", "Company"), ("Company", "IMPOSED_ON", "Penalty"), ("Document", "HAS_CHUNK", "Tender"), ("Document", "HAS_CHUNK", "Vote")]


def _links_asked(texts: list[str]) -> list[str]:
    out = []
    for text in texts:
        source, kind, target = _LINKED[int(text.rsplit(" ", 1)[1]) % len(_LINKED)]
        nodes = [{"id": "s", "label": source, "properties": {}}, {"id": "t", "label": target, "properties": {}}]
        out.append(json.dumps({"nodes": nodes, "relationships": [{"source_id": "s", "target_id": "t", "type": kind}, {"source_id": "s", "target_id": "nowhere", "type": kind}, {"source_id": "s", "target_id": "t", "type": ""}]}))
    return out


@registered("""
SELECT c_custkey AS qid, CASE WHEN c_custkey % 7 = 3 THEN 'IMPOSED_ON' ELSE 'HAS_CHUNK' END AS type, CASE WHEN c_custkey % 7 = 3 THEN 'Penalty' ELSE 'Document' END AS src_label,
  CASE c_custkey % 7 WHEN 0 THEN 'Section' WHEN 1 THEN 'LegalAct' WHEN 3 THEN 'Company' ELSE 'Tender' END AS dst_label FROM customer WHERE c_custkey % 7 IN (0, 1, 3, 5)""")
def question_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links match a rule whole: any target that the schema has for a type; the wrong way round, unknown targets and unknown ends are discarded."""
    from quillgraph.operators.providers import called

    entities, links = decompose.question_graph(called(_questions(spark, sf), "qid", "question", _links_asked))
    kept = decompose.valid_links(links, decompose.valid_entities(entities, catalog.entities(spark)), catalog.relations(spark))
    return kept.select("qid", "type", "src_label", "dst_label")


@registered("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ',' || p_name || ',x', ','), lambda s: trim(s)), lambda s: s <> '')[1:3], '|') AS keywords FROM part""")
def keyword_cap(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.concat("p_type", F.lit(", ,"), "p_brand", F.lit(","), "p_name", F.lit(",x"))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(decompose.keywords(listed), "|").alias("keywords"))


@registered("""
WITH e AS (SELECT DISTINCT l_orderkey AS qid, 'p' || p_partkey AS element_id FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = l_suppkey % 50 + 1)
SELECT qid, element_id, 'legalact:key' AS source FROM e""")
def legal_act_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Acts whose numbers are integers, asked for by text."""
    acts = _t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("element_id"), F.array(F.lit("LegalAct")).alias("labels"), F.lit("Decree").alias("act_type"), F.col("p_partkey").alias("act_number"), F.col("p_size").alias("act_year"))
    asked = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.lit("Decree").alias("act_type"), F.col("l_partkey").cast("string").alias("act_number"), (F.col("l_suppkey") % 50 + 1).cast("string").alias("act_year"))
    return link.legal_act_lookup(acts, asked).select("qid", "element_id", "source")


@registered("""
WITH m AS (SELECT l_orderkey AS qid, 'd' || l_orderkey AS element_id FROM lineitem WHERE l_linenumber % 2 = 1
           UNION ALL SELECT l_orderkey, 'f' || l_suppkey FROM lineitem JOIN customer ON c_custkey = l_suppkey WHERE l_linenumber % 2 = 0)
SELECT qid, element_id, CASE WHEN element_id LIKE 'd%' THEN 'Document' ELSE 'Company' END AS labels,
  CASE WHEN element_id LIKE 'd%' THEN 'btree:id_document' ELSE 'btree' END AS sources FROM m GROUP BY qid, element_id""")
def entry_links(spark: SparkSession, sf: str) -> DataFrame:
    """Lines ask by turns for their order by id and for a company by name; matches are merged by node."""
    nodes, _ = _act_graph(spark, sf)
    odd = F.col("l_linenumber") % 2 == 1
    props = F.when(odd, F.create_map(F.lit("document_id"), F.col("l_orderkey").cast("string"))).otherwise(F.create_map(F.lit("normalized_name"), F.concat(F.lit("FIRM "), "l_suppkey")))
    entities = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("id"), F.when(odd, "Document").otherwise("Company").alias("label"), props.alias("props"))
    entry = link.entry_nodes(link.linked(entities, nodes, catalog.property_lookups(spark), told=True), entities)
    return entry.select("qid", "element_id", F.array_join("labels", ",").alias("labels"), F.array_join("sources", ",").alias("sources"))


@registered("""
WITH t AS (SELECT c_custkey AS qid, 'Company' AS label FROM customer UNION SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Document' ELSE 'Asset' END FROM orders)
SELECT qid, string_agg(label, ',' ORDER BY label) AS labels FROM t GROUP BY qid""")
def question_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.array(F.lit("Company")).alias("labels"))
    rows = rows.union(_t(spark, sf, "orders").select("o_custkey", F.array(F.when(F.col("o_orderkey") % 2 == 0, "Document").otherwise("Asset"))))
    return link.collected_labels(rows).select("qid", F.array_join("labels", ",").alias("labels"))


@registered("""
WITH e AS (SELECT c_custkey AS qid, (['Resolution', 'Meeting', 'Asset', 'Company', 'Topic'])[1 + CAST(c_custkey % 5 AS INTEGER)] AS label FROM customer)
SELECT qid, label, CASE label WHEN 'Resolution' THEN 'legalact_embeddings' WHEN 'Company' THEN 'company_embeddings' WHEN 'Topic' THEN 'topic_embeddings' WHEN 'Meeting' THEN 'document_embeddings' END AS index FROM e""")
def label_index_map(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("Resolution", "Meeting", "Asset", "Company", "Topic"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    asked = _t(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), label.alias("label"))
    return link.vector_indexes(asked, catalog.label_indexes(spark)).select("qid", "label", "index")


@registered("""
WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM benchmark),
p AS (SELECT doc_id, lang, len(w) AS size, unnest(w) AS term FROM w),
tf AS (SELECT doc_id, lang, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, doc_id AS element_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
      FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN c WHERE lang IN ('de', 'fr') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, element_id) AS n FROM s)
SELECT qid, element_id, round(score, 4) AS score FROM r WHERE n <= 3""")
def fulltext_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are filtered before the limit."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), "text", F.array("lang").alias("labels"))
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), search.tokens("text").alias("terms"))
    return search.fulltext_lookup(docs, asked, labels=["de", "fr"]).withColumn("score", F.round("score", 4))


# -- answers ----------------------------------------------------------------------


@registered("""SELECT o_orderkey AS id, 'LegalAct' AS type, 'd' || o_orderkey AS source, CAST(o_orderkey AS VARCHAR) AS act_number, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '...' END AS preview,
  'act_number=' || o_orderkey || ',title=' AS summary FROM orders""")
def source_metadata(spark: SparkSession, sf: str) -> DataFrame:
    props = F.map_filter(F.create_map(F.lit("act_number"), F.col("o_orderkey").cast("string"), F.lit("text_en"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))), lambda k, v: v.isNotNull())
    node = F.struct(F.array(F.lit("LegalAct")).alias("labels"), F.concat(F.lit("d"), "o_orderkey").alias("element_id"), props.alias("props"))
    rows = answer.source_metadata(_t(spark, sf, "orders").select("o_orderkey", F.array(node).alias("nodes")))
    told = F.col("sources")[0]
    short = answer.node_summary(F.col("nodes")[0]["labels"], F.col("nodes")[0]["props"])
    text = F.array_join(F.transform(F.map_entries(short), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select(F.col("o_orderkey").alias("id"), told["type"].alias("type"), told["id"].alias("source"), told["act_number"].alias("act_number"), F.try_element_at(told, F.lit("text_preview")).alias("preview"), text.alias("summary"))


@registered("""
WITH r AS (SELECT o_custkey AS qid, o_orderkey AS ord, '{"a":{"labels":["Penalty"],"title":""' || ',"text_en":"' || o_orderstatus || '"},"d":{"labels":["Document"],"document_id":"' || o_orderkey || '","document_title":"Order \\"' || o_orderkey || '\\"","document_date":"' || CAST(o_orderdate AS DATE) || '"}}' AS json FROM orders),
s AS (SELECT *, row_number() OVER w AS n, sum(length(json)) OVER w AS total FROM r WINDOW w AS (PARTITION BY qid ORDER BY ord))
SELECT qid, ord, json FROM s WHERE n <= 8 AND total <= 700""")
def node_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of nodes, each told by its label, while all together are within a bound; the row that would pass it is left out."""
    node = lambda label, **kv: F.struct(F.array(F.lit(label)).alias("labels"), F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v))).alias("props"))
    key = F.col("o_orderkey").cast("string")
    document = node("Document", document_id=key, document_title=F.concat(F.lit('Order "'), key, F.lit('"')), document_date=F.to_date("o_orderdate").cast("string"), more=F.lit("untold"))
    nodes = F.create_map(F.lit("d"), document, F.lit("a"), node("Penalty", text_en=F.col("o_orderstatus"), name=F.lit(None).cast("string")))
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("ord"), nodes.alias("nodes"))
    return answer.summary(rows, most=8, length=700)


@registered("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE lang WHEN 'es' THEN '(ninguna seccion recuperada de la base de conocimiento)' WHEN 'en' THEN '(no sections retrieved from the knowledge base)' ELSE '(nessuna sezione recuperata dalla knowledge base)' END
  ELSE '[1] ' || CASE WHEN doc_id % 3 = 0 THEN 'Sezione 1' ELSE 'T' || doc_id END || CASE WHEN coalesce(source, '') <> '' THEN ' (Fonte: ' || source || ')' ELSE '' END
    || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || substring(text, 1, 600) || CASE WHEN length(text) > 600 THEN '...' ELSE '' END ELSE '' END
    || chr(10) || chr(10) || '[2] B' END AS block FROM documents""")
def section_blocks(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda title, text, source: F.struct(title.alias("title"), text.alias("text"), source.alias("source"))
    none = F.lit(None).cast("string")
    both = F.array(part(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T"), "doc_id")), F.col("text"), F.col("source")), part(F.lit("B"), none, none))
    rows = F.when(F.col("doc_id") % 5 != 0, both)
    return _t(spark, sf, "documents").select("doc_id", answer.section_block(rows, F.col("lang")).alias("block"))


# -- extraction ---------------------------------------------------------------------


def _parties(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        c = json.loads(t)
        out.append(json.dumps({"companies": [{"normalized_name": f"company-{c['nation']}", "name": c["name"], "legal_form": "llc"}]}))
    return out


def _commercial(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        c = json.loads(t)
        if c["key"] % 5 == 0:
            raise ValueError("no answer")
        out.append(json.dumps({"tenders": [{"tender_id": f"t{c['key']}", "issuer": "Central Body", "removed_companies": [f"Company {c['nation']}"]}]}))
    return out


def _events(texts: list[str]) -> list[str]:
    return [json.dumps({"meetings": [{"meeting_id": f"m{json.loads(t)['key'] % 7}", "company_name": f"Company {json.loads(t)['nation']}"}]}) for t in texts]


_PROVIDERS = {"group2": _parties, "group4": _commercial, "group6": _events}


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    return _t(spark, sf, "supplier").select(F.lit("gazette").alias("document_id"), F.concat(F.lit("k"), "s_suppkey").alias("chunk_id"), body.alias("chunk_json"))


@registered("""
SELECT 'k' || s_suppkey AS chunk_id, CASE WHEN s_suppkey % 5 = 0 THEN 'group4' ELSE '' END AS failed, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 3 END AS n_entities FROM supplier""")
def extraction_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A group that fails leaves the others' entities."""
    from quillgraph.operators import emit

    found = extraction.extracted(_chunks(spark, sf), _PROVIDERS)
    return found.join(emit.entity_totals(found), "chunk_id").select("chunk_id", F.array_join("failed_groups", ",").alias("failed"), "n_entities")


@registered("""
SELECT DISTINCT 'HOLDS_MEETING' AS type, 'company-' || s_nationkey AS src_id, 'm' || s_suppkey % 7 AS dst_id FROM supplier
UNION SELECT 'REMOVED_FROM_TENDER', 't' || s_suppkey, 'company-' || s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0""")
def emit_edges(spark: SparkSession, sf: str) -> DataFrame:
    """From chunks by providers to merged edges; those whose other end was never extracted are left out."""
    _, edges = extraction.graph_of(extraction.extracted(_chunks(spark, sf), _PROVIDERS, concurrency=4))
    return edges.select("type", "src_id", "dst_id")


@registered("""
SELECT stage, count(*) FILTER (WHERE o_orderkey % 10 <> m) AS done, count(*) FILTER (WHERE o_orderkey % 10 = m) AS failed
FROM orders CROSS JOIN (VALUES ('parsed', 1), ('normalized', 2), ('extracted', 3), ('ingested', 4)) s(stage, m) GROUP BY stage""")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    stages = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(m).alias("m")) for s, m in (("parsed", 1), ("normalized", 2), ("extracted", 3), ("ingested", 4)))))
    rows = _t(spark, sf, "orders").select("o_orderkey", stages.alias("s"))
    status = rows.select(F.col("o_orderkey").cast("string").alias("path"), "s.stage", F.when(F.col("o_orderkey") % 10 == F.col("s.m"), "broken").alias("error"))
    return extraction.summary(status)


@registered("""
SELECT c_custkey AS qid, CASE c_custkey % 3 WHEN 0 THEN '(Addendum)-[ADDENDS]->(Document)' WHEN 1 THEN '(Award)-[AWARD_OF]->(Tender)' ELSE '(Auction)-[AUCTION_ORGANIZED_FOR]->(Company)' END AS first,
  CASE c_custkey % 3 WHEN 0 THEN 11 WHEN 1 THEN 4 ELSE 7 END AS n_relations FROM customer""")
def schema_text(spark: SparkSession, sf: str) -> DataFrame:
    """Of each question's label, the schema's first relation in text order, and how many there are."""
    label = F.element_at(F.array(*map(F.lit, ("Document", "Tender", "Company"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    told = catalog.schema_texts(spark, _t(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.array(label, label).alias("labels")))
    lines = F.filter(F.split("schema_text", "\n"), lambda x: x.startswith("("))
    return told.select("qid", lines[0].alias("first"), F.size(lines).alias("n_relations"))


# -- chat -----------------------------------------------------------------------------


def _last_line(texts: list[str]) -> list[str]:
    """A rewriter that joins what was said first with the message."""
    return [t.split("\n")[1][:40] + " / " + t.split("Latest message: ", 1)[1].split("\n")[0][:40] for t in texts]


@registered("""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
i AS (SELECT conv_id, text FROM m WHERE back = 1), p AS (SELECT * FROM m WHERE back > 1 AND back <= 12),
f AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text FROM p GROUP BY conv_id)
SELECT i.conv_id AS session_id, CASE WHEN f.conv_id IS NULL THEN i.text ELSE trim(substring(CASE WHEN f.role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substring(string_split(f.text, chr(10))[1], 1, 300), 1, 40) || ' / ' || substring(string_split(i.text, chr(10))[1], 1, 40)) END AS resolved_query,
  (SELECT count(*) FROM conversations c WHERE c.conv_id = i.conv_id) + 1 AS n_messages
FROM i LEFT JOIN f USING (conv_id)""")
def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's last message as a new one: rewritten with what was said before, answered, recorded."""
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", "text")
    last = rows.groupBy("session_id").agg(F.max("ord").alias("ord"))
    incoming = rows.join(last, ["session_id", "ord"]).select("session_id", "text")
    before = rows.join(last.withColumn("last", F.lit(True)), ["session_id", "ord"], "left_anti")
    sessions = last.select("session_id", F.lit("en").alias("language"))
    answers = lambda q: q.select("qid", F.concat(F.lit("about "), "question").alias("answer"))
    turns, messages = chat.chat_turn(incoming, before, sessions, _last_line, answers)
    n = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    return turns.join(n, "session_id").select("session_id", "resolved_query", "n_messages")
