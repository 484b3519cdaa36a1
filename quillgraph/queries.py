"""Registered queries over the test tables, each with the SQL that gives the same rows.

The tables hold no legal documents, so parsing queries work on text derived from them, and
graph queries on the graph of regions, nations, customers and orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.functions import language, text, titles
from quillgraph.operators import answer, chat, graph, parse, search
from quillgraph.plans import routing

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillgraph import case_queries, graph_queries, retrieval_queries  # noqa: F401  register more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quillgraph import case_queries, graph_queries, retrieval_queries  # noqa: F401  register more

    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- vector and full-text search ----------------------------------------------

_ASKED = 20  # queries are the vectors whose id it divides, against all


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf, "embeddings")
    nodes = rows.select(F.col("vec_id").alias("element_id"), F.concat(F.lit("index_"), "label").alias("index"), "embedding")
    return nodes, rows.where(F.col("vec_id") % _ASKED == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def _index_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"index_{i}", 1 + i % 3, 0.45 + 0.02 * i) for i in range(8)], "index string, k int, min_score double")


_VECTOR_SQL = f"""
WITH s AS (SELECT q.vec_id AS qid, n.vec_id AS element_id, 'index_' || n.label AS index,
             (1 + list_sum(list_transform(list_zip(n.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
              / sqrt(list_sum(list_transform(n.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)))) / 2 AS score, n.label AS l
           FROM embeddings n CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % {_ASKED} = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, index ORDER BY score DESC, element_id) AS rank FROM s),
m AS (SELECT qid, element_id, index, 'vector:' || index AS source, score FROM r
      WHERE rank <= CASE WHEN l < 8 THEN 1 + l % 3 ELSE 3 END AND (l >= 8 OR score >= 0.45 + 0.02 * l))
"""


@registered(_VECTOR_SQL + "SELECT qid, element_id, index, source, round(score, 6) AS score FROM m")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    nodes, asked = _vectors(spark, sf)
    return search.vector_lookup(nodes, asked, _index_settings(spark)).withColumn("score", F.round("score", 6))


@registered(_VECTOR_SQL + """, a AS (SELECT qid, element_id, max(score) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, element_id) AS n FROM a)
SELECT qid, element_id, round(score, 6) AS score, sources FROM b WHERE n <= 10""")
def context_top10(spark: SparkSession, sf: str) -> DataFrame:
    nodes, asked = _vectors(spark, sf)
    best = search.merged_matches(search.vector_lookup(nodes, asked, _index_settings(spark)), catalog.CONTEXT_LIMIT)
    return best.select("qid", "element_id", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


@registered("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM benchmark),
p AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, doc_id AS element_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
      FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, element_id) AS n FROM s)
SELECT qid, element_id, round(score, 4) AS score FROM r WHERE n <= 3""")
def fulltext_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), "text")
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), search.tokens("text").alias("terms"))
    return search.fulltext_lookup(docs, asked).withColumn("score", F.round("score", 4))


@registered("""
SELECT p_partkey, coalesce(nullif(trim(coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '')), ''), 'Part') AS embedding_text FROM part""")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", text.embedding_text(["p_name", "p_brand", "p_type"], "Part").alias("embedding_text"))


# -- text ------------------------------------------------------------------------


@registered(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS clean, replace(lower(source), ' ', '-') AS slug,
CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents""")
def normalize_space(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.normalize_space("text").alias("clean"), text.slug("source").alias("slug"), text.cut("text", 200).alias("preview"))


@registered(r"""SELECT s_suppkey, nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(trim('Al-' || s_name || ', Inc.'), '^(?i)(al|el)\b-?\s*', '')), '[^\w\s\-]', ' ', 'g'), '\s+', ' ', 'g')), '') AS name FROM supplier""")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "supplier").select("s_suppkey", text.canonical_name(F.concat(F.lit("Al-"), "s_name", F.lit(", Inc."))).alias("name"))


_TITLES = ["Article One", "Article ({n})", "Decree No. {n}/2025", "Ministerial Resolution No. {n} of 2024", "Case No. {n}", "Criminal Judgment", "Schedule (A)", "{d}", "Budget {n}", "First: {n}", "Ministry of Health {n}", "Announcement", "Notice:", "Subject: {n}", "For: {n}", "Bid Bond {n}", "Correction", "Text After Amendment", "Change Order {n}", "Article {n}:", "Decree-Law No. {n}/1979", "Plain title {n}"]


def _titled(orders: DataFrame) -> DataFrame:
    n = F.col("o_orderkey") % 97
    out = None
    for i, t in enumerate(_TITLES):
        value = F.lit(t)
        if "{n}" in t:
            value = F.replace(value, F.lit("{n}"), n.cast("string"))
        if "{d}" in t:
            value = F.replace(value, F.lit("{d}"), (n % 50).cast("string"))
        case = F.col("o_orderkey") % len(_TITLES) == i
        out = F.when(case, value) if out is None else out.when(case, value)
    return orders.select("o_orderkey", out.alias("title"))


_TITLE_SQL = "SELECT o_orderkey, CASE " + " ".join(f"WHEN o_orderkey % {len(_TITLES)} = {i} THEN replace(replace('{t}', '{{n}}', CAST(o_orderkey % 97 AS VARCHAR)), '{{d}}', CAST((o_orderkey % 97) % 50 AS VARCHAR))" for i, t in enumerate(_TITLES)) + " END AS title FROM orders"
# The type of each of these titles, by the rules of the parser.
_TITLE_TYPES = [
    "Article", "Article", "Decree", "MinisterialResolution", "Section", "CriminalJudgment", "Schedule", "Schedule", "Budget", "DecisionSection", "InstitutionSection",
    "Announcement", "Announcement", "SubjectSection", "VotingBreakdown", "TenderSection", "Correction", "ArticleVersion", "ChangeOrder", "Article", "Decree", "Section",
]
_TYPE_SQL = f"({_TITLE_TYPES!r})[1 + CAST(o_orderkey % {len(_TITLES)} AS INTEGER)]"


@registered(f"WITH t AS ({_TITLE_SQL}) SELECT o_orderkey, title, {_TYPE_SQL} AS chunk_type FROM t")
def classify_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _titled(_t(spark, sf, "orders"))
    return rows.withColumn("chunk_type", titles.chunk_type(titles.clean_title("title")))


_NAMED, _BARE = r"(?i)\bNo\.?\s*([A-Za-z0-9\-/]+)\s*(?:of|/)\s*(\d{4})\b", r"(?i)\b(\d{1,5})\s*/\s*(\d{4})\b"
_ACT_SQL = lambda i: f"CASE WHEN regexp_matches(title, '{_NAMED}') THEN regexp_extract(title, '{_NAMED}', {i}) WHEN regexp_matches(title, '{_BARE}') THEN regexp_extract(title, '{_BARE}', {i}) END"


@registered(f"WITH t AS ({_TITLE_SQL}) SELECT o_orderkey, {_ACT_SQL(1)} AS act_number, {_ACT_SQL(2)} AS act_year FROM t")
def act_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _titled(_t(spark, sf, "orders")).select("o_orderkey", text.act_numbers("title")["act_number"].alias("act_number"), text.act_numbers("title")["act_year"].alias("act_year"))


# -- parsing ---------------------------------------------------------------------

_MARKDOWN = "'<page_start>' || {id} % 7 || '</page_start>' || chr(10) || '# Decree No. ' || {id} || '/2025' || chr(10) || '# Amending' || chr(10) || coalesce(text, '') || chr(10) || '<page_start>' || ({id} % 7 + 1) || '</page_start>' || chr(10) || '## Article (' || {id} % 20 || ')' || chr(10) || '1. first clause' || chr(10) || '(2) second clause ' || {id}"


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.expr(_MARKDOWN.format(id="doc_id").replace("chr(10)", "'\\n'")).alias("text"))


_SECTIONS_SQL = f"""WITH m AS (SELECT doc_id, coalesce(text, '') AS body, {_MARKDOWN.format(id='doc_id')} AS md FROM documents),
s AS (SELECT doc_id, CAST(strpos(md, '# Decree') - 1 AS INTEGER) AS position, 1 AS level, 'Decree No. ' || doc_id || '/2025 Amending' AS title, md,
        trim(body || chr(10) || '<page_start>' || (doc_id % 7 + 1) || '</page_start>', ' ' || chr(10) || chr(9) || chr(13)) AS body FROM m
      UNION ALL
      SELECT doc_id, CAST(strpos(md, '## Article') - 1 AS INTEGER), 2, 'Article (' || doc_id % 20 || ')', md, '1. first clause' || chr(10) || '(2) second clause ' || doc_id FROM m)
"""


@registered(_SECTIONS_SQL + "SELECT doc_id, position, level, title, body FROM s")
def sections_explode(spark: SparkSession, sf: str) -> DataFrame:
    return parse.sections(_markdown(spark, sf), "doc_id").select("doc_id", "position", "level", "title", "body")


@registered(_SECTIONS_SQL + "SELECT doc_id, position, CAST(doc_id % 7 + CASE WHEN level = 2 THEN 1 ELSE 0 END AS INTEGER) AS page FROM s")
def page_asof(spark: SparkSession, sf: str) -> DataFrame:
    docs = _markdown(spark, sf)
    found = parse.sections(docs, "doc_id").join(docs.select("doc_id", parse.page_map("text").alias("pages")), "doc_id")
    return found.select("doc_id", "position", parse.page_at("position", "pages").alias("page"))


@registered("""SELECT doc_id, '1' AS "index", 'first clause' AS text_en FROM documents UNION ALL SELECT doc_id, '2', 'second clause ' || doc_id FROM documents""")
def clauses(spark: SparkSession, sf: str) -> DataFrame:
    found = parse.chunks(_markdown(spark, sf), "doc_id").where("chunk_type = 'Article'").select("doc_id", F.explode("clauses").alias("c"))
    return found.select("doc_id", F.col("c.index").alias("index"), F.col("c.text_en").alias("text_en"))


_CHUNKS = "SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'c' || doc_id END AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN ' ' ELSE 'Section' END AS chunk_type, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END AS text_en, source AS title FROM {d}"


@registered(f"WITH c AS ({_CHUNKS.format(d='documents')}) SELECT count(*) AS total, count(*) FILTER (WHERE NOT (coalesce(chunk_id, '') <> '' AND coalesce(chunk_type, '') <> '' AND trim(coalesce(text_en, ''), ' ' || chr(10) || chr(9)) <> '')) AS invalid, count(*) AS written FROM c")
def chunk_validation(spark: SparkSession, sf: str) -> DataFrame:
    return parse.validation_stats(parse.validated(spark.sql(_CHUNKS.format(d="{d}"), d=_t(spark, sf, "documents"))))


# -- graphs ----------------------------------------------------------------------


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and orders as nodes; what belongs to what as edges."""
    nodes, edges = [], []
    for label, name, key, parent, parent_label, kind in (("Region", "region", "r_regionkey", None, None, None), ("Nation", "nation", "n_nationkey", "n_regionkey", "Region", "IN_REGION"), ("Customer", "customer", "c_custkey", "c_nationkey", "Nation", "IN_NATION"), ("Order", "orders", "o_orderkey", "o_custkey", "Customer", "PLACED_BY")):
        rows = _t(spark, sf, name)
        nodes.append(rows.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("node_id")))
        if parent:
            edges.append(rows.select(F.lit(kind).alias("type"), F.lit(label).alias("src_label"), F.col(key).cast("string").alias("src_id"), F.lit(parent_label).alias("dst_label"), F.col(parent).cast("string").alias("dst_id")))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    return union(nodes), union(edges)


@registered("""
WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS node_id, o_orderkey AS seq, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders),
l AS (SELECT node_id, arg_max(status, seq) AS status, max(seq) AS seq FROM e GROUP BY node_id),
p AS (SELECT node_id, priority FROM e QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) = 1)
SELECT 'Customer' AS label, node_id, seq, status, priority FROM l JOIN p USING (node_id)""")
def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as successive records of their customer's properties; a null priority removes it."""
    priority = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    rows = _t(spark, sf, "orders").select(F.lit("Customer").alias("label"), F.col("o_custkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("seq"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), priority).alias("props"))
    return graph.upsert_nodes(rows).select("label", "node_id", "seq", F.col("props")["status"].alias("status"), F.col("props")["priority"].alias("priority"))


@registered("""
SELECT 'SUPPLIES' AS type, CAST(l_suppkey AS VARCHAR) AS src_id, CAST(l_partkey AS VARCHAR) AS dst_id, max(l_orderkey * 10 + l_linenumber) AS seq,
       arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey""")
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem")
    nodes = _t(spark, sf, "supplier").select(F.lit("Supplier").alias("label"), F.col("s_suppkey").cast("string").alias("node_id")).union(_t(spark, sf, "part").select(F.lit("Part"), F.col("p_partkey").cast("string")))
    edges = lines.select(F.lit("SUPPLIES").alias("type"), F.lit("Supplier").alias("src_label"), F.col("l_suppkey").cast("string").alias("src_id"), F.lit("Part").alias("dst_label"), F.col("l_partkey").cast("string").alias("dst_id"), F.create_map(F.lit("flag"), "l_returnflag").alias("props"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.upsert_edges(edges, nodes).select("type", "src_id", "dst_id", "seq", F.col("props")["flag"].alias("flag"))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS src_id, CAST(o_custkey AS VARCHAR) AS dst_id FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey")
def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer isn't among the nodes: here, those in debt."""
    _, edges = _graph(spark, sf)
    nodes = _t(spark, sf, "customer").where("c_acctbal >= 0").select(F.lit("Customer").alias("label"), F.col("c_custkey").cast("string").alias("node_id"))
    nodes = nodes.union(_t(spark, sf, "orders").select(F.lit("Order"), F.col("o_orderkey").cast("string")))
    return graph.dangling(edges.where("type = 'PLACED_BY'"), nodes).select("src_id", "dst_id")


@registered("SELECT CAST(c_custkey AS VARCHAR) AS id_0, CAST(c_nationkey AS VARCHAR) AS id_1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' ORDER BY 1, 2 LIMIT 10")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.plans.patterns import Pattern, match

    nodes, edges = _graph(spark, sf)
    start = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("element_id"))
    return match(Pattern((("Customer", "IN_NATION", "Nation"),)), nodes, edges, start)


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id_0, CAST(o_custkey AS VARCHAR) AS id_1, CAST(c_nationkey AS VARCHAR) AS id_2 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def two_hop_intersection(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    end = _t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("element_id"))
    return graph.expand(nodes, edges, [("Order", "PLACED_BY", "Customer"), ("Customer", "IN_NATION", "Nation")], end=end)


# What the schema allows, stated apart from the catalog.
_RELATION_VALUES = """
('LegalAct','PUBLISHED_IN','Document'), ('LegalAct','ISSUED_BY','Institution'), ('LegalAct','SIGNED_BY','Person'), ('LegalAct','APPOINTS','Person'),
('Institution','APPOINTS','Person'), ('LegalAct','HAS_ARTICLE','Article'), ('Article','HAS_CLAUSE','Clause'), ('Article','HAS_VERSION','Article'),
('LegalAct','AMENDS','LegalAct'), ('LegalAct','REPEALS','LegalAct'), ('LegalAct','REFERENCES','LegalAct'), ('LegalAct','HAS_TOPIC','Topic'),
('Company','HAS_LEGAL_FORM','Topic'), ('CourtCase','ADJUDICATED_BY','Court'), ('CourtCase','INVOLVES','LegalParty'), ('Document','HAS_CHUNK','Section'),
('Document','HAS_CHUNK','CourtCase'), ('Document','HAS_CHUNK','Company'), ('Document','HAS_CHUNK','Tender'), ('Document','HAS_CHUNK','Award'),
('Document','HAS_CHUNK','Penalty'), ('Document','HAS_CHUNK','Auction'), ('Document','HAS_CHUNK','LegalAct'), ('Section','MENTIONS','Institution'),
('Company','HOLDS_MEETING','Meeting'), ('Meeting','PASSES_RESOLUTION','Resolution'), ('Meeting','HAS_VOTE','Vote'), ('Institution','ISSUES_TENDER','Tender'),
('Tender','REMOVED_FROM_TENDER','Company'), ('Award','AWARDED_TO','Company'), ('Award','AWARD_OF','Tender'), ('Award','RESULTS_IN_CONTRACT','Contract'),
('ChangeOrder','AMENDS_CONTRACT','Contract'), ('ChangeOrder','ISSUED_BY','Institution'), ('Institution','ANNOUNCES_AUCTION','Auction'), ('Auction','AUCTION_OF','Asset'),
('Auction','AUCTION_ORGANIZED_FOR','Company'), ('Penalty','IMPOSED_BY','Institution'), ('Penalty','IMPOSED_ON','Company'), ('Complaint','FILED_BY','Person'),
('Complaint','FILED_AGAINST','Institution'), ('Correction','CORRECTS','Document'), ('Addendum','ADDENDS','Document')"""
_LABELS = [*catalog.ENTITIES]


@registered(f"""
WITH e AS (SELECT l_orderkey, l_linenumber, ({_LABELS!r})[1 + CAST(l_orderkey % {len(_LABELS)} AS INTEGER)] AS src_label, ({_LABELS!r})[1 + CAST(l_partkey % {len(_LABELS)} AS INTEGER)] AS dst_label,
  ({[t for _, t, _ in catalog.RELATIONS]!r})[1 + CAST(l_suppkey % {len(catalog.RELATIONS)} AS INTEGER)] AS type FROM lineitem),
r(a, t, b) AS (VALUES {_RELATION_VALUES})
SELECT l_orderkey, l_linenumber, src_label, type, dst_label FROM e JOIN r ON a = src_label AND t = type AND b = dst_label""")
def relation_filter(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    edges = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pick(_LABELS, "l_orderkey").alias("src_label"), pick(_LABELS, "l_partkey").alias("dst_label"), pick([t for _, t, _ in catalog.RELATIONS], "l_suppkey").alias("type"))
    return graph.allowed(edges, catalog.relations(spark)).select("l_orderkey", "l_linenumber", "src_label", "type", "dst_label")


_OLD = ["LEGAL_DOC", "PERSON", "EVENT", "COURT_ROOM", "Section", "ROLE"]


@registered(f"""
WITH n AS (SELECT ({_OLD!r})[1 + CAST(c_custkey % {len(_OLD)} AS INTEGER)] AS old FROM customer)
SELECT old, CASE old WHEN 'LEGAL_DOC' THEN 'Document' WHEN 'PERSON' THEN 'Person' WHEN 'EVENT' THEN 'Meeting' WHEN 'ROLE' THEN 'Topic' ELSE 'CourtRoom' END AS new, count(*) AS n FROM n WHERE old = upper(old) GROUP BY ALL""")
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    old = F.element_at(F.array(*map(F.lit, _OLD)), (F.col("c_custkey") % len(_OLD) + 1).cast("int"))
    return graph.relabel_report(_t(spark, sf, "customer").select(F.array(old).alias("labels")), catalog.LABEL_MIGRATIONS)


@registered(f"""
WITH n AS (SELECT c_custkey, CASE ({_OLD!r})[1 + CAST(c_custkey % {len(_OLD)} AS INTEGER)] WHEN 'LEGAL_DOC' THEN 'Document' WHEN 'PERSON' THEN 'Person' WHEN 'EVENT' THEN 'Meeting' WHEN 'ROLE' THEN 'Topic' WHEN 'COURT_ROOM' THEN 'CourtRoom' ELSE 'Section' END AS label FROM customer)
SELECT o_orderkey, label, CASE WHEN label = 'Company' THEN 'Company' ELSE 'Company,' || label END AS labels FROM orders JOIN n ON c_custkey = o_custkey""")
def relabelled_links(spark: SparkSession, sf: str) -> DataFrame:
    """After a migration links still meet their ends, under the new labels."""
    old = F.element_at(F.array(*map(F.lit, _OLD)), (F.col("c_custkey") % len(_OLD) + 1).cast("int"))
    customers = _t(spark, sf, "customer").select("c_custkey", old.alias("label"), F.array(F.lit("Company"), old).alias("labels"))
    links = _t(spark, sf, "orders").join(customers.select("c_custkey", "label"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", F.lit("Document").alias("src_label"), F.col("label").alias("dst_label"))
    nodes = graph.relabelled(customers, catalog.LABEL_MIGRATIONS).withColumnsRenamed({"c_custkey": "o_custkey", "label": "dst_label"})
    met = graph.relabelled_edges(links, catalog.LABEL_MIGRATIONS).join(nodes, ["o_custkey", "dst_label"])
    return met.select("o_orderkey", F.col("dst_label").alias("label"), F.array_join(F.array_sort("labels"), ",").alias("labels"))


@registered("""
WITH n AS (SELECT c_custkey AS id, c_mktsegment AS label FROM customer UNION SELECT c_custkey, 'nation_' || c_nationkey FROM customer)
SELECT label, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM n GROUP BY label""")
def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("element_id"), F.array("c_mktsegment", F.concat(F.lit("nation_"), "c_nationkey")).alias("labels"))
    return graph.ids_by_label(nodes).select("label", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# -- linking ---------------------------------------------------------------------


@registered("""
WITH k AS (SELECT l_orderkey AS qid, p_partkey AS element_id, 'key' AS source, 1 AS tier FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber + 20),
b AS (SELECT DISTINCT l_orderkey AS qid, s_suppkey AS element_id, 'name' AS source, 2 AS tier FROM lineitem JOIN supplier ON lower(s_name) = 'supplier#' || lpad(CAST(l_suppkey * 3 AS VARCHAR), 9, '0')),
u AS (SELECT DISTINCT * FROM k UNION ALL SELECT * FROM b)
SELECT qid, element_id, source, tier FROM u QUALIFY tier = min(tier) OVER (PARTITION BY qid)""")
def tiered_link(spark: SparkSession, sf: str) -> DataFrame:
    """Orders ask for parts by key and size, and else for suppliers by name."""
    lines, part = _t(spark, sf, "lineitem"), _t(spark, sf, "part")
    keyed = search.key_lookup(part.select(F.col("p_partkey").alias("element_id"), F.col("p_partkey").alias("part"), F.col("p_size").alias("size")), lines.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") + 20).alias("size")), ["part", "size"], "key")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") * 3).cast("string"), 9, "0"))
    named = search.property_lookup(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("element_id"), "s_name"), lines.select(F.col("l_orderkey").alias("qid"), text.lookup_candidates(name, "s_name").alias("candidates")), "s_name", "name")
    return search.tiered(keyed, named)


# -- conversations ---------------------------------------------------------------


@registered("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return chat.history(_t(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@registered("""SELECT conv_id, turn, coalesce(string_agg(substring(text, 1, 300), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""")
def last_context(spark: SparkSession, sf: str) -> DataFrame:
    return chat.recent_context(_t(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@registered("SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def sessions_list(spark: SparkSession, sf: str) -> DataFrame:
    return chat.sessions(_t(spark, sf, "conversations"), "conv_id")


@registered("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS start, max(ts) AS "end", count(*) AS n_events FROM s GROUP BY ALL""")
def session_idle(spark: SparkSession, sf: str) -> DataFrame:
    return chat.idle_sessions(_t(spark, sf, "events"), "user_id", "ts")


_WISHES = ["please reply in English", "rispondi in italiano", "write in spanish please", "what is the penalty", "I will continue to read"]


@registered(f"""
WITH m AS (SELECT conv_id, turn, ({_WISHES!r})[1 + CAST((conv_id * 3 + turn) % 5 AS INTEGER)] AS wish FROM conversations),
s AS (SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'it' WHEN 2 THEN 'es' END AS switch,
  CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'en' END AS detected FROM m)
SELECT conv_id, turn, coalesce(last_value(switch IGNORE NULLS) OVER w, first_value(detected) OVER w, 'it') AS language
FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def session_language(spark: SparkSession, sf: str) -> DataFrame:
    wish = F.element_at(F.array(*map(F.lit, _WISHES)), ((F.col("conv_id") * 3 + F.col("turn")) % 5 + 1).cast("int"))
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", language.explicit_switch(wish, F.lit("")).alias("switch"), F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "en").alias("detected"))
    return chat.session_language(rows, "conv_id", "turn", "switch", "detected").select("conv_id", "turn", "language")


@registered("""SELECT event_id FROM events WHERE TIMESTAMP '2024-01-15 00:00:00' < ts""")
def ttl_cache(spark: SparkSession, sf: str) -> DataFrame:
    cache = _t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("expiry"))
    return chat.cache_get(cache, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("event_id")


# -- routing, answers, JSON --------------------------------------------------------


@registered("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'q' END AS query, (['intersection', 'fallback', 'reformulation'])[1 + CAST(o_orderkey % 5 % 3 AS INTEGER)] AS attempt, o_orderkey % 2 AS n_entry, o_orderkey % 7 % 2 AS n_context,
  CASE o_orderkey % 4 WHEN 0 THEN 'SyntaxError near x' WHEN 1 THEN 'timeout' END AS error, o_orderkey % 11 % 2 AS n_rows FROM orders)
SELECT o_orderkey,
 CASE WHEN query IS NOT NULL THEN 'run' WHEN attempt <> 'intersection' THEN 'abort' WHEN n_entry = 0 AND n_context > 0 THEN 'context_explore' WHEN n_entry = 0 THEN 'abort' ELSE 'fallback' END AS planned,
 CASE WHEN error IS NOT NULL THEN CASE WHEN error LIKE '%SyntaxError%' AND attempt NOT IN ('fallback', 'reformulation') THEN 'retry' ELSE 'answer' END
      WHEN n_rows > 0 THEN 'evaluate' WHEN attempt = 'intersection' THEN 'retry' ELSE 'answer' END AS executed,
 CASE WHEN n_rows > 0 THEN 'synthesize' ELSE 'reformulate' END AS evaluated FROM s""")
def route_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempt = F.element_at(F.array(*map(F.lit, ("intersection", "fallback", "reformulation"))), (k % 5 % 3 + 1).cast("int"))
    error = F.when(k % 4 == 0, "SyntaxError near x").when(k % 4 == 1, "timeout")
    rows = _t(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, "q").alias("query"), attempt.alias("attempt"), (k % 2).alias("n_entry"), (k % 7 % 2).alias("n_context"), error.alias("error"), (k % 11 % 2).alias("n_rows"))
    c = F.col
    return rows.select("o_orderkey", routing.after_planning(c("query"), c("attempt"), c("n_entry"), c("n_context")).alias("planned"), routing.after_execution(c("error"), c("attempt"), c("n_rows")).alias("executed"), routing.after_evaluation(c("n_rows") > 0).alias("evaluated"))


@registered("""
WITH s AS (SELECT l_orderkey AS document_id, min(l_linenumber) AS ord, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS sections FROM lineitem GROUP BY l_orderkey)
SELECT document_id, ord, 'Order ' || document_id || ' (' || CASE WHEN len(sections) > 1 THEN 'sections' ELSE 'section' END || ': ' || array_to_string(sections, ', ') || ')' AS citation FROM s""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("Order "), "l_orderkey").alias("document_title"), F.concat("l_returnflag", "l_linestatus").alias("section"), F.col("l_linenumber").alias("ord"))
    return answer.citations(rows).select("document_id", "ord", "citation")


@registered("""SELECT event_id, '["' || event_type || '", "' || user_id || '"]' AS written, event_type || ',' || user_id AS parsed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_list(spark: SparkSession, sf: str) -> DataFrame:
    written = F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id"), F.lit('"]'))
    return _t(spark, sf, "events").select("event_id", written.alias("written"), F.array_join(text.json_list(F.concat(F.lit("Here:\n```json\n"), written, F.lit("\n```"))), ",").alias("parsed"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
