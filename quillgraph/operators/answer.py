"""From result rows to summaries, sections and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cut

SUMMARY_ROWS, SUMMARY_LENGTH = 5, 50_000


def citations(rows: DataFrame) -> DataFrame:
    """A citation per document: document_id, ord, sections, citation. rows: document_id, document_title, section, ord.

    The title is that of the last row that has one, or else the id; sections are distinct and sorted.
    """
    out = rows.groupBy("document_id").agg(
        F.max_by("document_title", F.when(F.coalesce("document_title", F.lit("")) != "", F.col("ord"))).alias("title"),
        F.sort_array(F.collect_set(F.nullif("section", F.lit("")))).alias("sections"),
        F.min("ord").alias("ord"),
    )
    title = F.coalesce("title", F.col("document_id").cast("string"))
    word = F.when(F.size("sections") > 1, "sections").otherwise("section")
    text = F.when(F.size("sections") == 0, title).otherwise(F.concat(title, F.lit(" ("), word, F.lit(": "), F.array_join("sections", ", "), F.lit(")")))
    return out.select("document_id", "ord", "sections", text.alias("citation"))


def result_sections(rows: DataFrame) -> DataFrame:
    """Distinct (title, document_title) sections with text, the first by ``ord``."""
    first = F.row_number().over(Window.partitionBy("qid", "title", "document_title").orderBy("ord"))
    return rows.where("coalesce(text, '') <> ''").withColumn("first", first).where("first = 1").drop("first")


def summary(rows: DataFrame, most: int = SUMMARY_ROWS, length: int = SUMMARY_LENGTH) -> DataFrame:
    """The first rows of each question as JSON, while their length together is within the bound. rows: qid, ord, and props (map) or nodes.

    ``nodes`` is a map from a name to struct<labels:array<string>,props:map<string,string>>; each is told as ``node_summary`` has it, with its labels.
    """
    order = Window.partitionBy("qid").orderBy("ord")
    if "nodes" in rows.columns:
        told = F.transform(F.array_sort(F.map_keys("nodes")), lambda k: F.concat(_quoted(k), F.lit(":"), _node_json(F.try_element_at("nodes", k))))
        json = F.concat(F.lit("{"), F.array_join(told, ","), F.lit("}"))
    else:
        json = F.to_json(F.map_filter(F.transform_values("props", lambda k, v: cut(v, 100)), lambda k, v: v.isNotNull()))
    out = rows.select("qid", "ord", json.alias("json")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    total = F.sum(F.length("json")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("total", total).where(F.col("total") <= length).drop("total", "n")


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[([\s\S]*)\]$", 1)


def _node_json(node: Column) -> Column:
    told = node_summary(node["labels"], node["props"])
    rest = F.when(F.size(told) > 0, F.concat(F.lit(","), F.regexp_replace(F.to_json(told), r"^\{", ""))).otherwise("}")
    return F.concat(F.lit('{"labels":'), F.to_json(F.coalesce(node["labels"], F.array().cast("array<string>"))), rest)


def node_lines(rows: DataFrame, with_score: bool = False) -> DataFrame:
    """Nodes as lines of text, a score with four places (0 if null)."""
    parts = [F.lit("- "), F.array_join("labels", ","), F.lit(" "), F.col("element_id"), F.lit(" ["), F.array_join("sources", ", "), F.lit("]")]
    if with_score:
        parts.append(F.format_string(" score=%.4f", F.coalesce("score", F.lit(0.0))))
    return rows.withColumn("line", F.concat(*parts))


def source_metadata(rows: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Rows with ``sources``: of each node (label array, id, property map) its type, id, what tells it apart, and a preview.

    ``nodes`` is an array of struct<labels:array<string>,element_id:string,props:map<string,string>>.
    """
    fields = [
        ("Document", ["document_id", "document_title", "document_date"]),
        ("LegalAct", ["act_type", "act_number", "act_year"]),
        ("Article", ["parent_act_key", "index", "heading"]),
        ("Section", ["document_id", "chunk_id", "title"]),
    ]

    def told(n: Column) -> Column:
        value = lambda k: F.try_element_at(n["props"], F.lit(k))
        pick = lambda ks: F.create_map(*(x for k in ks for x in (F.lit(k), value(k))))
        own = F.when(F.array_contains(n["labels"], fields[0][0]), pick(fields[0][1]))
        for label, keys in fields[1:]:
            own = own.when(F.array_contains(n["labels"], label), pick(keys))
        text = value("text_en")
        preview = F.when(F.coalesce(text, F.lit("")) != "", F.create_map(F.lit("text_preview"), F.concat(F.substring(text, 1, 200), F.lit("..."))))
        base = F.create_map(F.lit("type"), F.coalesce(F.get(n["labels"], F.lit(0)), F.lit("Unknown")), F.lit("id"), n["element_id"])
        none = F.create_map().cast("map<string,string>")
        return F.map_concat(base, F.coalesce(own, none), F.coalesce(preview, none))

    return rows.withColumn("sources", F.transform(nodes, told))


def node_summary(labels: Column, props: Column) -> Column:
    """What a summary tells of a node, by its label: a property map without null values."""
    value = lambda k: F.try_element_at(props, F.lit(k))
    short = lambda k, n: F.substring(F.coalesce(value(k), F.lit("")), 1, n)
    texts = [F.when(F.trim(value(k)) != "", value(k)) for k in ("text_en", "text_it", "text_es", "text_ar")]
    pick = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    has = lambda *ls: F.arrays_overlap(labels, F.array(*map(F.lit, ls)))
    out = (
        F.when(has("LegalAct"), pick(act_type=value("act_type"), act_number=value("act_number"), act_year=value("act_year"), title=short("title", 100)))
        .when(has("Person"), pick(name=value("name"), role=value("role")))
        .when(has("Company", "Institution"), pick(name=value("name"), normalized_name=value("normalized_name")))
        .when(has("Article"), pick(index=value("index"), heading=short("heading", 100), text_snippet=F.substring(F.coalesce(*texts, F.lit("")), 1, 150)))
        .when(has("Document"), pick(document_id=value("document_id"), document_title=short("document_title", 100), document_date=value("document_date")))
        .otherwise(pick(title=short("title", 80), name=value("name"), text_en=short("text_en", 80)))
    )
    return F.map_filter(out, lambda k, v: v.isNotNull())


# What stands for an empty block.
NO_SECTIONS = {
    "es": "(ninguna seccion recuperada de la base de conocimiento)",
    "en": "(no sections retrieved from the knowledge base)",
    "it": "(nessuna sezione recuperata dalla knowledge base)",
}


def section_block(sections: Column, language: Column) -> Column:
    """A question's retrieved sections (array of struct<title,text,source>) as one numbered block of text."""

    def entry(s: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        title = F.coalesce(F.nullif(s["title"], F.lit("")), F.concat(F.lit("Sezione "), n))
        source = F.when(F.coalesce(s["source"], F.lit("")) != "", F.concat(F.lit(" (Fonte: "), s["source"], F.lit(")"))).otherwise("")
        text = F.when(F.coalesce(s["text"], F.lit("")) != "", F.concat(F.lit("\n"), cut(s["text"], 600))).otherwise("")
        return F.concat(F.lit("["), n, F.lit("] "), title, source, text)

    none = F.when(language == "es", NO_SECTIONS["es"]).when(language == "en", NO_SECTIONS["en"]).otherwise(NO_SECTIONS["it"])
    return F.when(F.coalesce(F.size(sections), F.lit(0)) <= 0, none).otherwise(F.array_join(F.transform(sections, entry), "\n\n"))
