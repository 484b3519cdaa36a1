"""Markdown into sections, pages, clauses and typed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import titles
from quillgraph.functions.text import act_numbers, normalize_space, strip_original, strip_page_artifacts, trimmed

HEADING = r"(?dmU)^(#{1,6})\s+(.+?)\s*$"
PAGE_START = r"<page_start>(\d+)</page_start>"
# Clause forms, in order of trial.
CLAUSES = [r"(?dmU)^\s*[(]?([0-9]+)[)]?[.\-)]\s+(.*)$", rf"(?dmiU)^({titles.ORDINAL})\s*:\s+(.*)$"]


def page_map(text: Column | str) -> Column:
    """Array of (pos, page): offsets of page starts, in order."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, r"<page_start>\d+</page_start>")
    pages = F.regexp_extract_all(text, F.lit(PAGE_START), F.lit(1))
    marks = F.regexp_extract_all(text, F.lit(PAGE_START), F.lit(0))

    def step(s: Column, i: Column) -> Column:
        at = s["at"] + F.length(F.get(parts, i))
        here = F.struct(at.alias("pos"), F.get(pages, i).try_cast("int").alias("page"))
        return F.struct((at + F.length(F.get(marks, i))).alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,page:int>>").alias("out"))
    return F.when(F.size(pages) > 0, F.aggregate(F.sequence(F.lit(0), F.size(pages) - 1), start, step)["out"]).otherwise(F.array().cast("array<struct<pos:int,page:int>>"))


def page_at(position: Column | str, pages: Column | str) -> Column:
    """The page of the last mark at or before a position, or the first mark's; null without marks."""
    position, pages = (F.col(c) if isinstance(c, str) else c for c in (position, pages))
    before = F.filter(pages, lambda p: p["pos"] <= position)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.get(pages, F.lit(0))["page"])


def sections(docs: DataFrame, key: str = "path", text: str = "text", with_pages: bool = False) -> DataFrame:
    """key, position, level, title, body: headed sections; and ``pages``, the document's page map, if asked for.

    All steps go by document, so they share one shuffle.

    Titles of neighbouring headings of one level merge while bodies between them are empty; what
    stands before the first heading is dropped.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"(?dmU)(?=^#{1,6}\s+\S)")
    docs = docs.select(key, text, *([page_map(text).alias("pages")] if with_pages else []))
    pieces = docs.select(key, *docs.columns[2:], F.posexplode(parts).alias("n", "part"))
    order = Window.partitionBy(key).orderBy("n")
    pieces = pieces.withColumn("position", F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    pieces = pieces.where(F.col("part").rlike(r"(?U)^#{1,6}\s+\S"))
    head = r"(?dsU)^(#{1,6})\s+([^\n]+?)\s*(?:\n|$)"
    pieces = pieces.select(
        key, "n", "position", *(["pages"] if with_pages else []),
        F.length(F.regexp_extract("part", head, 1)).alias("level"),
        trimmed(F.regexp_extract("part", head, 2)).alias("title"),
        trimmed(F.regexp_replace("part", r"(?dsU)^#{1,6}\s+[^\n]+(?:\n|$)", "")).alias("body"),
    )
    joined = (F.lag("level").over(order) == F.col("level")) & (F.lag("body").over(order) == "")
    pieces = pieces.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    pieces = pieces.withColumn("island", F.sum("new").over(order))
    items = F.sort_array(F.collect_list(F.struct("n", "title")))
    return pieces.groupBy(key, "island").agg(
        F.min("position").alias("position"),
        F.first("level").alias("level"),
        F.array_join(F.transform(items, lambda x: x["title"]), " ").alias("title"),
        F.max_by("body", "n").alias("body"),
        *([F.first("pages").alias("pages")] if with_pages else []),
    ).drop("island")


def _clauses_like(text: Column | str, pattern: str, first: int) -> Column:
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("i"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("t"))
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long").cast("string")).otherwise(c)
    return F.transform(pair, lambda p, n: F.struct((n + first).alias("ord"), number(p["i"]).alias("index"), trimmed(p["t"]).alias("text_en")))


def clause_list(text: Column | str) -> Column:
    """Array of (ord, index, text_en): numbered and ordinal clauses; of equal ones (index, first 60 characters) the first."""
    found = [_clauses_like(text, pattern, kind * 1_000_000) for kind, pattern in enumerate(CLAUSES)]
    marked = F.transform(F.concat(*found), lambda c: F.struct(c.alias("c"), F.concat_ws("\n", c["index"], F.substring(c["text_en"], 1, 60)).alias("k")))
    # one element, so that the list and its marks are worked out once
    once = F.transform(F.array(marked), lambda m: F.struct(m.alias("m"), F.transform(m, lambda x: x["k"]).alias("ks")))
    kept = F.transform(once, lambda s: F.filter(s["m"], lambda x, i: F.array_position(s["ks"], x["k"]) == i + 1))
    return F.transform(F.get(kept, F.lit(0)), lambda x: x["c"])


def clauses(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ord, index, text_en: a row per clause."""
    return rows.select(*keys, F.explode(clause_list(text)).alias("c")).select(*keys, "c.*")


def document_metadata(text: Column | str) -> Column:
    """The metadata block as a map: a JSON object, or ``key: value`` lines, later keys winning."""
    text = F.col(text) if isinstance(text, str) else text
    block = trimmed(F.regexp_extract(text, r"(?is)<document_metadata>\s*(.*?)\s*</document_metadata>", 1))
    lines = F.filter(F.transform(F.split(block, "\n"), trimmed), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    entries = F.transform(lines, lambda x: F.struct(trimmed(F.regexp_extract(x, r"(?s)^([^:]*):(.*)$", 1)).alias("key"), trimmed(F.regexp_extract(x, r"(?s)^([^:]*):(.*)$", 2)).alias("value"), F.lit(0).alias("o")))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("o"))), lambda e: ~F.exists(F.slice(entries, e["o"] + 2, F.size(entries)), lambda l: l["key"] == e["key"]))
    plain = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    return F.when(block.startswith("{"), F.coalesce(F.from_json(block, "map<string,string>"), plain)).otherwise(plain)


def chunks(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Typed chunks of documents; sections whose text is empty after cleaning are dropped.

    ``chunk_id`` is a hash of the document and the section's position, so reruns agree.
    """
    rows = sections(docs, key, text, with_pages=True)
    rows = rows.withColumn("name", titles.clean_title("title")).withColumn("raw", strip_page_artifacts(strip_original("body")))
    rows = rows.withColumn("text_en", normalize_space("raw")).where("text_en <> ''")
    kind = titles.chunk_type(F.col("name"))
    legal = F.col("name").rlike(titles.LEGAL_ACT) & ~titles.is_article(F.col("name")) & ~titles.is_amendment(F.col("name"))
    numbers = act_numbers(F.concat_ws(" ", "title", "body"))
    rows = rows.select(
        key, "position", F.sha2(F.concat_ws("|", key, "position"), 256).alias("chunk_id"), kind.alias("chunk_type"), "title",
        F.struct(
            F.when(legal, kind).alias("act_type"), numbers["act_number"].alias("act_number"), numbers["act_year"].alias("act_year"),
            F.when(legal, F.regexp_extract("name", titles.LEGAL_ACT, 1)).alias("act_type_label"),
        ).alias("act"),
        "text_en", page_at("position", "pages").alias("page_number"),
        F.struct(titles.article_number(F.col("name")).alias("article"), titles.article_version(F.col("name")).alias("version")).alias("indices"),
        F.when(kind == "Article", F.transform(clause_list("raw"), lambda x: F.struct(x["index"].alias("index"), x["text_en"].alias("text_en")))).alias("clauses"),
    )
    return rows.withColumn("clauses", F.when(F.size("clauses") > 0, F.col("clauses")))


def validated(rows: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Chunks with text and title trimmed and ``valid``: id, type and text are there and not empty."""
    rows = rows.withColumns({"text_en": trimmed("text_en"), "title": trimmed("title")})
    valid = F.lit(True)
    for c in ("chunk_id", "chunk_type", "text_en"):
        valid = valid & (F.coalesce(c, F.lit("")) != "")
    rows = rows.withColumn("valid", valid)
    return rows.where("valid") if drop_invalid else rows


def validation_stats(rows: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """total, invalid, written of validated rows."""
    written = F.count_if("valid") if drop_invalid else F.count("*")
    return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("valid")).alias("invalid"), written.alias("written"))
