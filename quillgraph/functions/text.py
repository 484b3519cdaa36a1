"""Cleaning, numbers, names and keys, as column expressions.

White space and word characters are those of Unicode; line ends are ``\\n`` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}

# Legal act names and their types, in order of trial.
ACT_ALIASES = {
    "decree": "Decree",
    "amiri decree": "Decree",
    "emiri decree": "Decree",
    "decree law": "DecreeLaw",
    "decision": "Decision",
    "ministerial resolution": "MinisterialResolution",
    "committee resolution": "CommitteeResolution",
    "regulation": "Regulation",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def strip_original(c: Column | str) -> Column:
    """Without spans in the original language."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)<orig>.*?</orig>", "")


def strip_page_artifacts(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for pattern, by in (
        (r"(?s)<page_metadata>.*?</page_metadata>", ""),
        (r"(?s)<header>.*?</header>", ""),
        (r"(?s)<page_(?:start|end)>.*?</page_(?:start|end)>", ""),
        (r"(?dmU)^\s*---\s*$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def number_from_word(c: Column | str) -> Column:
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    c = col(c)
    return F.when(c.rlike(r"(?U)^\d+$"), c.try_cast("int")).otherwise(words[F.lower(c)])


def integer_or_word(c: Column | str) -> Column:
    c = trimmed(c)
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    return F.coalesce(c.try_cast("int"), words[F.lower(c)])


def act_numbers(c: Column | str) -> Column:
    """struct(act_number, act_year) named in a text, as strings."""
    plain = normalize_space(strip_original(c))
    named = r"(?i)\bNo\.?\s*([A-Za-z0-9\-/]+)\s*(?:of|/)\s*(\d{4})\b"
    bare = r"(?i)\b(\d{1,5})\s*/\s*(\d{4})\b"
    part = lambda i: F.when(plain.rlike(named), F.regexp_extract(plain, named, i)).when(plain.rlike(bare), F.regexp_extract(plain, bare, i))
    return F.struct(part(1).alias("act_number"), part(2).alias("act_year"))


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, which Spark has no function for."""
    for x in parts:
        yield x.str.normalize("NFKC")


def canonical_name(c: Column | str, composed: bool = True, strict: bool = False) -> Column:
    """A name for comparison: lower case, without article prefix, punctuation and other than ASCII.

    ``composed=False`` skips NFKC for text that is ASCII. In strict mode a name that is left with
    spaces only keeps them; otherwise it is null.
    """
    c = nfkc(col(c)) if composed else col(c)
    c = F.regexp_replace(trimmed(c), r"(?iU)^(?:al|el)\b-?\s*", "")
    c = F.regexp_replace(F.lower(c), r"(?U)[^\w\s\-]", " ")
    c = trimmed(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    return F.nullif(c, F.lit("")) if strict else F.nullif(F.trim(c), F.lit(""))


def slug(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("-"))


def penalty_id(company: Column | str, kind: Column | str, reason: Column | str) -> Column:
    parts = [F.coalesce(col(x), F.lit("")) for x in (company, kind)]
    return F.lower(F.translate(F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), F.substring(F.coalesce(col(reason), F.lit("")), 1, 20)), " ", "_"))


def act_key(c: Column | str) -> Column:
    """struct(act_type, act_number, act_year) of ``type-number-year``; null if it can't be read."""
    p = F.split(col(c), "-")
    number, year = F.get(p, F.lit(1)).try_cast("int"), F.get(p, F.lit(2)).try_cast("int")
    return F.when((F.size(p) >= 3) & number.isNotNull() & year.isNotNull(), F.struct(p[0].alias("act_type"), number.alias("act_number"), year.alias("act_year")))


def key_parent(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"-[^-]*$", "")


def key_index(c: Column | str) -> Column:
    return F.substring_index(col(c), "-", -1).try_cast("int")


def without_nulls(props: Column, falsy: bool = False) -> Column:
    """A property map without null values, or without empty, zero and null ones."""
    if falsy:
        return F.map_filter(props, lambda k, v: v.isNotNull() & ~v.isin("", "0", "0.0", "false"))
    return F.map_filter(props, lambda k, v: v.isNotNull())


def embedding_text(props: list[Column | str], label: str) -> Column:
    """Properties joined by spaces (an absent one keeps its space), trimmed; the label if nothing is left."""
    joined = F.concat(*[x for i, p in enumerate(props) for x in ([F.lit(" ")] if i else []) + [F.coalesce(col(p).cast("string"), F.lit(""))]])
    return F.coalesce(F.nullif(F.trim(joined), F.lit("")), F.lit(label))


def strip_article(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?i)^al[\s\-]+", "")


def lookup_candidates(value: Column | str, prop: str, strict: bool = False) -> Column:
    """Distinct lower-case forms of a value to look for; for names also other spellings."""
    raw = F.lower(trimmed(value))
    if prop != "normalized_name":
        return F.array_compact(F.array(F.nullif(raw, F.lit(""))))
    name = canonical_name(value, composed=False)
    spaced = F.regexp_replace(name, "-", " ")
    forms = [raw, name, spaced, strip_article(raw), strip_article(name), strip_article(spaced)]
    if not strict:
        forms.append(F.regexp_replace(spaced, " ", "-"))
    return F.array_distinct(F.array_compact(F.array(*(F.nullif(trimmed(f), F.lit("")) for f in forms))))


def digits_only(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(col(c), "[^0-9]", ""), F.lit("")).try_cast("int")


def act_reference(c: Column | str) -> Column:
    """struct(act_type, act_number, act_year) from wording such as "decree no 46 of 2025"."""
    text = F.lower(normalize_space(c))
    found = []
    for alias, kind in ACT_ALIASES.items():
        for tail in (r"\s+(?:no\.?|number)\s*\(?(\d+)\)?\s*(?:of|/)\s*(\d{4})\b", r"\s+(\d+)\s*(?:of|/)\s*(\d{4})\b", r"\s*\(?(\d+)\s*/\s*(\d{4})\)?"):
            p = rf"\b{alias}{tail}"
            found.append(F.when(text.rlike(p), F.struct(F.lit(kind).alias("act_type"), F.regexp_extract(text, p, 1).cast("int").alias("act_number"), F.regexp_extract(text, p, 2).cast("int").alias("act_year"))))
    return F.coalesce(*found)


def json_list(c: Column | str) -> Column:
    """The first bracketed list in a text, as strings; an empty list if there is none that parses."""
    body = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"```(?:json)?", "")
    found = F.regexp_replace(F.regexp_extract(body, r"(?s)\[.*?\]", 0), r",\s*\]", "]")
    return F.coalesce(F.filter(F.from_json(found, "array<string>"), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def query_body(c: Column | str) -> Column:
    """The first fenced block, or all; without blank lines and comment lines."""
    c = F.coalesce(col(c), F.lit(""))
    fence = r"(?s)```(?:\w+)?\s*(.*?)```"
    body = F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)
    return F.array_join(F.filter(F.transform(F.split(body, "\n"), trimmed), lambda x: (x != "") & ~x.startswith("//")), "\n")


def relation_directions(c: Column | str) -> Column:
    """Turn two relations that are often written the wrong way round."""
    c = F.regexp_replace(col(c), r"\((\w*:Institution[^)]*)\)-\[(\w*:IMPOSED_BY[^\]]*)\]->\((\w*:Penalty[^)]*)\)", r"($3)-[$2]->($1)")
    return F.regexp_replace(c, r"\((\w*:Company[^)]*)\)-\[(\w*:IMPOSED_ON[^\]]*)\]->\((\w*:Penalty[^)]*)\)", r"($3)-[$2]->($1)")


def pascal_case(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(F.lower(col(c)), "_"), F.initcap), "")


def cut(c: Column | str, n: int, mark: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def first_filled(*cs: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs))
