"""Languages of sessions and requests for drafts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import col

# Fixed values.
DISPLAY_NAMES = {"it": "Italian", "en": "English", "es": "Spanish"}
SWITCH = {
    "it": r"(?iuU)\b(?:(?:switch|change|continue|respond|reply|answer|speak|write|talk)\s+(?:in|to)\s+italian|(?:rispondi|continua|parla|scrivi)\s+in\s+italiano|in\s+italiano\s*(?:per\s+favore|prego)?)\b",
    "en": r"(?iuU)\b(?:(?:switch|change|continue|respond|reply|answer|speak|write|talk)\s+(?:in|to)\s+english|(?:rispondi|continua|parla|scrivi)\s+in\s+inglese|(?:responde|continúa|habla|escribe)\s+en\s+inglés|in\s+english\s*please?)\b",
    "es": r"(?iuU)\b(?:(?:switch|change|continue|respond|reply|answer|speak|write|talk)\s+(?:in|to)\s+spanish|(?:rispondi|continua|parla|scrivi)\s+in\s+spagnolo|(?:responde|continúa|habla|escribe)\s+en\s+español|in\s+spanish\s*please?)\b",
}
HINTS = [
    "switch", "change", "continue", "respond", "reply", "answer", "speak", "write", "talk",
    "italian", "english", "spanish", "italiano", "inglese", "spagnolo", "inglés", "español",
    "rispondi", "continua", "parla", "scrivi", "responde", "continúa", "habla", "escribe",
]
ACTIONS = ["genera", "generami", "scrivi", "scrivimi", "redigi", "redigimi", "crea", "creami", "prepara", "preparami", "drafta", "elabora", "elaborami", "formulami", "formula"]
TARGETS = ["opposizione", "atto", "ricorso", "memoria", "decreto", "ingiuntivo"]
STRONG = ["drafta", "redigimi", "generami", "scrivimi"]
DETECT_LENGTH, DETECT_WORDS = 48, 8


def _words(c: Column, pattern: str = r"(?U)\w+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def normalize_language(c: Column | str) -> Column:
    short = F.substring(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), 1, 2)
    return F.when(short.isin(*DISPLAY_NAMES), short).otherwise(F.lit("it"))


def display_name(c: Column | str) -> Column:
    names = F.create_map(*(F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair))
    return F.coalesce(names[normalize_language(c)], F.lit("Italian"))


def should_detect(c: Column | str) -> Column:
    c = F.trim(F.coalesce(col(c), F.lit("")))
    return (F.length(c) >= DETECT_LENGTH) & (F.size(_words(c)) >= DETECT_WORDS)


def explicit_switch(c: Column | str, current: Column | str) -> Column:
    """The language a message asks for, if it isn't the current one; null also where only a provider could tell."""
    c = F.coalesce(col(c), F.lit(""))
    asked = F.when(c.rlike(SWITCH["it"]), "it").when(c.rlike(SWITCH["en"]), "en").when(c.rlike(SWITCH["es"]), "es")
    return F.when(F.arrays_overlap(_words(c), _list(HINTS)) & ~asked.eqNullSafe(col(current)), asked)


def is_generation_request(c: Column | str) -> Column:
    words = _words(F.coalesce(col(c), F.lit("")), "[a-zÀ-ɏ]+")
    both = F.arrays_overlap(words, _list(ACTIONS)) & F.arrays_overlap(words, _list(TARGETS))
    return both | F.arrays_overlap(words, _list(STRONG))


def unclear_switch(c: Column | str) -> Column:
    """Whether a message hints at a language without asking for one in words that are known: only a provider can tell."""
    c = F.coalesce(col(c), F.lit(""))
    known = c.rlike(SWITCH["it"]) | c.rlike(SWITCH["en"]) | c.rlike(SWITCH["es"])
    return F.arrays_overlap(_words(c), _list(HINTS)) & ~known


def switch_reply(reply: Column | str, current: Column | str) -> Column:
    """The language that a provider's reply names, if it isn't the current one; a no, or anything else, is null."""
    said = F.lower(F.trim(F.coalesce(col(reply), F.lit(""))))
    token = F.substring(F.regexp_replace(said, "[^a-z]", ""), 1, 2)
    return F.when(~said.isin("no", "none", "n") & token.isin("it", "en", "es") & ~token.eqNullSafe(col(current)), token)


# What stands in a draft for a field that isn't known, by language.
PLACEHOLDERS = {"es": "[COMPLETAR]", "en": "[TO BE COMPLETED]", "it": "[DA COMPILARE]"}
#: The fields of a case that a draft is made from.
CASE_FIELDS = ["plaintiff", "defendant", "injunction_reference", "court", "amount", "grounds", "date"]


def field_or_placeholder(value: Column | str, label: str, lang: Column | str = "it") -> Column:
    """A field's trimmed value, or the placeholder of ``lang`` (a code, or a column of codes; Italian for any other) with the field's label."""
    code = F.lit(lang) if isinstance(lang, str) else lang
    mark = F.when(code == "es", PLACEHOLDERS["es"]).when(code == "en", PLACEHOLDERS["en"]).otherwise(PLACEHOLDERS["it"])
    return F.coalesce(F.nullif(F.trim(col(value)), F.lit("")), F.concat(mark, F.lit(f" ({label})")))


def case_details(answer: Column | str) -> Column:
    """A map of the fields of a case from a provider's answer, in a code fence or not; a field that is missing, and all of an answer that can't be read, are empty."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(answer), F.lit("")), r"```(?:json)?\s*", ""), r"[`\s]+$", ""))
    read = F.from_json(body, "map<string,string>")
    return F.create_map(*(x for f in CASE_FIELDS for x in (F.lit(f), F.coalesce(F.try_element_at(read, F.lit(f)), F.lit("")))))
