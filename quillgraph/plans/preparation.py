"""What is worked out for a question before it is matched, and for a request before a draft is written: phrases, keywords, schema, case details.

Each step asks a provider for all rows at once, each distinct text once, and has a defined result where the provider fails or says nothing of use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.functions import language
from quillgraph.functions.text import json_list
from quillgraph.operators.answer import section_block
from quillgraph.operators.answer_store import AnswerStore, store
from quillgraph.operators.cut import kept
from quillgraph.operators.decompose import keywords

Provider = Callable[[list[str]], list]


def phrases(questions: DataFrame, generalizer: Provider, keyworder: Provider, answers: AnswerStore | None = None) -> DataFrame:
    """qid, question, phrase, keywords: a short phrase for a question's topic, and up to three keywords of it.

    Without a phrase the question stands for it; without keywords there are none. Questions that differ but have one phrase ask for its keywords once.
    """
    held = answers or store(questions.sparkSession)
    told = held.answered(questions, ["qid"], "question", "phrases", generalizer).select("qid", F.nullif(F.trim("value"), F.lit("")).alias("phrase"))
    rows = kept(questions.select("qid", "question").join(told, "qid").withColumn("phrase", F.coalesce("phrase", "question")))
    listed = held.answered(rows, ["qid"], "phrase", "keywords", keyworder).select("qid", keywords("value").alias("keywords"))
    return rows.join(listed, "qid")


def chosen_schema(questions: DataFrame, label_chooser: Provider, type_chooser: Provider, answers: AnswerStore | None = None) -> DataFrame:
    """qid, labels, types: the part of the schema that a question needs.

    questions: qid, question, keywords (array), anchors (labels of its entry and context nodes). The first provider picks labels, the second relation types among those whose
    ends are both picked. An answer that isn't a filled list means all: all labels, or all of those types; where a provider fails, all of the schema. Without types to pick from there are none.
    """
    spark = questions.sparkSession
    held = answers or store(spark)
    every = F.array(*map(F.lit, catalog.ENTITIES))
    line = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("(none)"))
    text = F.concat(F.lit("Labels: " + ", ".join(catalog.ENTITIES) + "\nMatched: "), line(F.array_sort("anchors")), F.lit("\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nKeywords: "), line("keywords"))
    asked = kept(questions.select("qid", "question", text.alias("text")))
    first = held.answered(asked, ["qid"], "text", "schema-labels", label_chooser)
    listed = json_list("value")
    labels = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(every)
    rows = kept(asked.select("qid", "question").join(first.select("qid", labels.alias("labels"), F.col("error").isNotNull().alias("failed")), "qid"))
    # Rules meet each distinct list of labels, not each question.
    rules = F.broadcast(catalog.relations(spark).select("from_label", "type", "to_label"))  # the schema's rules
    met = rows.select("labels").distinct().join(rules, F.array_contains("labels", F.col("from_label")) & F.array_contains("labels", F.col("to_label")))
    candidate = F.format_string("(%s)-[%s]->(%s)", "from_label", "type", "to_label")
    told = met.groupBy("labels").agg(F.array_sort(F.collect_set("type")).alias("candidates"), F.array_join(F.array_sort(F.collect_set(candidate)), "\n").alias("lines"))
    rows = rows.join(kept(told), "labels", "left")
    rows = kept(rows.withColumn("text", F.concat(F.lit("Labels: "), F.array_join("labels", ", "), F.lit("\nRelations:\n"), "lines", F.lit("\nQuestion: "), F.coalesce("question", F.lit("")))).drop("lines"))
    second = held.answered(rows.where("candidates IS NOT NULL"), ["qid"], "text", "schema-types", type_chooser)
    joined = rows.join(second.select("qid", json_list("value").alias("picked"), F.col("error").isNotNull().alias("also_failed")), "qid", "left")
    none = F.array().cast("array<string>")
    types = F.when(F.col("candidates").isNull(), none).when(F.coalesce(F.size("picked"), F.lit(0)) > 0, F.col("picked")).otherwise(F.col("candidates"))
    whole = F.array(*map(F.lit, sorted({t for _, t, _ in catalog.RELATIONS})))
    broken = F.col("failed") | F.coalesce("also_failed", F.lit(False))
    return joined.select("qid", F.when(broken, every).otherwise(F.col("labels")).alias("labels"), F.when(broken, whole).otherwise(types).alias("types"))


# What a placeholder says of each field of a case.
FIELD_NAMES = {
    "plaintiff": "nome opponente / opposing party name",
    "defendant": "nome opposto/creditore / creditor name",
    "injunction_reference": "n. decreto ingiuntivo / order reference",
    "court": "tribunale / court",
    "amount": "importo / amount",
    "grounds": "grounds of opposition",
    "date": "data / date",
}


def drafts(requests: DataFrame, extractor: Provider, writer: Provider, answers: AnswerStore | None = None) -> DataFrame:
    """request_id, details (map), brief, draft: case details from a message, what a draft is to be written from, and the draft.

    requests: request_id, message, language, sections (array of struct<title,text,source>). ``extractor`` gives details as JSON; fields that it doesn't know are
    placeholders of the language. ``writer`` reads the brief, whose first line names the language; a draft that fails is null.
    """
    held = answers or store(requests.sparkSession)
    told = held.answered(requests, ["request_id"], "message", "case-details", extractor)
    rows = requests.join(told.select("request_id", language.case_details("value").alias("details")), "request_id")
    code = language.normalize_language("language")
    field = lambda f: language.field_or_placeholder(F.try_element_at("details", F.lit(f)), FIELD_NAMES[f], code)
    parts = [F.concat(F.lit("Language: "), code), *(F.concat(F.lit(f"{f}: "), field(f)) for f in FIELD_NAMES), F.lit("Sections:"), section_block(F.col("sections"), code)]
    rows = kept(rows.select("request_id", "details", F.concat_ws("\n", *parts).alias("brief")))
    written = held.answered(rows, ["request_id"], "brief", "drafts", writer)
    return rows.join(written.select("request_id", F.col("value").alias("draft")), "request_id")
