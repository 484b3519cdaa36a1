"""A training corpus in stages: good documents, one of each group of near copies, without
benchmark passages, mixed by source, as token ids in an archive.

Each stage reads what the one before has kept, written as Parquet, and all but the last
return the columns of ``documents``, whatever more of them there are and however they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, labelled, mixing, ngram_join, quality, token_archive
from quillgraph.llm.common import bounded_batches, joinable, saved, set_aside, table

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker of the last stage remembers: fewer than alone, since executors hold what the stages before have left.
PIECES = 60_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good by the quality classifier; a null id is kept under its own score.

    The score depends on the text alone, so a text gets the same verdict wherever it stands.
    """
    bounded_batches(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    docs, named_back = set_aside(docs, {"score"})
    return named_back(labelled.with_score(docs, model).where(F.col("score") >= 0.5).drop("score"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five words, 0.8): the least id, then text hash, then the other columns.

    A null id comes last. Documents without words are linked with nothing and stay, repeated rows of them too.
    """
    bounded_batches(spark)
    docs, named_back = set_aside(docs, {"at0", "at1", "text_hash", "every", "nth"})
    classes = ngram_join.near_duplicates(docs, located=True)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    best = classes.where("part IS NOT NULL").groupBy("part").agg(F.min(place).alias("at")).select("at.doc_id", "at.text_hash", F.lit(False).alias("every"))
    bare = classes.where("part IS NULL").select("doc_id", "text_hash", F.lit(True).alias("every"))
    kept = best.union(bare).distinct().select(*(e.alias(f"at{i}") for i, e in enumerate(joinable("doc_id"))), "text_hash", "every")
    marks = ["at0", "at1", "text_hash"]
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    marked = docs.select("*", *(e.alias(f"at{i}") for i, e in enumerate(joinable("doc_id"))), F.xxhash64("text").alias("text_hash"))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy(*marks).orderBy(*(rest or marks))))
    return marked.join(kept.hint("merge"), marks).where("every OR nth = 1").select(docs.columns).transform(named_back)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word spans of benchmark passages; n_chars counts what is left."""
    bounded_batches(spark)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs, named_back = set_aside(docs, {"n_words", "hit_spans", "hit_items"})
    found = decontaminate.contaminated_spans(docs, items)
    cut = decontaminate.without_spans(found)
    length = F.when(F.size("hit_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(docs.columns).transform(named_back)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a text's pieces, and once more those that it takes twice."""
    bounded_batches(spark)
    return mixing.mixed_texts(docs, length="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The archive's digest of each text."""
    bounded_batches(spark)
    return token_archive.archived(docs, public_tokenizers.path(VOCABULARY), pieces=PIECES)


STAGES = [
    ("quality", good_documents),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_ids", token_ids),
]

#: A conditional random field has no SQL form; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
