"""A stored full-text index, searched for the best documents without scoring all of them.

Documents are dealt into ranges of about ``RANGE_DOCUMENTS``, or ``RANGE_POSTINGS``, by a hash of their id and numbered within. A posting row holds the documents of one
term in one range by number, with what the term adds to each before its rarity (the impact), and the greatest impact of every ``BLOCK`` of them.
So a frequent word has a row a range, and no row is larger than a range.

A search takes asked terms alone and works range by range, questions beside postings, never a row a posting and question. For a question, terms go from the most
to the least that they can add in the range. A block is read only if its greatest impact, with all that the other terms can add, reaches
the k-th score so far; once what is left can't lift a new document there, the rest of the terms are looked up for the documents that are still in it.
The first bound comes from the index: a term's k-th greatest impact anywhere is reached by k documents. What is left out can't
be among the best, so the rows are those of scoring everything.

Rows: element_id is the documents' key; null texts and texts without words count for the corpus figures and are never found; questions without known terms, and no
questions, give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.cut import discarded, kept
from quillgraph.operators.search import term_counts

RANGE_DOCUMENTS, RANGE_POSTINGS, BLOCK, QUESTIONS = 8192, 1 << 22, 64, 2048
#: Greatest impacts kept for each term; searches for more documents begin without a bound.
TOPS = 10
#: Scores that differ by less are ties.
TIE = 1e-9


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    documents: DataFrame  # range, no, element_id, labels
    postings: DataFrame  # range, term, docs, impacts, most
    terms: DataFrame  # term, df, tops
    n: int
    ranges: int

    def search(self, questions: DataFrame, limit: int = 3, labels: list[str] | None = None) -> DataFrame:
        """qid, element_id, score: the best documents by BM25 for each question (qid, terms); with ``labels``, of those that carry one of them."""
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = questions.select("qid", F.explode(F.array_distinct("terms")).alias("term")).join(self.terms, "term")
        least = F.get("tops", F.lit(limit - 1)) if limit <= TOPS and not labels else F.lit(None).cast("double")
        asked = kept(asked.select("qid", "term", idf.alias("idf"), (idf * least).alias("least")))
        each = asked.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("terms"), F.coalesce(F.max("least"), F.lit(0.0)).alias("least"))
        groups = max(1, -(-each.count() // QUESTIONS))
        spread = each.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(groups))).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(max(0, self.ranges - 1)))))
        wanted = self.postings.join(asked.select("term").distinct(), "term", "left_semi").select("range", "term", "docs", "impacts", "most")
        if labels:
            carries = self.documents.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
            allowed = carries.groupBy("range").agg(F.sort_array(F.collect_list("no")).alias("docs"))  # those of a range
            none = F.array().cast("array<double>")
            wanted = wanted.unionByName(allowed.select("range", F.lit(None).cast("string").alias("term"), "docs", none.alias("impacts"), none.alias("most")))
        wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        kind = questions.schema["qid"].dataType.simpleString()
        filtered = bool(labels)

        def best(key: tuple, postings: pa.Table, asked: pa.Table) -> pa.Table:
            return range_best(postings, asked, key[0].as_py(), limit, filtered)

        found = wanted.groupBy("range", F.col("part").cast("long")).cogroup(spread.groupBy("range", F.col("part").cast("long"))).applyInArrow(best, f"qid {kind}, range int, no int, score double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "element_id"))
        named = found.join(self.documents.select("range", "no", "element_id"), ["range", "no"])
        out = kept(named.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "element_id", "score"))
        discarded(asked)
        return out


def range_best(postings: pa.Table, asked: pa.Table, number: int, limit: int, filtered: bool = False, work: list | None = None) -> pa.Table:
    """The best documents of one range for each question; ``work`` collects how many postings each question read."""
    held: dict[str | None, tuple] = {}
    for term, *parts in zip(postings.column("term").to_pylist(), *(postings.column(c) for c in ("docs", "impacts", "most")), strict=True):
        held[term] = tuple(p.values.to_numpy(zero_copy_only=False) for p in parts)
    allowed = held.pop(None, (np.zeros(0, np.int32),))[0] if filtered else None
    size = 1 + max([-1, *(int(d[0][-1]) for d in held.values())])
    mask = np.ones(size, bool)
    if allowed is not None:
        mask[:] = False
        mask[allowed[allowed < size]] = True
    rows, docs, scores = [], [], []
    for q, (terms, least) in enumerate(zip(asked.column("terms").to_pylist(), asked.column("least").to_pylist(), strict=True)):
        here = sorted(((t["idf"], *held[t["term"]]) for t in terms if t["term"] in held), key=lambda x: -x[0] * x[3].max())
        if not here:
            continue
        most = np.asarray([idf * m.max() for idf, _, _, m in here])
        after = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what this term and all later ones can add
        total, read = np.zeros(size), 0
        bound, open_docs = least, None
        for i, (idf, doc, impact, block_most) in enumerate(here):
            if open_docs is None and after[i] < bound - TIE:  # no new document can reach the bound
                open_docs = np.flatnonzero(total > 0)
            if open_docs is None:
                others = after[0] - most[i]
                live = np.flatnonzero(idf * block_most + others >= bound - TIE)
                at = (live[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                at = at[at < len(doc)]
                read += len(at)
                at = at[mask[doc[at]]]
                total[doc[at]] += idf * impact[at]
            else:
                open_docs = open_docs[total[open_docs] + after[i] >= bound - TIE]
                at = np.searchsorted(doc, open_docs)
                hit = (at < len(doc)) & (doc[np.minimum(at, len(doc) - 1)] == open_docs)
                read += len(open_docs)
                total[open_docs[hit]] += idf * impact[at[hit]]
            if size > limit:
                bound = max(bound, float(np.partition(total, size - limit)[size - limit]))
        found = np.flatnonzero((total > 0) & (total >= bound - TIE))
        if work is not None:
            work.append(read)
        rows += [q] * len(found)
        docs.append(found)
        scores.append(total[found])
    index = pa.array(rows, pa.int64())
    return pa.table({"qid": asked.column("qid").take(index), "range": pa.array([number] * len(rows), pa.int32()), "no": pa.array(np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int32)), "score": pa.array(np.concatenate([*scores, np.zeros(0)]))})


def range_postings(group: pa.Table, number: int, mean: float, k1: float, b: float) -> pa.Table:
    """The postings of a range's documents (no, size, terms, tfs), by term: documents by number, impacts, the greatest of every block, and the greatest of all."""
    order = np.argsort(group.column("no").to_numpy())
    group = group.take(pa.array(order)).combine_chunks()
    lists = group.column("terms").combine_chunks()
    words = lists.flatten().dictionary_encode()
    by_name = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    word = place[words.indices.to_numpy()]
    doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))
    tf, size = group.column("tfs").combine_chunks().flatten().to_numpy(), group.column("size").to_numpy()[doc]
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
    at = np.argsort(word, kind="stable")
    doc, impact, count = doc[at], impact[at], np.bincount(word, minlength=len(by_name))
    stops = np.cumsum(count)
    blocks = -(-count // BLOCK)
    begins = np.repeat(stops - count, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    most = np.maximum.reduceat(impact, begins) if len(begins) else impact
    down = np.lexsort((-impact, word[at]))
    nth = np.arange(len(down)) - np.repeat(stops - count, count)
    tops, told = impact[down[nth < TOPS]], np.minimum(count, TOPS)
    array = lambda sizes, x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(x))
    columns = [pa.array(np.full(len(count), number, np.int32)), words.dictionary.take(pa.array(by_name)), array(count, doc.astype(np.int32)), array(count, impact), array(blocks, most), array(told, tops)]
    return pa.table(dict(zip(["range", "term", "docs", "impacts", "most", "tops"], columns, strict=True)))


def build(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75) -> TextIndex:
    """Index documents (element_id, text, and maybe an array ``labels``) under ``path`` in a folder that executors share."""
    spark = docs.sparkSession
    labels = F.col("labels") if "labels" in docs.columns else F.lit(None).cast("array<string>")
    counts = kept(term_counts(docs.withColumn("labels", labels), "element_id", "labels").withColumn("no", F.monotonically_increasing_id()))
    n, mean, total = counts.agg(F.count("*"), F.avg("size"), F.sum(F.size("terms").cast("long"))).first()
    ranges = max(1, -(-n // RANGE_DOCUMENTS), -(-(total or 0) // RANGE_POSTINGS))
    placed = counts.withColumn("range", F.pmod(F.xxhash64("element_id"), F.lit(ranges)).cast("int"))
    # the order of these numbers is that of ``no``, here and in ``range_postings``
    number = F.row_number().over(Window.partitionBy("range").orderBy("no")) - 1
    placed.select("range", number.alias("no"), "element_id", "labels", "size").write.mode("overwrite").parquet(f"{path}/documents")

    def posted(key: tuple, group: pa.Table) -> pa.Table:
        return range_postings(group, key[0].as_py(), mean, k1, b)

    schema = "range int, term string, docs array<int>, impacts array<double>, most array<double>, tops array<double>"
    placed.select("range", "no", "size", "terms", "tfs").groupBy("range").applyInArrow(posted, schema).write.mode("overwrite").parquet(f"{path}/postings")
    # The greatest impacts of a term, from the greatest of each range.
    each = spark.read.parquet(f"{path}/postings").select("term", F.size("docs").alias("df"), "tops")
    most = F.slice(F.sort_array(F.flatten(F.collect_list("tops")), asc=False), 1, TOPS)  # TOPS of each range
    each.groupBy("term").agg(F.sum("df").alias("df"), most.alias("tops")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(ranges).cast("int").alias("ranges")).write.mode("overwrite").parquet(f"{path}/about")
    discarded(counts)
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> TextIndex:
    """An index that ``build`` wrote."""
    n, ranges = spark.read.parquet(f"{path}/about").select("n", "ranges").first()
    return TextIndex(spark, *(spark.read.parquet(f"{path}/{t}") for t in ("documents", "postings", "terms")), n, ranges)
