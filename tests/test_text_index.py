"""The stored full-text index against scoring every document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators import search, text_index


def told(rows):
    return sorted((r.qid, r.element_id, round(r.score, 7)) for r in rows.collect())


@pytest.mark.parametrize(("size", "questions", "limit"), [(40, 7, 3), (8192, 2048, 12), (1, 2048, 1)])
def test_rows_are_those_of_scoring_everything(spark, tmp_path, monkeypatch, size, questions, limit):
    for name, value in (("RANGE_DOCUMENTS", size), ("BLOCK", 4), ("QUESTIONS", questions)):
        monkeypatch.setattr(text_index, name, value)
    rng = np.random.default_rng(size)
    word = lambda: "w" + str(int(rng.zipf(1.4)) % 60)
    rows = [(i, " ".join(word() for _ in range(rng.integers(1, 30))), [["a"], ["b"], ["a", "b"], None][i % 4]) for i in range(120 if size > 1 else 30)]
    rows += [(900 + i, "same words here w1", ["a"]) for i in range(6)] + [(950, None, ["a"]), (951, "", None), (952, "!!", None)]
    docs = spark.createDataFrame(rows, "element_id long, text string, labels array<string>")
    asked = spark.createDataFrame([(q, [word() for _ in range(4)] + ["same"] * (q % 3)) for q in range(15)] + [(98, ["unknown"]), (99, []), (100, None)], "qid long, terms array<string>")
    index = text_index.build(docs, str(tmp_path / "t"))
    assert told(index.search(asked, limit)) == told(search.fulltext_lookup(docs, asked, limit))
    assert told(text_index.opened(spark, str(tmp_path / "t")).search(asked, limit, ["b"])) == told(search.fulltext_lookup(docs, asked, limit, labels=["b"]))
    assert index.search(asked.where("qid = 99"), limit).count() == 0


def test_an_empty_index_finds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "element_id long, text string")
    index = text_index.build(docs, str(tmp_path / "t"))
    assert index.search(spark.createDataFrame([(1, ["a"])], "qid long, terms array<string>")).count() == 0


def test_frequent_words_are_not_read_where_they_cannot_matter(spark):
    docs = np.arange(4096, dtype=np.int32)
    common, rare = np.full(4096, 0.5), np.asarray([2.0, 1.9])
    block = lambda x: [float(x[i : i + text_index.BLOCK].max()) for i in range(0, len(x), text_index.BLOCK)]
    postings = pa.table({"term": ["the", "kiln"], "docs": [docs.tolist(), [7, 4000]], "impacts": [common.tolist(), rare.tolist()], "most": [block(common), block(rare)]}, schema=pa.schema([("term", pa.string()), ("docs", pa.list_(pa.int32())), ("impacts", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))]))
    asked = pa.table({"qid": [1], "terms": [[{"term": "the", "idf": 0.1}, {"term": "kiln", "idf": 5.0}]], "least": [0.0]})
    work: list[int] = []
    found = text_index.range_best(postings, asked, 0, 2, work=work)
    assert sorted(found.column("no").to_pylist()) == [7, 4000] and work[0] <= 4
