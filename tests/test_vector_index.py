"""The stored vector index: exact results, recall, odd vectors, and looking entities up by label."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import queries
from quillgraph.operators import search, vector_index
from quillgraph.operators.providers import hashed_vectors

NODES = "element_id long, index string, embedding array<float>"
SETTINGS = "index string, k int, min_score double"
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """All embeddings as one label's, and a fifth of them as another's."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    nodes = rows.select(F.col("vec_id").alias("element_id"), F.lit("all").alias("index"), "embedding")
    nodes = nodes.union(rows.where("vec_id % 5 = 0").select("vec_id", F.lit("some"), "embedding"))
    path = str(tmp_path_factory.mktemp("vectors"))
    return nodes, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), vector_index.build(nodes, path), path


def pairs(found):
    return {(r.qid, r["index"], r.element_id) for r in found.collect()}


def test_recall_and_exact_results(spark, stored):
    nodes, asked, index, path = stored
    settings = spark.createDataFrame([("all", 10, None), ("some", 4, 0.6)], SETTINGS)
    expected = search.vector_lookup(nodes, asked, settings)
    true = pairs(expected)
    near = pairs(index.search(asked, settings))
    assert len(near & true) >= 0.9 * len(true)
    reopened = vector_index.opened(spark, path)
    exact = reopened.search(asked, settings, probes=2, exact=True)
    told = lambda rows: sorted((r.qid, r["index"], r.element_id, r.source, round(r.score, 9)) for r in rows.collect())
    assert told(exact) == told(expected)


def test_searching_shuffles_queries_alone(spark, stored):
    _, asked, index, _ = stored
    plan = index._best(index._probed(asked, 4), {}, 3, True)._jdf.queryExecution().toString()
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan


def test_copies_ties_zeros_and_missing_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK_BYTES", 400)
    rows = [(i, "a", [1.0, 0.0]) for i in range(60)] + [(100, "a", [0.0, 0.0]), (101, "a", None), (102, "a", [-1.0, 0.0]), (103, "a", [0.6, 0.8]), (104, "b", [0.0, 0.0]), (105, None, [1.0, 0.0])]
    nodes = spark.createDataFrame(rows, NODES)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [-1.0, 0.1])], "qid long, query array<float>")
    settings = spark.createDataFrame([("a", 5, None)], SETTINGS)
    index = vector_index.build(nodes, str(tmp_path / "v"), most_lists=3)
    told = lambda rows: sorted((r.qid, r["index"], r.element_id, None if r.score is None else round(r.score, 9)) for r in rows.collect())
    assert told(index.search(asked, settings, probes=1, exact=True)) == told(search.vector_lookup(nodes.where("index IS NOT NULL"), asked, settings))
    assert index.search(asked.limit(0), settings, exact=True).count() == 0
    none = vector_index.build(nodes.limit(0), str(tmp_path / "none"))
    assert none.search(asked, settings, exact=True).count() == 0


def test_entities_are_looked_up_in_their_labels_index(spark, tmp_path):
    names = {"firm_index": ["north trading", "south trading"], "act_index": ["decree one"]}
    rows = [(10 * i + j, index, hashed_vectors([x])[0]) for i, (index, xs) in enumerate(names.items()) for j, x in enumerate(xs)]
    index = vector_index.build(spark.createDataFrame(rows, NODES), str(tmp_path / "v"))
    hints = spark.createDataFrame([("Company", "firm_index"), ("LegalAct", "act_index")], "label string, index string")
    entities = spark.createDataFrame([(1, "a", "Company", {"name": "south trading"}), (1, "b", "Asset", {"name": "south trading"}), (2, "a", "LegalAct", {"title": "decree one"}), (2, "c", "Company", {})], "qid long, id string, label string, props map<string,string>")
    settings = spark.createDataFrame([("firm_index", 1, 0.9), ("act_index", 1, 0.9)], SETTINGS)
    found = vector_index.targeted(entities, index, hints, settings, hashed_vectors, exact=True)
    assert sorted((r.qid, r.id, r.element_id, r.source) for r in found.collect()) == [(1, "a", 1, "vector_targeted:firm_index"), (2, "a", 10, "vector_targeted:act_index")]


def test_vectors_of_other_lengths_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0, 0.0])], NODES)
    with pytest.raises(Exception, match="length|shape"):
        vector_index.build(rows, str(tmp_path / "v"))


def test_registered_query(spark):
    assert np.isclose(queries.queries()["vector_index_topk"](spark, "/root/testdata/sf0.001").agg(F.max("score")).first()[0], queries.queries()["vector_topk"](spark, "/root/testdata/sf0.001").agg(F.max("score")).first()[0])


def test_vectors_do_not_pass_through_the_driver(spark, tmp_path):
    nodes = spark.range(500).selectExpr("id AS element_id", "'x' AS `index`", "array(1.0D, CAST(id % 7 AS DOUBLE)) AS embedding")
    index = vector_index.build(nodes, str(tmp_path / "index"), buckets=2)
    asked = nodes.where("element_id < 9").selectExpr("element_id AS qid", "embedding AS query")
    plan = index._best(index._probed(asked, 4), {}, 3, True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_search_shuffles_no_vectors_and_a_build_shuffles_them_once(spark, stored, tmp_path, monkeypatch):
    nodes, asked, index, _ = stored
    settings = spark.createDataFrame([("all", 10, None), ("some", 4, 0.6)], SETTINGS)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 40, raising=False)
    monkeypatch.setattr(vector_index, "AT_ONCE", 16, raising=False)
    told = lambda rows: sorted((r.qid, r["index"], r.element_id, round(r.score, 9)) for r in rows.collect())
    assert told(index.search(asked, settings, probes=2, exact=True)) == told(search.vector_lookup(nodes, asked, settings))
    plan = index._best(index._probed(asked, 4), {}, 3, True)._jdf.queryExecution().executedPlan().toString()
    assert "query" not in plan.split("== Initial Plan ==")[-1]
    plans, keep = [], vector_index.kept
    monkeypatch.setattr(vector_index, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    built = vector_index.build(nodes, str(tmp_path / "v"))
    assert built.chunks.selectExpr("max(length(packed) / size(ids))").first()[0] == 64 * 4  # 32-bit numbers stay so
    assert not [p for p in plans if "SortMergeJoin" in p]
