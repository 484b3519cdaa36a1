"""Matches that tell what was asked give the entry nodes of matches that are joined with their entities."""

from __future__ import annotations

import pytest

from quillgraph.operators import link

ENTITIES = "qid long, id string, ord int, label string, props map<string,string>"
NODES = "element_id string, label string, labels array<string>, props map<string,string>"


def test_told_matches_give_the_same_entry_nodes_without_a_join(spark):
    nodes = spark.createDataFrame([("d1", "Document", ["Document"], {"document_id": "1"}), ("f1", "Company", ["Company"], {"normalized_name": "firm 1"}), ("f2", "Company", ["Company", "X"], {"normalized_name": "firm 1"})], NODES)
    rows = [(1, "a", 2, "Document", {"document_id": "1"}), (1, "b", 1, "Document", {"document_id": "1", "more": "x"}), (1, "c", 3, "Company", {"normalized_name": "FIRM 1"}), (2, "a", 1, "Company", {"normalized_name": "none"}), (3, "a", 1, "Company", None)]
    entities = spark.createDataFrame(rows, ENTITIES)
    lookups = spark.createDataFrame([("Company", "normalized_name")], "label string, prop string")
    told = link.linked(entities, nodes, lookups, told=True)
    got = link.entry_nodes(told, entities)
    wanted = link.entry_nodes(link.linked(entities, nodes, lookups), entities)
    key = lambda r: (r.qid, r.element_id, r.labels, r.sources, sorted(r.props.items()))
    assert sorted(map(key, got.collect())) == sorted(map(key, wanted.collect())) != []
    assert next(r for r in got.collect() if r.element_id == "d1").props["more"] == "x"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < wanted._jdf.queryExecution().optimizedPlan().toString().count("Join")
    with pytest.raises(ValueError):
        link.linked(entities, nodes, lookups, lambda e: e, told=True)
