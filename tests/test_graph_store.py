"""Loads into the bucketed graph: equal to one load, touching what they must, counted, and safe when broken off."""

from __future__ import annotations

import os

import pytest

from quillgraph.operators import graph, graph_store

NODES, EDGES = graph_store.SCHEMA["nodes"], graph_store.SCHEMA["edges"]


def node(i, seq, label="Company", **props):
    return (label, f"n{i}", props, seq)


def edge(a, b, seq, **props):
    return ("T", "Company", f"n{a}", "Company", f"n{b}", props, seq)


def told(rows):
    return sorted((tuple(v for k, v in r.asDict().items() if k not in ("props", "seq")), sorted(r.props.items())) for r in rows.collect())


def test_two_loads_equal_one(spark, tmp_path):
    first = [node(i, i, name=f"old {i}", kept="k") for i in range(40)], [edge(i, i + 1, i, w="1") for i in range(39)]
    second = [node(i, i, name=f"new {i}", kept=None if i == 3 else "k") for i in range(0, 60, 3)], [edge(i, i + 2, i, w="2") for i in range(0, 30, 5)] + [edge(0, 1, 99, x="y")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), 8)
    counts = store.load(frame(first[0], NODES), frame(first[1], EDGES), "one")
    assert (counts["nodes_processed"], counts["nodes_created"], counts["edges_created"], counts["edges_dropped"]) == (40, 40, 39, 0)
    counts = store.load(frame(second[0], NODES), frame(second[1], EDGES), "two")
    assert (counts["nodes_processed"], counts["nodes_created"]) == (20, 6)
    later = lambda rows: [(*r[:-1], r[-1] + 1000) for r in rows]
    nodes = graph.upsert_nodes(frame(first[0] + later(second[0]), NODES))
    edges = graph.upsert_edges(frame(first[1] + later(second[1]), EDGES), nodes)
    assert told(store.nodes()) == told(nodes) and told(store.edges()) == told(edges)
    before = told(store.nodes())
    assert store.load(frame(second[0], NODES), frame([], EDGES), "two") == counts and told(store.nodes()) == before
    assert store.vacuum() > 0 and told(store.nodes()) == before


def test_only_touched_buckets_are_written_and_drops_are_counted(spark, tmp_path):
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), 16)
    store.load(spark.createDataFrame([node(i, i, name="x") for i in range(200)], NODES), spark.createDataFrame([], EDGES), "one")
    held = {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(tmp_path / "g/nodes") for p in names}
    counts = store.load(spark.createDataFrame([node(7, 1, name="y"), (None, "n9", {}, 2)], NODES), spark.createDataFrame([edge(7, 8, 1), edge(7, 999, 2), ("T", "Company", None, "Company", "n7", {}, 3)], EDGES), "two")
    assert counts["buckets_written"] == 2 and counts["nodes_dropped"] == 1 and counts["edges_dropped"] == 2 and counts["edges_created"] == 1 and counts["nodes_created"] == 0
    after = {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(tmp_path / "g/nodes") for p in names}
    assert {p: t for p, t in after.items() if p in held} == held
    assert store.nodes().count() == 200 and store.nodes().where("node_id = 'n7'").first().props == {"name": "y"}


def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), 4)
    store.load(spark.createDataFrame([node(1, 1, name="x")], NODES), spark.createDataFrame([], EDGES), "one")
    monkeypatch.setattr(graph, "resolved", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.load(spark.createDataFrame([node(1, 1, name="y"), node(2, 1)], NODES), spark.createDataFrame([edge(1, 2, 1)], EDGES), "two")
    monkeypatch.undo()
    assert store.nodes().first().props == {"name": "x"}
    store.load(spark.createDataFrame([node(2, 1)], NODES), spark.createDataFrame([edge(1, 2, 1)], EDGES), "two")
    assert store.nodes().count() == 2 and store.edges().count() == 1
    store.cleared("three")
    assert store.nodes().count() == 0 and store.history().count() == 3


def test_upsert_tasks_grow_with_records(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARE", 50)
    rows = spark.range(2000).selectExpr("'A' AS label", "CAST(id % 700 AS STRING) AS node_id", "map('k', CAST(id AS STRING), 'gone', IF(id < 700, 'x', NULL)) AS props", "id AS seq")
    merged = graph.upsert_nodes(rows)
    assert merged.rdd.getNumPartitions() == 40
    found = {r.node_id: (r.props, r.seq) for r in merged.collect()}
    latest = {str(i % 700): i for i in range(2000)}
    assert found == {k: ({"k": str(i)}, i) for k, i in latest.items()}
    edges = spark.range(2000).selectExpr("'T' AS type", "'A' AS src_label", "CAST(id % 700 AS STRING) AS src_id", "'A' AS dst_label", "CAST(id % 900 AS STRING) AS dst_id", "map('k', 'v') AS props", "id AS seq")
    linked = graph.upsert_edges(edges, merged)
    assert linked.rdd.getNumPartitions() == 40
    assert {(r.src_id, r.dst_id): r.seq for r in linked.collect()} == {(str(i % 700), str(i % 900)): i for i in range(2000) if i % 900 < 700}


def test_lines_are_numbered_where_they_are_read(spark, tmp_path, capsys):
    from quillgraph.sources import files

    spark.range(500).selectExpr("CONCAT('line ', id) AS value").repartition(3).write.text(str(tmp_path / "lines"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = files.ordered_lines(spark, str(tmp_path / "lines"))
        assert sorted(r.seq for r in lines.collect()) == list(range(500))
        capsys.readouterr()
        lines.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert not shuffled and "BroadcastHashJoin" in plan
