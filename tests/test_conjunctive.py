"""Conjunctive patterns against brute force."""

from __future__ import annotations

import random
import re

import pytest

from quillgraph.plans import conjunctive

LINKS = "qid long, ord int, source string, target string, type string, src_label string, dst_label string"
HELD = "qid long, var string, element_id string"
EDGES = "type string, src_label string, src_id string, dst_label string, dst_id string"


def brute(links, held, required, edges, limit=10):
    by_rule, questions, out = {}, {}, {}
    for t, sl, s, dl, d in edges:
        by_rule.setdefault((t, sl, dl), set()).add((s, d))
    for x in links:
        questions.setdefault(x[0], []).append(x)
    for q, own in questions.items():
        ends = {}
        for qid, v, i in held:
            if qid == q:
                ends.setdefault(v, set()).add(i)
        if any(qid == q and v not in ends for qid, v in required):
            continue
        names = ("ord", "source", "target", "type", "src_label", "dst_label")
        order = [n for p in conjunctive.walk([dict(zip(names, x[1:], strict=True)) for x in own], set(ends)) for n in p["names"]]
        rows = [{}]
        for _, _, s, d, *rule in own:
            rows = [
                {**r, s: a, d: b}
                for r in rows
                for a, b in by_rule.get(tuple(rule), ())
                if (s != d or a == b) and r.get(s, a) == a and r.get(d, b) == b and a in ends.get(s, {a}) and b in ends.get(d, {b})
            ]
        for i, ids in enumerate(sorted({tuple(r[n] for n in order) for r in rows})[:limit]):
            out[q, i + 1] = dict(zip(order, ids, strict=True))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rows_match_brute_force(spark, seed):
    rng = random.Random(seed)
    labels = ["A", "B"]
    some = lambda x: f"{x.lower()}{rng.randrange(5)}"
    edges = [(rng.choice("TU"), s, some(s), d, some(d)) for s, d in ((rng.choice(labels), rng.choice(labels)) for _ in range(60))]
    links, held, required = [], [], []
    for q in range(40):
        variables = {f"v{i}": rng.choice(labels) for i in range(4)}
        for o in range(rng.randrange(1, 4)):
            s, d = rng.choice([*variables]), rng.choice([*variables])
            links.append((q, o, s, d, rng.choice("TU"), variables[s], variables[d]))
        held += [(q, v, some(label)) for v, label in variables.items() if rng.random() < 0.3 for _ in range(rng.randrange(1, 3))]
        required += [(q, "v0")] if rng.random() < 0.15 else []
    frame = spark.createDataFrame
    found = conjunctive.matched(frame(links, LINKS), frame(held, HELD), frame(edges, EDGES), frame(required, "qid long, var string"))
    assert {(r.qid, r.ord): dict(r.ids) for r in found.collect()} == brute(links, held, required, edges)


def test_a_row_of_two_links_meets_both_and_hubs_keep_their_first_rows(spark):
    frame = spark.createDataFrame
    edges = [("T", "A", f"a{i:04}", "B", "hub") for i in range(3000)] + [("U", "B", "hub", "C", "c"), ("T", "A", "a0000", "B", "other")]
    links = [(1, 0, "x", "y", "T", "A", "B"), (1, 1, "y", "z", "U", "B", "C"), (2, 0, "x", "y", "T", "A", "B")]
    found = conjunctive.matched(frame(links, LINKS), frame([(1, "z", "c"), (2, "y", "hub")], HELD), frame(edges, EDGES))
    rows = {(r.qid, r.ord): dict(r.ids) for r in found.collect()}
    assert len(rows) == 20 and rows[1, 10] == {"x": "a0009", "y": "hub", "z": "c"} and rows[2, 1] == {"x": "a0000", "y": "hub"}
    told = conjunctive.pattern_edges(found, frame(links, LINKS)).where("qid = 1 AND ord = 1").orderBy("link").collect()
    assert [(r.type, r.src_id, r.dst_id) for r in told] == [("T", "a0000", "hub"), ("U", "hub", "c")]


def test_no_links_no_rows(spark):
    frame = spark.createDataFrame
    assert conjunctive.matched(frame([], LINKS), frame([(1, "x", "a")], HELD), frame([], EDGES)).count() == 0


def test_questions_of_one_pattern_and_nodes_are_matched_once_and_hubs_are_not_read_for_each(spark, monkeypatch):
    frame = spark.createDataFrame
    links = [(q, i, *x) for q in range(400) for i, x in enumerate([(f"a{q}", "i", "T", "A", "B"), ("c", "i", "U", "C", "B")])]
    edges = [("T", "A", f"a{i:03}", "B", "hub") for i in range(400)] + [("U", "C", f"c{i:03}", "B", "hub") for i in range(300)]
    held = [(q, "i", "hub") for q in range(200)] + [(q, f"a{q}", f"a{q:03}") for q in range(200, 400)] + [(q, "c", f"c{q % 7:03}") for q in range(300, 400)]
    plan = conjunctive.planned(frame(links, LINKS), frame(held, HELD))
    assert plan.where("qid < 200").select("pid").distinct().count() == 1
    assert plan.where("qid >= 200").select("pid").distinct().count() == 200
    read = []
    edges_of = conjunctive._edges_of
    monkeypatch.setattr(conjunctive, "_edges_of", lambda *a: read.append(edges_of(*a).count()) or edges_of(*a))
    monkeypatch.setattr(conjunctive, "QUESTIONS", 16)
    found = conjunctive.matched(frame(links, LINKS), frame(held, HELD), frame(edges, EDGES))
    rows = {}
    for r in found.collect():
        rows.setdefault(r.qid, []).append((r.ord, r.ids[f"a{r.qid}"], r.ids["c"]))
    first = [(n + 1, "a000", f"c{n:03}") for n in range(10)]
    assert all(sorted(rows[q]) == first for q in range(200))
    assert all(sorted(rows[q]) == [(n, f"a{q:03}", c) for n, _, c in first] for q in range(200, 300))
    assert all(rows[q] == [(1, f"a{q:03}", f"c{q % 7:03}")] for q in range(300, 400))
    assert sum(read) < 2500  # 400 questions by the hub's 700 edges: 160,000


def test_rows_of_one_part_are_not_brought_together_to_learn_its_steps(spark, monkeypatch):
    """What a step does is broadcast by shape: a part from anywhere has as many rows as there are edges."""
    frame = spark.createDataFrame
    edges = [("T", "A", f"a{i:04}", "B", f"b{i % 50}") for i in range(2000)] + [("U", "B", f"b{i}", "C", "c") for i in range(40)]
    links = [(q, i, *x) for q in range(5) for i, x in enumerate([("x", "y", "T", "A", "B"), ("y", "z", "U", "B", "C")])]
    plans, keep = [], conjunctive.kept
    monkeypatch.setattr(conjunctive, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = conjunctive.matched(frame(links, LINKS), frame([], HELD), frame(edges, EDGES))
        monkeypatch.setattr(conjunctive, "SHAPES", 0, raising=False)
        others = conjunctive.matched(frame(links, LINKS), frame([], HELD), frame(edges, EDGES))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not [p for p in plans[: len(plans) // 2] if re.search(r"SortMergeJoin(\(skew=true\))? \[pid#\d+\], \[pid#\d+\]", p)]
    rows = {(r.qid, r.ord): dict(r.ids) for r in found.collect()}
    assert len(rows) == 50 and rows[4, 2] == {"x": "a0001", "y": "b1", "z": "c"} and rows == {(r.qid, r.ord): dict(r.ids) for r in others.collect()}
