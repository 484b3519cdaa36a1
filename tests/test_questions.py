"""The question loop's parts: hubs, context at the links' ends, the third tier, written patterns and their errors, answers."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quillgraph.operators import answer, link, search, text_index
from quillgraph.plans import questions

NODES = "element_id string, label string, labels array<string>, props map<string,string>"
EDGES = "type string, src_label string, src_id string, dst_label string, dst_id string"


def graph(spark):
    nodes = [("d1", "Document", ["Document"], {"document_id": "7", "document_title": "Gazette"}), ("d2", "Document", ["Document"], {"document_id": "8"})]
    nodes += [(f"s{i}", "Section", ["Section"], {"title": f"Part {i}"}) for i in range(4)] + [("c1", "Company", ["Company"], {"normalized_name": "acme trading", "name": "Acme"})]
    edges = [("HAS_CHUNK", "Document", "d1", "Section", f"s{i}") for i in range(3)] + [("HAS_CHUNK", "Document", "d2", "Section", "s3"), ("MENTIONS", "Section", "s1", "Institution", "i1")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def told(**more):
    """A decomposer: a document by its id with a section in it, and other entities."""
    links = more.pop("links", [{"source_id": "a", "target_id": "b", "type": "CONTAINS"}, {"source_id": "a", "target_id": "b", "type": "HAS_CHUNK"}])
    nodes = [{"id": "a", "label": "Document", "properties": {"document_id": more.pop("document", "7")}}, {"id": "b", "label": "Section", "properties": {"title": "x"}}, *more.pop("extra", [])]
    return lambda texts: [json.dumps({"nodes": nodes, "relationships": links})] * len(texts)


def ask(spark, decomposer, **more):
    asked = spark.createDataFrame([(1, "what is in it")], "qid long, question string")
    return questions.answered(asked, *graph(spark), decomposer, **more).first()


def context(spark, *ids):
    return lambda rows: rows.select("qid").join(spark.createDataFrame([(i, 0.5) for i in ids], "element_id string, score double"))


def test_neighbours_of_hubs_are_those_of_all_edges(spark):
    rng = random.Random(1)
    edges = [("T", "A", f"a{rng.randrange(40):02}", "B", rng.choice(["hub", f"b{rng.randrange(9)}"])) for _ in range(600)]
    frame = spark.createDataFrame(edges, EDGES)
    anchors = [(1, "hub"), (2, "a03"), (2, "b1"), (3, "nowhere"), (4, "hub"), (4, "a00")]
    found = questions.neighbour_rows(spark.createDataFrame(anchors, "qid long, element_id string"), questions.adjacent(frame))
    got = {(r.qid, r.ord): (r.nodes[0].element_id, r.nodes[1].element_id) for r in found.collect()}
    expected = {}
    for q in (1, 2, 3, 4):
        own = {i for k, i in anchors if k == q}
        for n, pair in enumerate(sorted({(s, d) for _, _, s, _, d in edges if s in own or d in own})[:10]):
            expected[q, n + 1] = pair
    assert got == expected
    assert "WindowGroupLimit" in questions.adjacent(frame)._jdf.queryExecution().executedPlan().toString()


def test_context_holds_the_free_ends_of_links(spark):
    row = ask(spark, told(), context=context(spark, "s2", "s3"))
    assert (row.attempt, row.n_entry, row.n_context, row.n_rows) == ("intersection", 1, 2, 1)
    row = ask(spark, told(), context=context(spark, "s3"))  # another document's section: no rows, then the links alone
    assert (row.attempt, row.n_rows, row.citations) == ("fallback", 3, ["Gazette"])
    row = ask(spark, told(), context=lambda rows: rows.limit(0).select("qid", F.lit("x").alias("element_id"), F.lit(0.0).alias("score")))
    assert (row.attempt, row.n_rows) == ("fallback", 3)


def test_what_is_asked_for_and_not_there_gives_no_rows(spark):
    row = ask(spark, told(document="999"))
    assert (row.attempt, row.n_entry, row.n_rows, row.error) == ("abort", 0, 0, questions.NO_ENTRY)
    other = [{"id": "c", "label": "Company", "properties": {"name": "Acme Trading"}}]
    row = ask(spark, told(document="999", extra=other))  # an entry node, but the links' own end isn't there
    assert (row.attempt, row.n_entry, row.n_rows) == ("fallback", 1, 0)


def test_a_third_tier_finds_what_keys_and_properties_do_not(spark, tmp_path):
    nodes, _ = graph(spark)
    texts = nodes.select("element_id", F.array_join(F.map_values("props"), " ").alias("text"), "labels")
    index = text_index.build(texts, str(tmp_path / "t"))
    lookup = lambda rows: link.text_lookup(rows, index, ["Company", "Section"], 1)
    row = ask(spark, told(document="999", links=[], extra=[{"id": "c", "label": "Company", "properties": {"legal_form": "trading"}}]), lookup=lookup)
    assert row.n_entry == 1  # the company, by a word
    entities = spark.createDataFrame([(1, "x", "Document", {"document_id": "7"}), (1, "y", "Company", {"name": "acme"})], "qid long, id string, label string, props map<string,string>")
    matches = link.linked(entities, nodes, spark.createDataFrame([("Company", "normalized_name")], "label string, prop string"), lookup)
    assert {(r.id, r.element_id, r.source, r.tier) for r in matches.collect()} == {("x", "d1", "btree:id_document", 1), ("y", "c1", "fulltext:company", 3)}


def test_written_patterns_run_or_say_why_not(spark):
    links = lambda *x: lambda texts: [json.dumps({"links": [{"source": a, "type": t, "target": b} for a, t, b in x]})] * len(texts)
    row = ask(spark, told(links=[]), planner=links(("a", "HAS_CHUNK", "b")))
    assert (row.attempt, row.n_rows, row.error) == ("intersection", 3, None)
    for planner in (lambda ts: ["MATCH (n)"] * len(ts), links(("a", "AMENDS", "b"))):
        row = ask(spark, told(), planner=planner)
        assert (row.attempt, row.n_rows, row.error) == ("fallback", 3, None)  # edges at the document

    def down(texts):
        raise OSError("no provider")

    row = ask(spark, told(), planner=down, writer=lambda texts: [t.split("\n")[1] for t in texts])
    assert (row.n_rows, row.error, row.answer) == (0, "OSError: no provider", "Note: OSError: no provider")


def test_answers_are_written_from_rows_and_sources(spark):
    row = ask(spark, told(), writer=lambda texts: texts)
    assert row.answer.startswith("Question: what is in it\nData:\n{") and row.answer.endswith("Sources:\nGazette")
    assert '"a":{"labels":["Document"],"document_id":"7","document_title":"Gazette"}' in row.answer
    row = ask(spark, told(), reviewer=lambda texts: ["POOR\nnothing fits"] * len(texts))
    assert (row.attempt, row.rounds, row.verdict_ok) == ("reformulation", 2, True)


def test_summaries_end_before_their_bound(spark):
    rows = spark.createDataFrame([(1, i, {"t": "x" * 90}) for i in range(5)] + [(2, 1, {"t": "x" * 90})], "qid long, ord int, props map<string,string>")
    assert [(r.qid, r.ord) for r in answer.summary(rows, 5, 200).orderBy("qid", "ord").collect()] == [(1, 0), (1, 1), (2, 1)]


def test_searches_without_queries_or_of_two_lengths(spark):
    nodes = spark.createDataFrame([("a", "i", [1.0, 0.0])], "element_id string, index string, embedding array<float>")
    settings = spark.createDataFrame([("i", 1, None)], "index string, k int, min_score double")
    asked = spark.createDataFrame([(1, None)], "qid long, query array<float>")
    assert search.vector_lookup(nodes, asked, settings).count() == 0 and search.vector_lookup(nodes, asked.limit(0), settings).count() == 0
    matches = spark.createDataFrame([(1, "a", "s2", 0.1, ["B"]), (1, "a", "s1", 0.9, []), (1, "b", "s1", None, None)], "qid long, element_id string, source string, score double, labels array<string>")
    assert {(r.element_id, r.score, tuple(r.labels)) for r in search.merged_matches(matches, 5).collect()} == {("a", 0.9, ("B",)), ("b", None, ())}


def test_few_short_questions_are_asked_from_every_core(spark):
    from pyspark import TaskContext

    from quillgraph.operators.providers import called

    rows = spark.range(200).selectExpr("id AS qid", "CONCAT('question ', id) AS question").coalesce(1)
    found = called(rows, "qid", "question", lambda texts: [str(TaskContext.get().partitionId())] * len(texts), spread=True).collect()
    assert sorted(r.qid for r in found) == list(range(200))
    assert len({r.value for r in found}) >= spark.sparkContext.defaultParallelism


def test_all_attempts_share_one_search_of_patterns(spark, monkeypatch):
    searches, matched = [], questions.conjunctive.matched
    monkeypatch.setattr(questions.conjunctive, "matched", lambda *a, **k: searches.append(1) or matched(*a, **k))
    row = ask(spark, told(), context=context(spark, "s3"), reviewer=lambda texts: ["POOR" for _ in texts])
    assert row.rounds == 2 and len(searches) == 1  # the first attempt, the fallback and the reformulation
