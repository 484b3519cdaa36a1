from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.functions import language, text, titles
from quillgraph.operators import answer, chat, emit, graph, link, parse, providers, search
from quillgraph.plans import patterns, preparation, routing
from quillgraph.sources import files
from quillgraph.streaming import sessions as stream_sessions

MD = """<document_metadata>
document_id: gazette-1-2025
language: en
</document_metadata>
<page_start>1</page_start>
text before the first heading is dropped
# Decree No. 46/2025
# Amending a prior decree
Body of the act.
## Article One
1. First clause.
1. First clause.
(2) Second clause <orig>نص</orig>.
<page_start>2</page_start>
## Article (5)
Text on page two.
## Empty
"""


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("title", "kind"),
    [
        ("Article One", "Article"), ("Article Twenty-One", "Article"), ("Decree-Law No. 15", "Decree"), ("Ministerial  Resolution 3", "MinisterialResolution"),
        ("Case No. 12", "Section"), ("Criminal Judgment", "CriminalJudgment"), ("Schedule (A)", "Schedule"), ("12", "Schedule"), ("First: x", "DecisionSection"),
        ("Text After Amendment", "ArticleVersion"), ("Bid Bond", "TenderSection"), ("correction", "Correction"), ("Anything", "Section"), ("", "Section"),
    ],
)
def test_titles(spark, title, kind):
    assert one(spark, titles.chunk_type(titles.clean_title(F.lit(title)))) == kind


def test_markdown_into_chunks(spark):
    docs = spark.createDataFrame([("a", MD), ("b", None), ("c", "no heading")], "path string, text string")
    got = {r.title: r for r in parse.chunks(docs).collect()}
    assert set(got) == {"Decree No. 46/2025 Amending a prior decree", "Article One", "Article (5)"}
    act = got["Decree No. 46/2025 Amending a prior decree"]
    assert (act.chunk_type, act.act.act_number, act.act.act_year, act.page_number) == ("Decree", "46", "2025", 1)
    assert [(c["index"], c.text_en) for c in got["Article One"].clauses] == [("1", "First clause."), ("2", "Second clause .")]
    assert got["Article One"].indices.article == 1 and got["Article (5)"].page_number == 2
    meta = spark.createDataFrame([(MD,), ('<document_metadata>{"a": "1"}</document_metadata>',), ("none",)], "t string").select(parse.document_metadata("t").alias("m"))
    assert [r.m for r in meta.collect()] == [{"document_id": "gazette-1-2025", "language": "en"}, {"a": "1"}, {}]


def test_names_keys_and_lists(spark):
    assert one(spark, text.canonical_name(F.lit("Al-Ｍinistry of Health, (HQ)"))) == "ministry of health hq"
    assert one(spark, text.canonical_name(F.lit("وزارة الصحة"))) is None
    assert one(spark, text.canonical_name(F.lit("وزارة الصحة"), strict=True)) == " "
    assert one(spark, text.number_from_word(F.lit("Twenty"))) == 20
    assert tuple(one(spark, text.act_key(F.lit("Decree-46-2025")))) == ("Decree", 46, 2025)
    assert one(spark, text.act_key(F.lit("Decree-Law-15-1979"))) is None
    assert one(spark, text.key_index(F.lit("Decree-46-2025-1"))) == 1
    assert one(spark, text.json_list(F.lit('x ```json\n["a", "", "b",]\n```'))) == ["a", "b"]
    assert one(spark, text.json_list(F.lit("none"))) == []
    assert one(spark, text.embedding_text([F.lit(None).cast("string"), F.lit(" a"), F.lit("")], "Part")) == "a"
    assert one(spark, text.query_body(F.lit("```cypher\n// c\nMATCH (n)\n\nRETURN n\n```"))) == "MATCH (n)\nRETURN n"
    assert "ministry-of-health" in one(spark, text.lookup_candidates(F.lit("Ministry of Health"), "normalized_name"))
    assert tuple(one(spark, text.act_reference(F.lit("see Amiri Decree No. 46 of 2025")))) == ("Decree", 46, 2025)
    assert one(spark, text.pascal_case(F.lit("COURT_ROOM"))) == "CourtRoom"


def test_language(spark):
    assert one(spark, language.explicit_switch(F.lit("Please reply in English"), F.lit("it"))) == "en"
    assert one(spark, language.explicit_switch(F.lit("Please reply in English"), F.lit("en"))) is None
    assert one(spark, language.explicit_switch(F.lit("hello"), F.lit("it"))) is None
    assert one(spark, language.normalize_language(F.lit("ES-mx"))) == "es" and one(spark, language.normalize_language(F.lit(None).cast("string"))) == "it"
    assert one(spark, language.is_generation_request(F.lit("scrivi un ricorso"))) and not one(spark, language.is_generation_request(F.lit("un ricorso")))
    assert not one(spark, language.should_detect(F.lit("too short")))


def _node(seq, node, **props):
    return ("Company", node, props, seq)


def test_upsert_merges_and_is_idempotent(spark):
    schema = "label string, node_id string, props map<string,string>, seq long"
    rows = spark.createDataFrame([_node(1, "a", name="A", legal_form="LLC"), _node(2, "a", name="AA", legal_form=None), _node(3, "b", name="B")], schema)
    merged = graph.upsert_nodes(rows)
    state = {r.node_id: r.props for r in merged.collect()}
    assert state == {"a": {"name": "AA"}, "b": {"name": "B"}}
    assert {r.node_id: r.props for r in graph.upsert_nodes(merged).collect()} == state
    edges = spark.createDataFrame([("T", "Company", "a", "Company", "b", {"k": "1"}, 1), ("T", "Company", "a", "Company", "b", {"k": "2"}, 2), ("T", "Company", "a", "Company", "z", {}, 3)], "type string, src_label string, src_id string, dst_label string, dst_id string, props map<string,string>, seq long")
    assert [(r.dst_id, r.props) for r in graph.upsert_edges(edges, merged).collect()] == [("b", {"k": "2"})]
    assert [r.dst_id for r in graph.dangling(edges, merged).collect()] == ["z"]


def test_emission_covers_kinds_and_rejects_bad_keys(spark):
    entities = {k: [] for k in emit.ENTITIES}
    blank = lambda kind, **v: {c: v.get(c) for c in emit.ENTITIES[kind]}
    entities["companies"] = [blank("companies", normalized_name="acme", name="Acme", legal_form="LLC")]
    entities["penalties"] = [blank("penalties", company_name="Acme Co", type="Fine", reason="Late filing of papers", amount=0.0, imposing_authority="Min Fin")]
    entities["legal_acts"] = [blank("legal_acts", act_type="Decree", act_number=1, act_year=2020, amends_act="Decree-Law-15-1979", references_acts=["Decree-2-2019", "bad"], topics=["tax"])]
    rows = spark.createDataFrame([("d1", "c1", entities)], emit.schema())
    nodes = {(r.label, tuple(sorted(r.key.items()))): r.props for r in emit.nodes(rows).collect()}
    assert nodes["Penalty", (("penalty_id", "acme_co_fine_late_filing_of_paper"),)] == {"type": "Fine", "reason": "Late filing of papers"}
    kinds = sorted(r.type for r in emit.edges(rows).collect())
    assert kinds == ["HAS_CHUNK", "HAS_CHUNK", "HAS_LEGAL_FORM", "HAS_TOPIC", "IMPOSED_BY", "IMPOSED_ON", "PUBLISHED_IN", "REFERENCES"]
    assert sorted(r.type for r in emit.rejected(rows).collect()) == ["AMENDS", "REFERENCES"]
    assert emit.entity_totals(rows).first().n_entities == 3
    assert {n for _, n, *_ in emit.EDGES} == {t for _, t, _ in catalog.RELATIONS}
    assert len(catalog.ENTITIES) == 25 and len(catalog.RELATIONS) == 43


def test_search_linking_and_patterns(spark):
    nodes = spark.createDataFrame([("a", "i", [1.0, 0.0]), ("b", "i", [0.9, 0.1]), ("c", "i", [0.0, 1.0]), ("d", "j", None)], "element_id string, index string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, query array<float>")
    settings = spark.createDataFrame([("i", 2, 0.99)], "index string, k int, min_score double")
    found = search.vector_lookup(nodes, asked, settings).collect()
    assert sorted(r.element_id for r in found) == ["a", "b"]
    first = spark.createDataFrame([(1, "x", "key")], "qid int, element_id string, source string")
    second = spark.createDataFrame([(1, "y", "name"), (2, "z", "name")], "qid int, element_id string, source string")
    assert sorted((r.qid, r.element_id) for r in search.tiered(first, second).collect()) == [(1, "x"), (2, "z")]
    graph_nodes = spark.createDataFrame([("Document", "d"), ("Section", "s"), ("Section", "t")], "label string, node_id string")
    edges = spark.createDataFrame([("HAS_CHUNK", "Document", "d", "Section", "s")], "type string, src_label string, src_id string, dst_label string, dst_id string")
    assert [tuple(r) for r in patterns.match(patterns.DOCUMENT_SECTIONS, graph_nodes, edges).collect()] == [("d", "s")]
    assert patterns.match(patterns.DOCUMENT_SECTIONS, graph_nodes, edges, aliases=False).count() == 0
    with pytest.raises(ValueError):
        patterns.Pattern(())


def test_routes(spark):
    rows = spark.createDataFrame([("q", "x", 0, 0, "run"), (None, "fallback", 1, 1, "abort"), (None, "intersection", 0, 1, "context_explore"), (None, "intersection", 0, 0, "abort"), (None, "intersection", 2, 0, "fallback")], "query string, attempt string, e int, c int, expected string")
    got = rows.select("expected", routing.after_planning(F.col("query"), F.col("attempt"), F.col("e"), F.col("c")).alias("got"))
    assert all(r.got == r.expected for r in got.collect())
    rows = spark.createDataFrame([("SyntaxError", "intersection", 0, "retry"), ("Invalid x", "fallback", 0, "answer"), ("timeout", "intersection", 0, "answer"), (None, "fallback", 3, "evaluate"), (None, "intersection", 0, "retry"), (None, "fallback", 0, "answer")], "error string, attempt string, n int, expected string")
    got = rows.select("expected", routing.after_execution(F.col("error"), F.col("attempt"), F.col("n")).alias("got"))
    assert all(r.got == r.expected for r in got.collect())
    assert one(spark, routing.verdict_ok(F.lit(" poor\nbecause"))) is False and one(spark, routing.verdict_ok(F.lit(""))) is True


def test_sessions_batch_and_stream_agree(spark, tmp_path):
    events = [(1, 0.0), (1, 3600.0), (1, 7200.001), (2, 5.0), (3, 90000.0)]
    rows = spark.createDataFrame([(u, s) for u, s in events], "user_id int, s double").select("user_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    batch = {(r.user_id, r.n_events) for r in chat.idle_sessions(rows, "user_id", "ts").collect()}
    assert batch == {(1, 2), (1, 1), (2, 1), (3, 1)}
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream_sessions.idle_sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {(r.user_id, r.n_events) for r in spark.table("closed").collect()}
    assert closed <= batch and (1, 2) in closed


def test_caches_history_and_citations(spark):
    cache = spark.createDataFrame([("a", 10), ("b", 11)], "key string, expiry int")
    assert [r.key for r in chat.cache_get(cache, 10).collect()] == ["b"]
    assert sorted(r.key for r in chat.cache_cleanup(cache, 10).collect()) == ["a", "b"]
    messages = spark.createDataFrame([(1, i, "user") for i in range(41)], "s int, n int, role string")
    assert chat.history(messages, "s", "n").agg(F.min("n")).first()[0] == 1
    rows = spark.createDataFrame([("d", "Old", "B", 1), ("d", "New", "A", 2), ("e", None, None, 3)], "document_id string, document_title string, section string, ord int")
    assert {r.document_id: r.citation for r in answer.citations(rows).collect()} == {"d": "New (sections: A, B)", "e": "e"}


def test_providers_keep_errors_by_row(spark):
    def shout(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [x.upper() for x in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, t string")
    got = {r.id: (r.value, r.error) for r in providers.called(rows, "id", "t", shout).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("", None)}
    nodes = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", None), ("c", "y", None)], "element_id string, embedding_text string, embedding array<float>")
    out = {r.element_id: r.embedding for r in providers.with_embeddings(nodes, providers.hashed_vectors).collect()}
    assert out["a"] == [1.0] and out["b"] == out["c"] and len(out["b"]) == 16


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.md").write_text("# B\nx")
    (tmp_path / "in/a.md").write_text("# A\nx")
    (tmp_path / "in/c.txt").write_text("no")
    assert [r.text[:3] for r in files.markdown(spark, str(tmp_path / "in"), limit=1).collect()] == ["# A"]
    docs = files.markdown(spark, str(tmp_path / "in"))
    files.write_documents(parse.chunks(docs), str(tmp_path / "chunks"))
    nodes = spark.createDataFrame([(1, "Company", {"normalized_name": "a"}, {"name": "A"})], "seq long, label string, key map<string,string>, properties map<string,string>")
    edges = spark.createDataFrame([(2, "T", ("Company", {"normalized_name": "a"}), ("Topic", {"label": "x"}), {})], "seq long, type string, src struct<label:string,key:map<string,string>>, dst struct<label:string,key:map<string,string>>, properties map<string,string>")
    files.write_graph(nodes, edges, str(tmp_path / "graph"))
    n, e = files.graph_records(spark, str(tmp_path / "graph"))
    assert n.first().label == "Company" and e.first().dst.key == {"label": "x"}
    (tmp_path / "q.json").write_text('{"queries": ["one", "two"]}')
    assert [r.question for r in files.questions(spark, str(tmp_path / "q.json")).collect()] == ["one", "two"]
    assert files.run_query(spark, "SELECT nothing_there")["success"] is False


def test_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    import json

    folder = tmp_path / "lines"
    folder.mkdir()
    for name, n in (("a.jsonl", 900), ("b.jsonl", 3), ("c.jsonl", 250)):
        (folder / name).write_text("".join(json.dumps({"label": "Company", "key": {"id": "same" if i % 3 else name}, "properties": {"at": f"{name}{i}"}}) + "\n" for i in range(n)))
    (folder / "d.jsonl").write_text('\n  \nno json\n{"label": "Company"}\n{"type": null, "from": {"label": "A", "key": {}}}\n{"type": "T", "label": "Company", "key": {"id": "same"}, "properties": {"at": "last"}}\n[1]\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = files.ordered_lines(spark, str(folder))
        rows = lines.orderBy("seq").collect()
        nodes, edges, broken = files.graph_lines(spark, str(folder))
        merged = graph.upsert_nodes(nodes.select("label", graph.node_id().alias("node_id"), F.col("properties").alias("props"), "seq"))
        last = {r.node_id: r.props["at"] for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(len(rows))) and [r.line for r in rows if r.path.endswith("a.jsonl")] == list(range(1, 901))
    assert [json.loads(r.value)["properties"]["at"] for r in rows if r.path.endswith("c.jsonl")] == [f"c.jsonl{i}" for i in range(250)]
    assert last == {"a.jsonl": "a.jsonl897", "b.jsonl": "b.jsonl0", "c.jsonl": "c.jsonl249", "same": "last"}
    assert edges.count() == 0 and sorted((r.path[-7:], r.line) for r in broken.collect()) == [("d.jsonl", 3), ("d.jsonl", 4), ("d.jsonl", 5), ("d.jsonl", 7)]
    with pytest.raises(ValueError, match="line 3"):
        files.graph_records(spark, str(folder))


def test_emitted_edges_are_what_the_schema_allows():
    from quillgraph import catalog
    from quillgraph.operators import emit

    emitted = {(rule[2], rule[1], rule[4]) for rule in emit.EDGES}
    assert emitted == set(catalog.RELATIONS) - {("Document", "HAS_CHUNK", "Company")}  # no company is a chunk of its own


def test_graph_is_written_counted_and_cleared(spark, tmp_path):
    from quillgraph.operators import extraction

    nodes = spark.createDataFrame([("Company", "a", {"name": "A"}, 1)], "label string, node_id string, props map<string,string>, seq long")
    edges = spark.createDataFrame([], "type string, src_label string, src_id string, dst_label string, dst_id string, props map<string,string>, seq long")
    path = str(tmp_path / "graph")
    assert extraction.written(nodes, edges, path) == {"nodes": 1, "edges": 0}
    extraction.cleared(nodes, edges, path)
    assert spark.read.parquet(f"{path}/nodes").count() == 0


def test_cache_is_saved_and_loaded(spark, tmp_path):
    from datetime import datetime

    from quillgraph.operators import chat

    cache = spark.createDataFrame([("k", "v", datetime(2025, 1, 1))], "key string, value string, expiry timestamp")
    chat.saved_cache(cache, str(tmp_path / "cache"))
    assert [tuple(r) for r in chat.loaded_cache(spark, str(tmp_path / "cache")).collect()] == [tuple(r) for r in cache.collect()]


def test_answers_that_cannot_be_read_give_no_entities(spark):
    from quillgraph.operators import decompose

    answers = spark.createDataFrame([(1, "no json"), (2, None), (3, '{"nodes": [{"id": "a", "label": "Company", "properties": {"name": "X"}}]}')], "qid long, value string")
    entities, links = decompose.question_graph(answers)
    assert [r.qid for r in entities.collect()] == [3] and links.count() == 0
    assert decompose.chosen_labels(F.lit("none"), ["A", "B"]) is not None


def test_a_question_without_a_reviewer_is_answered(spark):
    from quillgraph.plans import questions

    nodes = spark.createDataFrame([("d1", "Document", ["Document"], {"document_id": "7", "document_title": "Gazette"}), ("s1", "Section", ["Section"], {"title": "One"})], "element_id string, label string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("HAS_CHUNK", "Document", "d1", "Section", "s1")], "type string, src_label string, src_id string, dst_label string, dst_id string")
    asked = spark.createDataFrame([(1, "what is in document 7")], "qid long, question string")
    decomposed = lambda texts: ['{"nodes": [{"id": "a", "label": "Document", "properties": {"document_id": "7"}}], "relationships": []}'] * len(texts)
    row = questions.answered(asked, nodes, edges, decomposed).first()
    assert (row.attempt, row.n_entry, row.n_rows, row.verdict_ok, row.citations) == ("fallback", 1, 1, True, ["Gazette"])


def test_ids_by_label_lists_every_node_unless_a_question_bounds_them(spark):
    nodes = spark.range(20).selectExpr("id % 2 AS qid", "id AS element_id", "array('A', IF(id = 19, 'B', 'A')) AS labels")
    found = {r.label: (r.n, r.ids) for r in graph.ids_by_label(nodes.drop("qid")).collect()}
    assert found == {"A": (20, [*range(20)]), "B": (1, [19])}
    told = {(r.qid, r.label): (r.n, r.ids) for r in graph.ids_by_label(nodes, 3).collect()}
    assert told == {(0, "A"): (3, [0, 2, 4]), (1, "A"): (3, [1, 3, 5])}
    assert {(r.qid, r.label): r.n for r in graph.ids_by_label(nodes).collect()} == {(0, "A"): 10, (1, "A"): 10, (1, "B"): 1}


def test_labels_without_a_vector_index_stay_with_none(spark):
    asked = spark.createDataFrame([(1, "Asset"), (2, "Topic"), (3, "Meeting")], "qid long, label string")
    found = {r.qid: r["index"] for r in link.vector_indexes(asked, catalog.label_indexes(spark)).collect()}
    assert found == {1: None, 2: "topic_embeddings", 3: "document_embeddings"}


def test_schema_meets_lists_of_labels_not_questions(spark):
    rows = [(1, ["Tender", "Tender"]), (2, ["Planet"]), (3, []), (4, None), (5, [None, "Vote"])]
    told = catalog.schema_texts(spark, spark.createDataFrame(rows, "qid long, labels array<string>"))
    assert "Aggregate [qid" not in told._jdf.queryExecution().optimizedPlan().toString()
    found = {r.qid: r.schema_text for r in told.collect()}
    assert found.keys() == {1, 5} and found[1] == catalog.schema_text(spark, ["Tender"]).first()[0] and found[5] == catalog.schema_text(spark, ["Vote"]).first()[0]


def test_schema_choice_groups_no_rules_by_question(spark, monkeypatch):
    plans = []
    whole = preparation.kept
    monkeypatch.setattr(preparation, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    rows = spark.createDataFrame([(1, "q", [], []), (2, "p", [], [])], "qid long, question string, keywords array<string>, anchors array<string>")
    labels = lambda texts: ['["Award", "Tender"]' if "Question: q" in t else "none" for t in texts]
    found = {r.qid: r for r in preparation.chosen_schema(rows, labels, lambda texts: ["[]" for _ in texts]).collect()}
    assert (found[1].labels, found[1].types) == (["Award", "Tender"], ["AWARD_OF"])
    assert (len(found[2].labels), found[2].types) == (len(catalog.ENTITIES), sorted({t for _, t, _ in catalog.RELATIONS}))
    assert not any("Aggregate [qid" in p for p in plans)
