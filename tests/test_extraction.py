"""Answers asked once, broken ones listed, and the order of what is written last."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark import TaskContext

from quillgraph.operators import answer_store, emit, extraction

CHUNKS = "document_id string, chunk_id string, chunk_json string"


def counting(folder, answer):
    """A provider that writes a file for each text it is asked, so that calls in any process count, and what it was asked so far."""
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)

    def provider(texts):
        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return [answer(t) for t in texts]

    return provider, lambda: sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def parties():
    return lambda text: json.dumps({"companies": [{"normalized_name": "acme", "name": text, "legal_form": "llc"}, {"normalized_name": text, "name": text}]})


def test_a_text_is_asked_once_through_graph_edges_and_reruns(spark, tmp_path):
    provider, asked = counting(tmp_path / "calls", parties())
    chunks = spark.createDataFrame([("d", f"k{i}", f"name {i % 5}") for i in range(12)], CHUNKS)
    kept = answer_store.store(spark, str(tmp_path / "answers"))
    found = extraction.extracted(chunks, {"group2": provider}, store=kept)
    nodes, edges = extraction.graph_of(found)
    nodes.count(), edges.count(), nodes.count()
    assert asked() == [f"name {i}" for i in range(5)]
    more = chunks.union(spark.createDataFrame([("d", "k20", "another")], CHUNKS))
    assert extraction.extracted(more, {"group2": provider}, store=answer_store.store(spark, str(tmp_path / "answers"))).count() == 13
    assert asked() == sorted(["another", *(f"name {i}" for i in range(5))])


def test_the_last_chunk_wins_and_a_new_load_wins_over_the_stored_graph(spark):
    company = parties()
    load = lambda *names: extraction.extracted(spark.createDataFrame([("d", f"chunk_{i}", n) for i, n in enumerate(names, 8)], CHUNKS), {"group2": lambda ts: [company(t) for t in ts]})
    nodes, edges = extraction.graph_of(load("one", "two", "three"))  # chunk_8, chunk_9, chunk_10
    name = lambda g: g.where("node_id = 'acme'").first().props["name"]
    assert name(nodes) == "three"
    again, links = extraction.graph_of(load("later"), nodes, edges)
    assert name(again) == "later" and again.count() == 5
    assert links.where("type = 'HAS_LEGAL_FORM'").count() == 0  # no topic was extracted


def test_broken_answers_fail_their_group_with_a_reason(spark):
    def answer(texts):
        return [json.loads(t)["say"] for t in texts]

    cases = {"cut": '{"companies": [', "text": "sorry", "list": "[]", "types": '{"companies": "none"}', "null": None, "good": '{"companies": [{"name": "A", "normalized_name": "a"}], "other": 1}', "empty": "{}"}
    chunks = spark.createDataFrame([("d", k, json.dumps({"say": v})) for k, v in cases.items()] + [("d", "raised", "no json")], CHUNKS)
    rows = {r.chunk_id: r for r in extraction.extracted(chunks, {"group2": answer}).collect()}
    assert {k for k, r in rows.items() if r.failed_groups} == {"cut", "text", "list", "types", "null", "raised"}
    assert rows["cut"].errors == {"group2": "broken JSON"} and rows["raised"].errors["group2"].startswith("JSONDecodeError") and rows["null"].errors == {"group2": "no answer"}
    assert len(rows["good"].entities.companies) == 1 and rows["good"].errors == {}


def test_calls_are_tried_again_and_errors_are_asked_again_later(spark, tmp_path):
    flag = tmp_path / "up"

    def shaky(texts):
        if not flag.exists():
            raise OSError("down")
        return [x.upper() for x in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, t string")
    kept = answer_store.store(spark, str(tmp_path / "s"))
    first = {r.id: (r.value, r.error) for r in kept.answered(rows, ["id"], "t", "shout", shaky, retries=1, wait=0).collect()}
    assert set(first.values()) == {(None, "OSError: down")}
    flag.touch()
    second = {r.id: (r.value, r.error) for r in kept.answered(rows, ["id"], "t", "shout", shaky).collect()}
    assert second == {1: ("A", None), 2: ("B", None), 3: ("", None), 4: ("A", None)}
    calls = []
    assert answer_store.asked_texts([str(i) for i in range(9)], lambda ts: calls.append(len(ts)) or ts, 4, 3, 0, 0) == [(str(i), None) for i in range(9)]
    assert sorted(calls) == [1, 4, 4]


def test_every_kind_and_rule_emits_in_one_pass(spark):
    """A row with one filled entity of each kind gives a node of each kind, and an edge for each rule whose ends can be read."""
    def filled(kind):
        out = {}
        for field, kind_of in emit.ENTITIES[kind].items():
            value = {"string": f"{kind}-7-2020", "int": 3, "double": 2.0}.get(kind_of)
            if value is None:
                value = [f"{field}-5-2021"] if kind_of == "array<string>" else [{"name": f"{field} x", "role": "r"}]
            out[field] = value
        return out

    rows = spark.createDataFrame([("doc", "c", {k: [filled(k), None] for k in emit.ENTITIES}), ("doc", "none", {k: None for k in emit.ENTITIES})], emit.schema())
    nodes, edges = emit.nodes(rows), emit.edges(rows)
    assert sorted(r.label for r in nodes.collect()) == sorted(label for label, *_ in emit.NODES.values())
    assert sorted((r.type, r.src_label, r.dst_label) for r in edges.collect()) == sorted((rule[1], rule[2], rule[4]) for rule in emit.EDGES)
    for made in (nodes, edges):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_embeddings_are_made_once_and_added_to_their_labels(spark, tmp_path):
    from quillgraph.operators import providers

    provider, asked = counting(tmp_path / "calls", lambda t: providers.hashed_vectors([t])[0])
    kept = answer_store.store(spark, str(tmp_path / "answers"))
    kind = "element_id string, label string, embedding_text string, embedding array<float>"
    nodes = spark.createDataFrame([("a", "Company", "x", None), ("b", "Company", "x", None), ("c", "Topic", "y", [1.0]), ("d", "Topic", None, None)], kind)
    path = str(tmp_path / "vectors")
    assert providers.write_embeddings(providers.with_embeddings(nodes, provider, held=kept), path) == 3
    more = nodes.union(spark.createDataFrame([("e", "Topic", "x", None), ("f", "Topic", "z", None)], kind))
    assert providers.write_embeddings(providers.with_embeddings(more, provider, held=kept), path) == 2
    assert asked() == ["x", "z"]
    assert {(r.label, r.element_id) for r in spark.read.parquet(path).collect()} == {("Company", "a"), ("Company", "b"), ("Topic", "c"), ("Topic", "e"), ("Topic", "f")}


def test_normalized_documents_are_one_record_each(spark, tmp_path):
    from quillgraph.operators import parse
    from quillgraph.sources import files

    docs = spark.createDataFrame([("a.md", '# Decree No. 46/2025\nBody "quoted".\n## Article One\n1. First clause.\n'), ("b.md", "# Notice\nText\n")], "path string, text string")
    chunks = parse.validated(parse.chunks(docs))
    files.write_normalized(chunks, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 2
    back = files.normalized_documents(spark, str(tmp_path / "n"))
    told = lambda rows: sorted((r.path, r.chunk_type, r.title, r.text_en, str(r.clauses)) for r in rows.collect())
    assert told(back) == told(chunks) and "valid" not in back.columns


def test_texts_that_fail_wait_together():
    calls = []

    def provider(texts):
        calls.append(texts)
        if any(int(t) % 5 == 4 for t in texts):
            raise ValueError("no answer")
        return texts

    began = time.monotonic()
    found = answer_store.asked_texts([str(i) for i in range(100)], provider, 16, 4, 2, 0.1)
    assert time.monotonic() - began < 1.5  # 20 texts, each 0.3 s of waits, in 4 threads: 1.5 s
    assert found == [(None, "ValueError: no answer") if i % 5 == 4 else (str(i), None) for i in range(100)]
    assert all(calls.count([str(i)]) == (3 if i % 5 == 4 else 1) for i in range(96))


def test_few_texts_are_asked_by_all_cores(spark):
    rows = spark.range(64).selectExpr("id AS key", "CAST(id AS STRING) AS text")
    told = answer_store.store(spark).answered(rows, ["key"], "text", "tasks", lambda texts: [str(TaskContext.get().partitionId()) for _ in texts])
    assert told.select("value").distinct().count() == spark.sparkContext.defaultParallelism
