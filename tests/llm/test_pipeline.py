from __future__ import annotations

import corpus_pipeline

from quillgraph.llm.common import saved

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(saved(stage(spark, kept[-1], SF), name))
    for before, after in zip(kept, kept[1:-1], strict=False):
        assert after.columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rejected = ids[0] - ids[1]
    good = [i for i, q in labels.items() if q == 1]
    assert len([i for i in rejected if labels.get(i) == 0]) > 0.9 * len([q for q in labels.values() if q == 0])
    assert len([i for i in good if i in rejected]) < 0.02 * len(good)
    assert ids[2] < ids[1] and len(ids[2]) == kept[2].count()
    from quillgraph.llm.decontaminate import contaminated_spans

    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    assert contaminated_spans(kept[2].select("doc_id", "text"), items).where("size(hit_spans) > 0").count() > 0
    assert contaminated_spans(kept[3].select("doc_id", "text"), items).where("size(hit_spans) > 0").count() == 0
    assert ids[4] <= ids[3] and kept[5].count() == kept[4].count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = saved(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_one_row_of_each_class_and_own_pieces_for_repeats(spark):
    a, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    other, third = " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(5, a), (5, a), (None, a), (9, near), (None, third), (None, third), (None, third + " x"), (5, other), (3, other), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(5, a), (0, min(third, third + " x", key=lambda x: spark.range(1).selectExpr(f"xxhash64('{x}')").first()[0])), (3, other), (7, ""), (7, ""), (8, "")])


def test_repeated_rows_have_their_own_pieces(spark):
    from quillgraph.llm import mixing

    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text, "a")] * 7 + [(1, text, "b")] * 5 + [(1, text, None)] * 3 + [(2, "other words here", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, _, pieces = mixing.mix(docs, block=8)
    numbered = mixing.mix(docs, block=8)[0].select("row", "source")
    taken = {r[0]: r[1] for r in pieces.join(numbered, "row").selectExpr("source", "(last - first) * times AS n").groupBy("source").sum("n").collect()}
    mixed = mixing.mixed_texts(docs, block=8).collect()
    words = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in ("a", "b", None)}
    assert words == taken


def test_stages_keep_odd_rows_and_columns_of_any_name(spark):
    """Nulls in any column, empty and very long texts, ties, repeats and columns named like the operators' own."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [None, "", "a", long, long + " end", "plain words that say nothing much at all here", "plain words that say nothing much at all here"]
    rows = [(None if i == 2 else i % 5, x, "en", [None, "s"][i % 2], None if x is None else len(x), f"k{i}", i, "n", 1.5) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pieces string, n_words long, part string, score double")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = saved(stage(spark, docs, SF), name)
        assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "n_words", "part", "score"]
        assert {r.pieces for r in docs.collect()} <= {f"k{i}" for i in range(len(rows))}
    good = corpus_pipeline.good_documents(spark, spark.createDataFrame(rows, docs.schema), SF)
    assert good.columns == docs.columns and {r.score for r in good.collect()} <= {1.5}
    assert corpus_pipeline.token_ids(spark, docs, SF).count() == docs.count()


def test_stages_bound_what_goes_to_workers_at_once(spark):
    from quillgraph.llm.common import BATCH_BYTES, BATCH_SETTING

    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 400) AS text").coalesce(1)
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        corpus_pipeline.token_ids(spark, docs.limit(3), SF)

        def sizes(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

        found = docs.mapInArrow(sizes, "bytes long, rows long").collect()
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)
    assert sum(r["rows"] for r in found) == 4000
    assert sum(r["bytes"] for r in found) > 3 * BATCH_BYTES and max(r["bytes"] for r in found) < 1.5 * BATCH_BYTES
