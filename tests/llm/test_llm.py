"""The training-data operators: brute force, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import decontaminate, labelled, lm_scoring, mixing, ngram_join, preference, quality, queries, token_archive, token_counts, topk_search, toxicity

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "a", "a a a a", "it's 'tis we'll  x\n\n y\t", "<|endoftext|> a<|endoftext|>", "日本語 é́ x y", "word " * 3000, "x" * 5000, "\0 nul", "AbC Def ghi jkl mno"]
DOCS = "doc_id long, text string, source string, note string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, ["a", None, "b"][i % 3], None) for i, x in enumerate(ODD)]
    rows += [(3, "a", "a", "again"), (None, "no id here", "b", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_registered_queries_are_all_there():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}) == list(range(1, 14))


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, SF).toPandas()
    order = list(expected.columns)
    assert sorted(map(tuple, got[order].astype(str).values)) == sorted(map(tuple, expected.astype(str).values))


# 1


def test_token_counts_match_the_library(library, documents):
    texts = [x or "" for x in ODD] + documents["text"].tolist()
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(BPE).count(texts).tolist() == expected


def test_token_counts_of_odd_rows(odd, empty, library):
    rows = token_counts.token_counts(odd, BPE).collect()
    assert len(rows) == odd.count()
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (0, 1)} == {(0, 0, False)}
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_states_start_over_when_there_are_too_many(library, documents, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 10)
    texts = documents["text"].tolist()[:20]
    counter = token_counts.TokenCounter(BPE)
    got = [int(counter.count([x])[0]) for x in texts]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


# 2


def test_base_scores_match_brute_force(spark, documents):
    rows = queries.queries()["op2_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    counts, n, learned = Counter(), 0, 0
    words = {i: x.encode().lower().split() for i, x in zip(documents["doc_id"], documents["text"], strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    for i, w in words.items():
        if not held[i]:
            counts.update(w)
            n, learned = n + len(w) + 1, learned + 1
    v = len(counts) + 1
    for i, w in words.items():
        r = rows.loc[i]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((learned + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base)
    assert np.isfinite(rows["score"]).all() and (rows["score"] < 0).all()


def _next_ids(rng, n=3000, opening=2600):
    allowed = np.arange(n) < opening
    return lm_scoring.NextIds(allowed, np.where(allowed, rng.zipf(1.4, n), 0)), allowed


def test_next_ids_sum_to_one_over_the_whole_vocabulary():
    rng = np.random.default_rng(3)
    nexts, allowed = _next_ids(rng)
    assert (nexts.of[allowed] == lm_scoring.CLASSES).any()  # some ids share the last class
    weights = lm_scoring.Attention.new_weights(nexts, lm_scoring.WINDOW, lm_scoring.INPUTS)
    weights = {k: (v + rng.standard_normal(v.shape) * 0.3 * (v > -1e8)).astype(np.float32) for k, v in weights.items()}
    network = lm_scoring.Attention(weights, nexts, lm_scoring.CONTEXT)
    ids = np.flatnonzero(allowed)
    n = len(ids)
    # one sequence for each id, the same ids before it
    before = np.tile([5, 9, 2, 7], n)
    targets = np.repeat(ids, 4)
    p = network.log_probabilities(before, before, targets, np.full(n, 4)).reshape(n, 4)
    assert np.exp(p).sum(axis=0) == pytest.approx(np.ones(4), abs=1e-3)


def test_scores_are_the_same_without_the_cache_of_words(spark, documents, monkeypatch):
    """Counts met in joins give what counts at hand give, and mixing leaves no more than one."""
    docs = spark.createDataFrame(documents[["doc_id", "text"]].head(120))
    voc = public_tokenizers.path("byte_bpe_50k.tiktoken")
    training = F.col("doc_id") % 5 != 0
    cached = {r.doc_id: r for r in lm_scoring.language_model_scores(docs, voc, training).collect()}
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 40)
    joined = {r.doc_id: r for r in lm_scoring.language_model_scores(docs, voc, training).collect()}
    assert cached.keys() == joined.keys()
    for k, r in cached.items():
        assert (r.n_known, r.n_tokens) == (joined[k].n_known, joined[k].n_tokens)
        assert r.score == pytest.approx(joined[k].score, rel=1e-4)
        assert r.base_score == pytest.approx(joined[k].base_score)


def test_words_of_one_first_id_sum_to_one():
    """Known words' own parts and what is left for spelling make up the share of their first id."""
    c = np.array([1, 1, 7, 30])
    mass = c.sum() + 1.0
    left = (lm_scoring.DISCOUNT * len(c) + 1) / mass
    assert left + ((c - lm_scoring.DISCOUNT) / mass).sum() == pytest.approx(1)


def test_words_with_rare_white_space_keep_their_ids():
    tool = lm_scoring.subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = [w.encode() for w in ("abc\u00a0", "\x1cdef", "plain", "\u2003", "x\u3000y", "end")]
    ids, sizes = tool.ids(words)
    assert len(sizes) == len(words) and sizes.sum() == len(ids)
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        assert tool.ids([w])[0].tolist() == ids[at : at + n].tolist()
        at += n


def test_scores_do_not_depend_on_neighbours_and_gradients_are_right():
    rng = np.random.default_rng(1)
    nexts, allowed = _next_ids(rng)
    weights = lm_scoring.Attention.new_weights(nexts, 32, lm_scoring.INPUTS)
    weights = {k: v.astype(np.float64) for k, v in weights.items()}
    network = lm_scoring.Attention(weights, nexts, lm_scoring.CONTEXT)
    first, last = rng.integers(0, 50, (2, 2, 32))
    ask, target = np.tile(np.arange(1, 32, 4), (2, 1)), rng.choice(np.flatnonzero(allowed), (2, 8))
    real = np.ones((2, 8), bool)
    real[1, 5:] = False
    _, slopes = network.gradients(first, last, ask, target, real)
    c = int(nexts.of[target[0, 0]])
    for name, at in (("qkv", (3, 20)), ("qkv", (3, 2)), ("near", (2,)), ("seen", (1, 1)), ("first", (int(first[0, 0]), 4)), ("last", (int(last[0, 1]), 4)), ("out", (2, 3)), ("slots", (min(c, lm_scoring.CLASSES - 1), 2, int(nexts.slot[target[0, 0]])))):
        loss = []
        for step in (1e-4, -1e-4):
            weights[name][at] += step
            loss.append(network.gradients(first, last, ask, target, real)[0])
            weights[name][at] -= step
        assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(slopes[name][at], rel=2e-2, abs=1e-5)
    network = lm_scoring.Attention({k: v.astype(np.float32) for k, v in weights.items()}, nexts, lm_scoring.CONTEXT)
    sizes = np.array([70, 1, 25])
    first, last, target = (rng.integers(0, 30, sizes.sum()) for _ in range(3))
    whole = network.log_probabilities(first, last, target, sizes)
    at = 0
    for n in sizes:
        alone = network.log_probabilities(first[at : at + n], last[at : at + n], target[at : at + n], np.array([n]))
        assert alone == pytest.approx(whole[at : at + n], abs=1e-4)
        at += n


def test_scoring_odd_rows(odd, empty):
    voc = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = lm_scoring.language_model_scores(odd, voc, F.lit(True)).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm_scoring.language_model_scores(empty, voc, F.lit(True)).count() == 0
    none = lm_scoring.language_model_scores(odd, voc, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}


# 3


def test_preference_pairs(spark):
    turns = "pair_id int, turn int, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "x"), (3, 0, None, None), (4, 0, "user", "only")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "?"), (2, 0, "user", "x"), (3, 0, "user", "y")], turns)
    got = {r.pair_id: r for r in preference.preference_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3}
    a = got[1]
    assert (a.n_prompt_turns, a.prompt) == (1, "<|user|>\nhi<|end|>\n")
    begin, end = map(int, a.chosen_mask.split("-"))
    assert a.chosen_completion[begin:end] == "good<|end|>\n" and a.rejected_completion.endswith("?<|end|>\n")
    assert (got[2].n_prompt_turns, got[2].chosen_completion, got[2].chosen_mask) == (1, "", "")
    assert got[3].n_prompt_turns == 0 and got[3].prompt == ""
    assert preference.preference_pairs(chosen.limit(0), rejected).count() == 0


# 4 and 5


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.queries()[name](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, empty, operator):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, 1), (5, 0, 0), (11, 1, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        rows = labelled.scored(docs, operator.fit(docs, marks)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_a_long_labelled_text_is_passed_over(spark, label):
    rows = [(i, "word " * (1 + i), "a", None) for i in range(20)]
    first = min(range(20), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0])
    rows[first] = (first, "long " * 1000, "a", None)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (3, "another text", "a", None)], DOCS)
    sample, share = labelled.labelled_sample(docs, labels, label, F.lit(True), 10, 2000)
    assert set(sample["key"]) == set(range(20)) - {first} and share == 0.5
    assert len(sample) == 19 and sample["text"].str.len().sum() <= 2000


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, t = rng.standard_normal(n), rng.standard_normal((2, 2))
        weights = {}
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weights[tuple(y)] = math.exp(sum(e[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(weights.values())
        p, pairs, log_z = quality.marginals(np.concatenate([e, e[:1]]), np.array([n, 1]), t)
        expected = [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        assert p[:n] == pytest.approx(expected) and pairs.sum() == pytest.approx(n - 1)
        assert log_z == pytest.approx(math.log(z) + math.log(1 + math.exp(e[0])))


# 6


def test_archive_round_trip(spark, odd, empty, library, documents, tmp_path):
    rows = token_archive.archived(spark.read.parquet(f"{SF}/documents.parquet"), BPE).toPandas().sort_values("doc_id")
    start = 0
    for r, text in zip(rows.itertuples(), documents.sort_values("doc_id")["text"], strict=True):
        ids = np.asarray([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = str(tmp_path / "archive")
    token_archive.write_archive(odd, path, BPE)
    one = token_archive.read_archive(spark, path, keys=[5]).collect()
    assert [r.ids for r in one] == [[*library.encode(ODD[5], add_special_tokens=False).ids, 0]]
    whole = token_archive.read_archive(spark, path).collect()
    assert len(whole) == odd.count() and [r.start for r in whole if r.doc_id is None] == [0]
    assert token_archive.archived(empty, BPE).count() == 0


def test_keys_are_found_beside_a_null_key(spark, tmp_path):
    docs = spark.createDataFrame([(None, "no id"), (1, "one"), (2, "two"), (3, "three")], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "archive")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_archive.write_archive(docs, path, BPE)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.doc_id for r in token_archive.read_archive(spark, path, keys=[1, 3]).collect()) == [1, 3]


def test_cached_pieces_change_nothing(library, documents, monkeypatch):
    monkeypatch.setattr(token_archive, "CACHED_PIECES", 50)
    encoder = token_archive.Encoder(BPE)
    for x in [x or "" for x in ODD] + documents["text"].tolist()[:100]:
        assert encoder.encode([x])[0].tolist() == library.encode(x, add_special_tokens=False).ids


# 7


def brute_windows(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_matches_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    phrases: dict = {}
    for i, x in zip(items["item_id"], items["text"], strict=True):
        w = brute_windows(x)
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[k : k + 10]), set()).add(i)
    rows = queries.queries()["op7_decontaminate"](spark, SF).toPandas().set_index("doc_id")
    for i, x in zip(documents["doc_id"], documents["text"], strict=True):
        w, hit, found = brute_windows(x), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[p]
        ids = ",".join(sorted(map(str, found)))
        assert tuple(rows.loc[i]) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for t in range(30):
        s = rng.integers(0, 4, rng.integers(1, 200))
        s = np.tile(s[:20], 9) if t % 3 == 0 else s
        index = decontaminate.FMIndex(s)
        where = decontaminate.SampledPositions(index)
        for m in (1, 3, 6):
            at = [i for i in range(len(s) - m + 1) if (s[i : i + m] > 0).all()][::5]
            if at:
                rows = np.stack([np.r_[np.zeros(6 - m, int), s[i : i + m]] for i in at])
                low, high = index.search(rows, np.full(len(at), m))
                for i, a, b in zip(at, low, high, strict=True):
                    assert sorted(where.locate(np.arange(a, b))) == [j for j in range(len(s) - m + 1) if (s[j : j + m] == s[i : i + m]).all()]


def test_spans_are_cut_and_blocks_agree(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, "Def GHI"), (2, None), (3, "a a"), (3, "a a"), (4, "not there")], "item_id int, text string")
    found = decontaminate.contaminated_spans(odd, items)
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(found).collect()}
    assert cut[11] == "AbC  jkl mno" and cut[4] == "" and cut[5] == ODD[5] and cut[1] is None
    whole = sorted(map(str, found.collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    assert sorted(map(str, decontaminate.contaminated_spans(odd, items).collect())) == whole
    assert decontaminate.contaminated_spans(empty, items).count() == 0
    assert decontaminate.contaminated_spans(odd, items.limit(0)).where("size(hit_spans) > 0").count() == 0


# 8


def test_mix_meets_its_targets(spark, documents):
    run = queries.queries()["op8_mixing"]
    rows = run(spark, SF).toPandas().merge(documents, on="doc_id")
    assert run(spark, SF).toPandas().sort_values("doc_id", ignore_index=True).equals(run(spark, SF).toPandas().sort_values("doc_id", ignore_index=True))
    assert (rows["size"] == [len(x.encode().split()) for x in rows["text"]]).all() and (rows["taken"] <= 2 * rows["size"]).all()
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] / by["target"] - 1) < 0.02).all() and by["target"].sum() == pytest.approx(1.5 * by["size"].sum())
    assert (by["target"] <= 2 * by["size"] + 1e-6).all()


def test_targets_share_what_is_beyond_a_cap():
    got = mixing.target_sizes({"a": 10, "b": 1000, None: 100}, (3, 1, 2))
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1110)
    assert mixing.target_sizes({}) == {} and mixing.target_sizes({"a": 0}) == {"a": 0}


def test_mixing_odd_rows(odd, empty):
    rows, _, pieces = mixing.mix(odd, block=2)
    assert rows.count() == odd.count() and rows.where("size = 0").join(pieces, "row").count() == 0
    assert mixing.mixed_texts(odd, block=2).columns == odd.columns
    assert mixing.mix(empty)[0].count() == 0
    for n in (1, 2, 5, 64, 100):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


# 9


def brute_classes(rows, k, percent):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("short", "block"), [(64, 256), (2, 3)])
def test_near_duplicates_match_brute_force(spark, documents, monkeypatch, short, block):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAVES", block)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split() * 4
    base = [f"{w}{i}" for i, w in enumerate(base)]
    near = [(5000 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, 60, 3)] + [(6000 + i, " ".join(base)) for i in range(5)]
    rows = [*zip(documents["doc_id"].tolist()[:150], documents["text"].tolist()[:150], strict=True), *near]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows, 4, 85)


def test_classes_have_their_least_key_in_any_row_order(spark, documents, tmp_path):
    base = [f"w{i}" for i in range(60)]
    rows = [*zip(documents["doc_id"].tolist()[:40], documents["text"].tolist()[:40], strict=True)]
    rows += [(7000 - i, " ".join(base)) for i in range(9)]
    rows += [(8000 - i, " ".join([*base[:20], "changed", *base[21:]])) for i in range(9)]
    rows += [(6000, " ".join([*base[:20], "changed", *base[21:]])), (9000, "two words"), (3001, "two words")]
    order = np.random.default_rng(3).permutation(len(rows) - 3).tolist()
    for i, part in enumerate((order[:5], order[5:45], [*order[45:], *range(len(rows) - 3, len(rows))])):
        some = spark.createDataFrame([rows[j] for j in part], "doc_id long, text string")
        some.coalesce(1).write.parquet(str(tmp_path / f"shuffled/part={i}"))
    shuffled = spark.read.parquet(str(tmp_path / "shuffled")).select("doc_id", "text")
    got = ngram_join.near_duplicates(shuffled, k=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows, 4, 85)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == r.doc_id for r in rows if not r.n_shingles)
    assert sum(r.doc_id == 3 and r.component_id == 3 for r in rows) == 2
    assert ngram_join.near_duplicates(empty).count() == 0


# 10


def test_search_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 500)]
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (604, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(table, F.col("vec_id") % 50 == 0, k=7).collect()
    good = {i: np.floor(1024 * np.asarray(v, float)) for i, v in rows if v and len(v) == 6 and None not in v and np.isfinite(v).all()}
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:7]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not any(r.query_id in (600, 601) for r in got)
    assert topk_search.top_k(table.limit(0), F.lit(True)).count() == 0


def test_rows_with_one_id_are_searched_apart(spark):
    """Two rows 0: each is a query of its own and finds the other."""
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0]), (2, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(table, F.col("vec_id") == 0, k=2).collect())
    good = [np.floor(1024 * np.asarray(v)) for _, v in rows]
    expected = []
    for q in (0, 1):
        best = sorted((-int(good[q] @ x), rows[i][0]) for i, x in enumerate(good) if i != q)[:2]
        expected += [(0, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(expected)


def test_blocks_of_queries_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk_search.top_k(table, F.col("vec_id") % 7 == 0, k=4).collect()))
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, topk_search.top_k(table, F.col("vec_id") % 7 == 0, k=4).collect())) == whole


# what all have in common


def test_items_without_an_id_mark_hits_but_are_not_listed(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f g h i j"), ("x", "b c d e f g h i j k")], "item_id string, text string")
    row = decontaminate.contaminated_spans(docs, items).first()
    assert (row.hit_items, row.hit_spans, row.n_words) == (["x"], [[0, 11]], 11)


def test_every_conversation_with_an_answer_gives_a_row(spark, tmp_path):
    turns = [(i, t, r, f"{r}{i}") for i in (1, 2, 5, 70, -3) for t, r in ((0, "user"), (1, "assistant"))] + [(9, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in preference.op3_preference(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 5, 70, -3}
    assert "assistant2" in got[1].rejected_completion and "assistant1" in got[5].rejected_completion
    assert got[70].rejected_completion == got[70].chosen_completion == ""


def test_columns_with_clashing_names(spark):
    """A column named like a result gives way to it, or stays where the operator returns rows of its input."""
    docs = spark.createDataFrame([(1, "one two three four five", "s", 7, "p", 9)], "doc_id long, text string, source string, score long, pieces string, n_words long")
    assert decontaminate.contaminated_spans(docs, docs.selectExpr("1 AS item_id", "text")).columns[-3:] == ["n_words", "hit_spans", "hit_items"]
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns and {r.pieces for r in mixed.collect()} == {"p"}
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    scored = labelled.with_score(docs, quality.fit(docs, labels))
    assert scored.columns.count("score") == 1 and 0 <= scored.first().score <= 1
    pairs = spark.createDataFrame([(1, "mine", [("user", "a")], [("user", "b")])], "pair_id long, prompt string, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert preference.format_lists(pairs).columns.count("prompt") == 1


def test_a_task_gives_a_groups_prefix_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words)] * 30 + [" ".join([*words, f"x{i}"]) for i in range(30)] + ["alone " * 3, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = ngram_join._membership(docs.coalesce(1), "doc_id", "text", 4, 85).orderBy("row").collect()
    groups = [(r.n, bytes(r.prefix_key)) for r in rows if r.n]
    assert [(r.n, bytes(r.prefix_key)) for r in rows if r.prefix is not None] == list(dict.fromkeys(groups))
    # in several tasks a group has more than its head; classes stay, in short and in long lists
    for short, seen in ((64, 150_000), (2, 1)):
        monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
        monkeypatch.setattr(ngram_join, "GROUPS_SEEN", seen)
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs.repartition(7), k=4, percent=85).collect()}
        assert got == {i: 0 if i < 60 else i for i in range(len(texts))}
