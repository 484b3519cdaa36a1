"""Merkle manifests, sort-means and byte-level BPE: brute force, the library, and odd inputs."""

from __future__ import annotations

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillgraph.llm import byte_bpe, merkle_manifest, queries, sort_means

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root, and for each leaf its siblings by level."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            a = p - p % 3
            proofs[i].append(("".join(level[a:p]), "".join(level[p + 1 : a + 3])))
        level, at = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], proofs


def brute_manifest(rows):
    told = lambda r: digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r[:5]))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, told(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = brute_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (named, key, leaf), proof in zip(sorted(groups[s]), trees[s][1], strict=True):
            out.append((key if named else None, leaf, trees[s][0], root, digest(*(a + b for a, b in proof + up))))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_matches_brute_force(spark, depth):
    rng = random.Random(depth)
    rows = [(i, rng.choice(["hot"] * 5 + [None, "", "é", "z"]), None if i % 7 == 0 else "en", i if i % 5 else None, None if i % 11 == 0 else "x\n" * (i % 4), "own", 1) for i in range(130)]
    rows += [rows[3]] * 4 + [(3, rows[3][1], "other", 1, "", None, None), (None, "hot", None, None, None, None, None), (None, "hot", None, None, None, None, None), (900, "alone", "en", 1, "a", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    leaves = docs.select("doc_id", "source", merkle_manifest.row_digest(*map(F.col, merkle_manifest.FIELDS)).alias("leaf"))
    made = merkle_manifest.manifest(leaves, "source", "doc_id", "leaf", depth)
    got = made.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest("proof"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
    assert made.where(merkle_manifest.folded("leaf", "proof") == F.col("root")).count() == len(rows)


def test_manifest_finds_changed_missing_and_added_rows(spark):
    leaf = lambda rows: spark.createDataFrame(rows, DOCS).select("doc_id", "source", merkle_manifest.row_digest(*map(F.col, merkle_manifest.FIELDS)).alias("leaf"))
    rows = [(i, "a" if i < 20 else None, None, i, f"text {i}", None, None) for i in range(25)]
    known = merkle_manifest.manifest(leaf(rows), "source", "doc_id", "leaf", 2)
    now = [(*r[:4], "other", None, None) if r[0] == 7 else r for r in rows if r[0] != 21] + [(99, "a", None, 1, "new", None, None)]
    found = merkle_manifest.checked(leaf(now), known, "doc_id", "leaf").collect()
    assert {r.doc_id for r in found if not r.verified} == {7, 21, 99}
    assert [r.folded_root is None for r in found if r.doc_id in (21, 99)] == [True, True]


def test_query_of_odd_and_empty_tables(spark, tmp_path):
    rows = [(0, None, None, None, None, "x", 1), (4, "a", "en", 3, "a\nb", None, 1), (4, "a", "en", 3, "a\nb", None, 1), (None, "a", "en", 3, "a\nb", None, 1), (5, "a", "en", 0, "", None, 1)]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = queries.queries()["op11_merkle_manifest"](spark, f"{tmp_path}/odd").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_manifest(rows)
    import zlib

    changed = {r.doc_id for r in got if not r.verified}
    assert changed == {i for i in (4,) if zlib.crc32(str(i).encode()) % 2 == 0}
    assert queries.queries()["op11_merkle_manifest"](spark, f"{tmp_path}/none").count() == 0


# 12


def brute_means(vectors, k, rounds, scale):
    """(key, cluster, distance) of every vector, and the centroids."""
    whole = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in vectors]
    order = sorted((sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in whole)
    centroids = [v for _, v in order[:k]]
    for left in range(rounds, -1, -1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in whole]
        if left:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(whole, near, strict=True) if m == n]
                if own:
                    centroids[n] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    return sorted(((i, n, d) for (i, _), (d, n) in zip(whole, near, strict=True)), key=str), centroids


@pytest.mark.parametrize("seed", range(3))
def test_clusters_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    # whole coordinates on a small grid: many ties, copies and empty clusters
    vectors = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(150)] + [(7, [0.0, 0.0, 0.0])] * 40 + [(None, [1.0, 1.0, 1.0])]
    bad = [(500, None), (501, [1.0, None, 1.0]), (502, [float("nan")] * 3), (503, [float("inf")] * 3), (504, [1.0]), (505, [])]
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors + bad], "vec_id long, embedding array<float>, cluster int").repartition(3)
    placed, centroids = sort_means.sort_means(rows, k=9, rounds=3, length=3, scale=2)
    expected, ends = brute_means(vectors, 9, 3, 2)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in placed.collect()), key=str) == expected
    assert [tuple(c) for c in centroids.tolist()] == ends


def test_scans_stop_and_ties_take_the_smaller_number():
    centroids = np.asarray([[0], [100], [200], [4]], np.int64)
    seen: list[int] = []
    cluster, distance = sort_means.assigned(np.asarray([[1], [2], [99], [50]], np.int64), np.asarray([0, 3, 1, 2]), centroids, seen)
    assert cluster.tolist() == [0, 0, 1, 3] and distance.tolist() == [1, 4, 1, 46**2]
    assert sum(seen) < 4 * 3


def test_few_vectors_none_and_too_large_ones(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [1.0] * 64)], kind)
    placed, centroids = sort_means.sort_means(few)
    assert len(centroids) == 2 and {r.distance for r in placed.collect()} == {0}
    placed, centroids = sort_means.sort_means(few.limit(0))
    assert placed.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="too large"):
        sort_means.sort_means(spark.createDataFrame([(1, [1e300] * 64)], kind))


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.queries()["op12_sort_means"](spark, str(tmp_path)).count() == 0


# 13

ODD = ["", None, " ", "a", "it's 'tis we'll  x\n\n y\t", "<|endoftext|> a<|endoftext|>", "日本語 é́ x y", "word " * 3000, "x" * 5000, "aaab" * 900 + "b" * 77, "\0 nul", " " * 3000]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tool():
    return byte_bpe.BytePairEncoder(RANKS, public_tokenizers.PATTERN)


def test_ids_match_the_library_by_either_way_of_merging(tool, library, monkeypatch):
    rng = random.Random(5)
    texts = [x or "" for x in ODD] + ["".join(rng.choice(abc) for _ in range(400)) for abc in ("ab", "abcdefgh", "αβγ日本語한국", "=-_") for _ in range(8)]
    expected = [library.encode_ordinary(x) for x in texts]
    for long, portion, pieces in ((512, 1 << 18, 150_000), (3, 50, 10), (10**9, 1, 1)):
        for name, value in (("LONG", long), ("PORTION", portion), ("PIECES", pieces)):
            monkeypatch.setattr(byte_bpe, name, value)
        tool._forget()
        got = tool.encode(texts)
        assert [x.tolist() for x in got] == expected
        assert [tool.decode(x.astype(np.int64)).decode() for x in got] == texts
    monkeypatch.undo()
    tool._forget()


def test_pair_table_finds_what_it_holds():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0).astype(np.int32)
    ranks = byte_bpe.PairRanks(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    held = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    left, right = np.meshgrid(np.arange(-1, 61, dtype=np.int32), np.arange(-1, 61, dtype=np.int32))
    got = ranks(left.ravel(), right.ravel()).tolist()
    assert got == [held.get((a, b), int(byte_bpe.NEVER)) for a, b in zip(left.ravel().tolist(), right.ravel().tolist(), strict=True)]


def test_query_matches_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    got = queries.queries()["op13_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_odd_rows_and_decoding(spark, library, tool):
    rows = [(i, x, "own") for i, x in enumerate(ODD)] + [(3, "a", None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    how = RANKS, public_tokenizers.PATTERN
    found = byte_bpe.decoded(byte_bpe.encoded(docs, *how).withColumn("more", F.lit(1)), *how).collect()
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.data).decode()) for r in found), key=str) == sorted(((i, len(library.encode_ordinary(x or "")), x or "") for i, x, _ in rows), key=str)
    assert byte_bpe.encoded(docs.limit(0), *how).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decoded(nulls, *how).first().data is None
    with pytest.raises(ValueError, match="no bytes"):
        tool.decode(np.asarray([999_999]))
