"""Registered queries and the pipeline against plain Python over whole tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
WORD, ITEM_WORD = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_mix(docs, block=mixing.BLOCK_WORDS):
    """doc_id -> list of (first word, last word, times); targets and slots by source. The two random streams are the operator's."""
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    size = {i: len(WORD.findall(x.encode())) for i, x, _ in docs}
    total = {s: sum(size[i] for i, _, t in docs if t == s) for s in sources}
    target = mixing.target_sizes(total)
    blocks = [-(-total[s] // block) for s in sources]
    slots = np.asarray([min(2 * n, round(target[s] * n / total[s])) if n else 0 for s, n in zip(sources, blocks, strict=True)])
    times = [Counter() for _ in sources]
    first = np.zeros(len(sources), int)
    for counts in mixing.shard_counts(slots, 0):
        for k, n in enumerate(counts):
            at = np.arange(first[k], first[k] + n) % max(blocks[k], 1)
            times[k].update(mixing.permuted(at, blocks[k], zlib.crc32(f"0:{sources[k]}".encode())).tolist() if n else [])
            first[k] += n
    pieces = {i: [] for i, *_ in docs}
    for k, s in enumerate(sources):
        offset = 0
        for i in sorted(i for i, _, t in docs if t == s):
            for b in range(offset // block, -(-(offset + size[i]) // block) if size[i] else 0):
                if n := times[k][b]:
                    pieces[i].append((max(b * block, offset) - offset, min((b + 1) * block, offset + size[i]) - offset, n))
            offset += size[i]
    return pieces, size, total, target


def mixed(text, pieces):
    """The copies of a text that its pieces make."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    for t in range(1, max((n for *_, n in pieces), default=0) + 1):
        runs = []
        for a, b, n in pieces:
            if n >= t:
                runs = [*runs[:-1], (runs[-1][0], b)] if runs and runs[-1][1] == a else [*runs, (a, b)]
        yield text if runs == [(0, len(at))] else b"\n".join(raw[at[a][0] : at[b - 1][1]] for a, b in runs).decode()


def one_of_each_group(docs):
    sets = {}
    for i, x, _ in docs:
        words = WORD.findall(x.encode().lower())
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            least[b] = a
    return [d for d in docs if root(d[0]) == d[0]]


def without_benchmark(docs, items):
    phrases = set()
    for x in items:
        w = ITEM_WORD.findall((x or "").encode().lower())
        phrases |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    out = []
    for i, x, s in docs:
        raw = x.encode()
        spans = [m.span() for m in ITEM_WORD.finditer(raw.lower())]
        w, hit = [raw.lower()[a:b] for a, b in spans], set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
        parts, done = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                parts.append(raw[done : spans[k][0]])
            if k + 1 not in hit:
                done = spans[k][1]
        out.append((i, b"".join([*parts, raw[done:]]).decode(), s))
    return out


def test_mix_takes_what_plain_python_takes(spark, documents):
    pieces, size, total, target = brute_mix(documents)
    source = {i: s for i, _, s in documents}
    expected = {i: (size[i], total[source[i]], target[source[i]], sum((b - a) * n for a, b, n in pieces[i])) for i in pieces}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in queries.queries()["op8_mixing"](spark, SF).collect()}
    assert got == expected


def test_token_counts_and_archive_are_the_library_s(spark, documents, library):
    ids = {i: library.encode(x, add_special_tokens=False).ids for i, x, _ in documents}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.queries()["op1_token_counts"](spark, SF).collect()}
    assert counts == {i: (len(x.encode()), len(ids[i]), len(ids[i]) > 512) for i, x, _ in documents}
    start, expected = 0, {}
    for i in sorted(ids):
        whole = np.asarray([*ids[i], 0], "<u4")
        expected[i] = (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.queries()["op6_token_archive"](spark, SF).collect()} == expected


def test_pipeline_run_matches_plain_python(spark, documents, library):
    """Every stage's decisions but the classifier's scores, which the fitted model gives for each text alone."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality.fit(docs.select("doc_id", "text"), labels).score([x.encode() for _, x, _ in documents])
    good = [d for d, p in zip(documents, scores, strict=True) if p >= 0.5]
    single = one_of_each_group(good)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = without_benchmark(single, items)
    assert len(documents) > len(good) > len(single) and any(a != b for a, b in zip(single, clean, strict=True))
    pieces, *_ = brute_mix(clean)
    expected = Counter()
    for i, x, _ in clean:
        for copy in mixed(x, pieces[i]):
            whole = np.asarray([*library.encode(copy, add_special_tokens=False).ids, 0], "<u4")
            expected[i, len(whole), zlib.crc32(whole.tobytes())] += 1
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
