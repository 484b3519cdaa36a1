"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents inside a task. Its words, as numbers from the
benchmark's dictionary, form one sequence (0: words the benchmark lacks, or the end of a
document). The words before the shard's sorted suffixes form the transform, kept as a
wavelet matrix with block ranks. All phrases search backward together; those that
remain are located through sampled suffix positions, and their word spans merged.

Words are ``[0-9a-z]`` and every character beyond ASCII, after lower-casing A-Z. A test
phrase is ``span`` consecutive words of an item, or the whole of a shorter item.

Null and empty texts have no words; items without words are never found. Repeated rows
each give a row; an item id that repeats counts once per document. With no items, no
document is hit. Phrases go to the tasks in blocks of bounded size, so the benchmark may
grow beyond any one broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import saved, slices, table

SPAN = 10
#: Words of benchmark text that one block of phrases holds at most (an item is never split).
BLOCK_WORDS = 200_000
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: A suffix position is kept for every so many words of the sequence.
SAMPLE = 4

_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class WaveletMatrix:
    """Ranks of numbers in a sequence: a bit vector per bit, with sums of 64-bit blocks."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(values)
        self.words, self.sums, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            word = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(word).astype(np.int64)
            self.words.append(word)
            self.sums.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            bit = bit.astype(bool)
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.sums[level].take(block) + np.bitwise_count(self.words[level].take(block) & mask)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before place ``at``."""
        begin, end = np.zeros_like(at), at
        for level in range(self.bits):
            one = ((value >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, begin), self._ones(level, end)
            begin = np.where(one, self.zeros[level] + a, begin - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - begin

    def get(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for level in range(self.bits):
            bit = (self.words[level].take(at >> 6) >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            value = value * 2 + bit.astype(np.int64)
        return value


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes, by prefix doubling over what is still tied."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    keys = sequence[order].astype(np.int64)
    rows = np.arange(n)
    rank = np.empty(n, np.int64)
    width = 1
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = order[rows]
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = rows[tied]
        if not len(rows):
            return order
        at = order[rows]
        follow = at + width
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        keys = rank[at] * (n + 2) + second
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        order[rows] = at[by]
        width *= 2


class FMIndex:
    """Backward search over a sequence of numbers from 0, for patterns of numbers above 0."""

    def __init__(self, sequence: np.ndarray) -> None:
        # The least number, once, in front: it also ends the sequence, read as a circle.
        sequence = np.concatenate([[0], sequence.astype(np.int64) + 1])
        self.n = len(sequence)
        self.top = int(sequence.max()) + 1
        self.order = suffix_order(sequence)
        self.matrix = WaveletMatrix(sequence[self.order - 1], max(1, self.top.bit_length()))
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=self.top + 1))])

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the sorted suffixes that begin with each pattern (right-aligned rows)."""
        span = patterns.shape[1]
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(1, span + 1):
            live = live[(sizes[live] >= k) & (low[live] < high[live])]
            if not len(live):
                break
            value = patterns[live, span - k] + 1
            known = value < self.top
            low[live[~known]] = high[live[~known]] = 0
            live, value = live[known], value[known]
            base = self.counts[value]
            low[live] = base + self.matrix.rank(value, low[live])
            high[live] = base + self.matrix.rank(value, high[live])
        return low, high


class SampledPositions:
    """Suffix positions of which only multiples of ``SAMPLE`` are kept; others walk back to one."""

    def __init__(self, index: FMIndex) -> None:
        self.index = index
        self.kept = index.order % SAMPLE == 0
        self.places = np.cumsum(self.kept) - self.kept
        self.positions = index.order[self.kept]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            value = self.index.matrix.get(rows[todo])
            rows[todo] = self.index.counts[value] + self.index.matrix.rank(value, rows[todo])
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.positions[self.places[rows]] + steps - 1  # less the number in front


class Phrases:
    """A block of benchmark items as numbered words and distinct phrases."""

    def __init__(self, items: list[tuple[object, bytes]], span: int) -> None:
        self.span = span
        self.number: dict[bytes, int] = {}
        rows: dict[tuple, int] = {}
        self.owners: list[list[int]] = []
        self.items = sorted({i for i, _ in items}, key=str)
        place = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - span + 1) if ids else 0):
                row = rows.setdefault(tuple(ids[at : at + span]), len(rows))
                if row == len(self.owners):
                    self.owners.append([])
                if place[item] not in self.owners[row]:
                    self.owners[row].append(place[item])
        self.sizes = np.asarray([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), span), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, span - len(r) :] = r


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        return 0


def find_spans(texts: list[bytes], phrases: Phrases) -> tuple[list[int], list[np.ndarray], list[list[int]]]:
    """Per text: its number of words, its merged hit spans (word from, word to), places of found items."""
    numbers = _Numbers(phrases.number)
    parts, counts = [], []
    for x in texts:
        w = words_of(x)
        counts.append(len(w))
        parts.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
    spans = [np.zeros((0, 2), np.int64)] * len(texts)
    found: list[list[int]] = [[] for _ in texts]
    gap = np.zeros(1, np.int32)
    sequence = np.concatenate([y for p in parts for y in (p, gap)])
    begins = np.cumsum([0, *(c + 1 for c in counts[:-1])])
    # Runs of unknown words can't lie in an occurrence: one zero stands for each run.
    keep = np.ones(len(sequence), bool)
    keep[1:] = (sequence[1:] != 0) | (sequence[:-1] != 0)
    origin = np.flatnonzero(keep)
    if not len(phrases.rows) or not sequence.any():
        return counts, spans, found
    index = FMIndex(sequence[keep])
    low, high = index.search(phrases.rows, phrases.sizes)
    hits = np.maximum(high - low, 0)
    if not hits.any():
        return counts, spans, found
    done = np.cumsum(hits)
    rows = np.repeat(low - (done - hits), hits) + np.arange(done[-1])
    where = origin[SampledPositions(index).locate(rows)]
    phrase = np.repeat(np.arange(len(hits)), hits)
    doc = np.searchsorted(begins, where, side="right") - 1
    first = where - begins[doc]
    by = np.lexsort([first, doc])
    doc, first, phrase = doc[by], first[by], phrase[by]
    last = first + phrases.sizes[phrase]
    edges = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(doc)], strict=True):
        reach = np.maximum.accumulate(last[a:b])
        new = np.concatenate([[True], first[a + 1 : b] > reach[:-1]])
        starts = np.flatnonzero(new)
        stops = np.concatenate([starts[1:], [b - a]]) - 1
        spans[doc[a]] = np.stack([first[a:b][starts], reach[stops]], axis=1)
        found[doc[a]] = sorted({o for p in np.unique(phrase[a:b]) for o in phrases.owners[p]})
    return counts, spans, found


def _blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[object, bytes]]]:
    """Benchmark items in blocks of bounded size, streamed to the driver one at a time."""
    block, held = [], 0
    for item, text in items.select(item_key, item_text).orderBy(item_key, item_text).toLocalIterator():
        raw = (text or "").encode()
        if block and held + len(raw) // 2 > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((item, raw))
        held += len(raw) // 2
    if block:
        yield block


def contaminated_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` with n_words, hit_spans (of words, merged) and hit_items (sorted as strings).

    Columns of ``docs`` with one of these names give way. An item without an id marks hits but isn't listed.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit_spans": F.lit(None).cast("array<array<int>>"), "hit_items": F.lit(None).cast("array<string>")})
    names = out.columns
    shared = docs.sparkSession.sparkContext

    def searched(frame: DataFrame, block: list) -> DataFrame:
        held = shared.broadcast(Phrases(block, span))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = held.value
            for batch in slices(batches, text, SHARD_BYTES):
                raw = [x or b"" for x in pc.cast(batch.column(text), pa.binary()).to_pylist()]
                counts, spans, found = find_spans(raw, phrases)
                old_spans, old_items = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
                spans = [_merged((a or []) + b.tolist()) for a, b in zip(old_spans, spans, strict=True)]
                found = [sorted({*(a or []), *(str(phrases.items[i]) for i in b if phrases.items[i] is not None)}) for a, b in zip(old_items, found, strict=True)]
                new = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "hit_items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names[:-3]] + [*new.values()], names)

        return frame.mapInArrow(run, out.schema)

    n = 0
    for block in _blocks(items, item_key, item_text):
        if n and n % 8 == 0:  # one pass of the documents per block; long chains are cut
            out = saved(out, "decontaminate")
        out = searched(out, block)
        n += 1
    return out if n else searched(out, [])


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cut the words of ``hit_spans``, with all between them, out of the text; untouched texts stay as they are."""
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    names = docs.columns

    def cut(raw: bytes, spans: list) -> bytes:
        at = [m.span() for m in word.finditer(raw.translate(_KEEP))]
        parts, done = [], 0
        for a, b in spans:
            parts.append(raw[done : at[a][0]])
            done = at[b - 1][1]
        return b"".join([*parts, raw[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            spans = batch.column("hit_spans").to_pylist()
            texts = batch.column(text).to_pylist()
            texts = [cut(x.encode(), s).decode() if s else x for x, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_spans(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_SQL_WORDS = lambda c: f"regexp_extract_all({_LOWER(c)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RUNS = lambda rows: " UNION ALL ".join(
    f"SELECT id, i, {k} AS k, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS run, n FROM {rows}" for k in range(1, SPAN + 1)
)

DECONTAMINATION_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_SQL_WORDS('text')} AS w FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS id, item_id, {_SQL_WORDS('text')} AS w FROM benchmark),
dw AS MATERIALIZED (SELECT id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS MATERIALIZED (SELECT id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b),
br AS MATERIALIZED (SELECT DISTINCT id AS item, k, run FROM ({_RUNS('bw')}) WHERE k = least(n, {SPAN}) AND i + k - 1 <= n),
hit AS MATERIALIZED (SELECT r.id, r.i, r.k, br.item FROM ({_RUNS('dw')}) r JOIN br USING (k, run) WHERE r.i + r.k - 1 <= r.n),
covered AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY id),
named AS (SELECT DISTINCT hit.id, CAST(item_id AS VARCHAR) AS item_id FROM hit JOIN b ON b.id = hit.item WHERE item_id IS NOT NULL),
items AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM named GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (id) LEFT JOIN items USING (id)
"""
