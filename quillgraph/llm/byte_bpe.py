"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is split by a pattern; each piece is encoded by itself. A piece that is an entry of the vocabulary is that entry. The others begin as
the ids of their bytes and go into matrices by length, a row a piece, padded on the right. In a round each row merges its leftmost pair of least
rank: the rank matrix gives the place, the merged id takes it, all behind moves up by one column, and the two pairs that are new
are looked up in a hash table of pairs. Rows without a pair to merge leave the matrix, and since each of the others has lost one
column, so does the matrix.

A piece of over ``LONG`` bytes would need a round for each of its merges. It is a row of its own, in which a round
merges every pair of the least rank from left to right, and stops early where a merge makes a pair of lower rank: the same merges in the same order.

Ids travel as little-endian unsigned 32-bit integers in a binary column. Decoding joins the ids' bytes.

Rows: a null text is an empty one and has no ids; repeated rows each give a row, whatever their key; texts are worked on in
portions, so a very long one needs little more than its own size; an empty table gives none. Columns other than key and
text are ignored. Null ids decode to null, and an id without bytes in the vocabulary is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import kept_in_worker, slices, table, texts_of

#: Bytes beyond which a piece is encoded alone; cells of a matrix; pieces a worker remembers; characters of a portion, ids decoded at once.
LONG, CELLS, PIECES, PORTION = 512, 1 << 18, 150_000, 1 << 18
NEVER = np.int32(2**31 - 1)
#: A piece begins at white space after anything else, so a text may be cut there.
CUT = regex.compile(r"(?<=\S)\s")


class PairRanks:
    """Hash table from pairs of ids to the id of what they make: open addressing, probed for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(made)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, NEVER, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.made[at[placed]] = keys[placed], made[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, made, at = keys[rest], made[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, or NEVER; an id below 0 is padding."""
        out = np.full(len(left), NEVER, np.int32)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[asked].astype(np.int64) << 32) | right[asked]
        at = self._home(keys)
        while len(asked):
            held = self.keys[at]
            hit = held == keys
            out[asked[hit]] = self.made[at[hit]]
            on = ~hit & (held >= 0)
            asked, keys, at = asked[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class BytePairEncoder:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.single = np.asarray([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.token_size = np.asarray([len(t) for t in self.token_bytes], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        made = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairRanks(*np.asarray(made, np.int32).reshape(-1, 3).T)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = self.starts = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.int32)

    def _merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of about one length."""
        lengths = np.asarray([len(r) for r in rows])
        width = int(lengths.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((len(rows), width), NEVER, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        out: list[np.ndarray] = [None] * len(rows)
        place = np.arange(len(rows))
        while len(place):
            at = ranks.argmin(axis=1)  # the first of equal ones
            best = ranks[np.arange(len(place)), at]
            for i in np.flatnonzero(best == NEVER):
                out[place[i]] = ids[i, : lengths[i]]
            on = best < NEVER
            place, at, best, lengths, ids, ranks = place[on], at[on], best[on], lengths[on] - 1, ids[on], ranks[on]
            if not len(place):
                break
            row = np.arange(len(place))
            ids[row, at] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            ends = np.column_stack([ids, np.full(len(ids), -1, np.int32)])
            ranks[row, at] = self.pairs(best, ends[row, at + 1])
            behind = np.flatnonzero(at > 0)
            ranks[behind, at[behind] - 1] = self.pairs(ids[behind, at[behind] - 1], best[behind])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, all pairs of the least rank a round."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = np.append(self.pairs(ids[:-1], ids[1:]), NEVER)
        while len(ids) > 1 and (least := ranks.min()) < NEVER:
            at = np.flatnonzero(ranks == least)
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]  # of pairs that overlap, the left one goes first
            # The pairs that a merge makes, while those on its right are as they were.
            padded = np.concatenate([[np.int32(-1)], ids, [np.int32(-1), np.int32(-1)]])
            left, right, merged = padded[at], padded[at + 3], np.full(len(at), least, np.int32)
            left = np.where(np.diff(at, prepend=-9) == 2, least, left)
            lower = np.flatnonzero(np.minimum(self.pairs(left, merged), self.pairs(merged, right)) < least)
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = least
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            new = at - np.arange(len(at))
            ends = np.append(ids, np.int32(-1))
            for p in (new, new[new > 0] - 1):
                ranks[p] = self.pairs(ends[p], ends[p + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by matrices of pieces of like length."""
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.asarray([whole], np.int32)
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(len(piece) if len(piece) < 12 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            rows = max(1, CELLS // width)
            for a in range(0, len(members), rows):
                some = members[a : a + rows]
                for i, ids in zip(some, self._merge_rows([pieces[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that aren't known yet."""
        some = set(pieces)
        new = [p for p in some if p not in self.number]
        if len(self.number) + len(new) > PIECES:
            self._forget()
            new = list(some)
        if new:
            ids = self.encode_pieces([p.encode() for p in new])
            sizes = np.asarray([len(x) for x in ids])
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.known) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.known = np.concatenate([self.known, *ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            flat = [p for _, pieces in held for p in pieces]
            self._learn(flat)
            n = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
            sizes = self.sizes[n]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.known[np.repeat(self.starts[n] - ends + sizes, sizes) + np.arange(total)]
            a = b = 0
            for i, pieces in held:
                b += len(pieces)
                c = int(ends[b - 1]) if b else 0
                out[i].append(ids[a:c])
                a = c
            held.clear()

        for i, text in enumerate(texts):
            for part in portions(text):
                held.append((i, self.split.findall(part)))
                size += len(part)
                if size >= PORTION:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        parts = []
        for a in range(0, len(ids), PORTION):
            some = ids[a : a + PORTION]
            if some.max() >= len(self.token_size) or not self.token_size[some].all():
                raise ValueError("an id has no bytes in the vocabulary")
            sizes = self.token_size[some]
            ends = np.cumsum(sizes)
            parts.append(self.flat[np.repeat(self.token_start[some] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


def portions(text: str) -> Iterator[str]:
    """A text in parts that no piece crosses."""
    start = 0
    while len(text) - start > PORTION and (cut := CUT.search(text, start + PORTION)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The worker's encoder for a rank file."""
    return kept_in_worker(f"byte-bpe {path} {pattern}", lambda: BytePairEncoder(path, pattern))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and ids as little-endian unsigned 32-bit integers. ``vocabulary``: path of a rank file that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, pattern)
        for batch in slices(batches, text):
            ids = tool.encode(texts_of(batch, text))
            packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(x) for x in ids], pa.int64()), packed], [key, "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary")


def decoded(rows: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """All columns and ``data``: the bytes that packed ids stand for; a column of that name gives way."""
    rows = rows.drop(data)
    names = [*rows.columns, data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, pattern)
        for batch in slices(batches, ids):
            found = [None if x is None else tool.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(data, T.BinaryType())]))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = decoded(encoded(table(spark, sf_dir, "documents"), *how), *how)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
