"""Token ids in a binary archive with one shared zstandard dictionary.

Writing orders documents by key over range partitions, encodes them with the
``tokenizers`` library, ends each with an end id, and packs them into blocks.
Each document is a zstandard frame of its own, compressed with a dictionary that
was trained on serialized id arrays, so one short document can be read alone.

An archive is a Parquet dataset (any Spark file system can hold it), a row per
block: place (``part``, ``block``), key range, token counts, the SHA-256 of the
dictionary, and the block's bytes ``data``::

    magic "QGTA" | u8 version | u8 bytes per id | u16 0 | u32 documents
    i64 key, per document | u32 tokens, per document | u32 frame end, per document
    frames

A null key is the smallest one; it is stored as the least 64-bit integer. Null and
empty texts hold just the end id. Repeated rows are kept, side by side. An
empty table gives an empty archive. Too few samples for a dictionary (small
tables) give frames without one, and an empty hash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import kept_in_worker, scratch, slices, table, texts_of

#: About so many documents train the dictionary, chosen by a hash of their key.
DICTIONARY_DOCS = 600
#: A longer one gives so many bytes of serialized ids, in slices evenly spread over all of it.
DICTIONARY_DOC_BYTES, DICTIONARY_SLICES = 1 << 15, 8
DICTIONARY_BYTES = 1 << 16
#: A block closes when it holds so many serialized bytes.
BLOCK_BYTES = 1 << 21
LEVEL = 3
NULL_KEY = -(1 << 63)
MAGIC = b"QGTA"
#: Pieces of text whose ids a worker remembers, those it meets most often: some 300 MB with their ids. A job whose workers need their memory for more passes fewer.
CACHED_PIECES = 600_000
#: Texts of so many bytes are encoded at once.
ENCODED_BYTES = 1 << 19
#: New pieces in one text for the library.
RUN = 64

_HEADER = struct.Struct("<4sBBHI")
_RARE_WHITE = re.compile(r"[^\S \n]")
SPACE_STAND_IN = chr(256 + 0x20)  # as in vocabulary files of this kind
_MARKED = re.compile(r"[,.!|](?=\n|\Z)")
_BEYOND_LATIN = re.compile(r"[^\x00-\xFF]")
_CUT = re.compile(r"(?<=\S)(?= \S)")

ARCHIVE_SCHEMA = "part int, block int, first_key long, last_key long, n_docs int, n_before long, n_tokens long, dictionary_sha256 string, data binary"


class _Places(dict):
    """Numbers pieces as they turn up and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        at = self[piece] = len(self)
        return at


class Encoder:
    """Library encoding that asks for each distinct piece of text once.

    A text is cut before every single space between two characters that are not
    white space. The vocabulary's word splitter never joins characters over such
    a place, so the ids of the pieces, in order, are the ids of the text.
    """

    def __init__(self, path: str, pieces: int = 0) -> None:
        import os

        self.pieces = pieces or CACHED_PIECES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        top = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if top <= 1 << 16 else np.dtype("<u4")
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.marks = frozenset(",.!|")
        self.characters = np.zeros(top, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.characters[i] = len(token)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.stand_in = {b: 256 + i for i, b in enumerate(rest) if b != 0x0A}  # bytes without a printable form, as in vocabulary files
        self.known = _Places()
        self.flat = np.zeros(0, self.dtype)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that were met most often, half of those that may be held at most; what was met long ago counts less."""
        often = np.argsort(-self.used, kind="stable")[: self.pieces // 2]
        keep = np.sort(often[self.used[often] > 1])
        names, known = list(self.known), _Places()
        for i in keep.tolist():
            known[names[i]] = len(known)
        begin, size = self.begin[keep], self.size[keep]
        done = np.cumsum(size)
        self.flat = self.flat[np.repeat(begin - (done - size), size) + np.arange(size.sum())]
        self.known, self.begin, self.size, self.used = known, done - size, size, self.used[keep] // 2

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """Keys of the pieces: the first with a space before it, the others without their own."""
        if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or _RARE_WHITE.search(text):
            first, *rest = _CUT.split(text)
            return [" " + first, *(p[1:] for p in rest)]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def _learn(self, keys: list[str]) -> None:
        """Encode new pieces.

        A piece of Latin letters, maybe with a mark after it, is one word (and one more for the mark).
        Such words go to the library many at a time, as the words of a text whose only white space
        is between them; the lengths of the tokens tell where each piece ends.
        """
        marks = self.marks
        plain: list[int] = []
        wide: list[int] = []
        rest: list[int] = []
        for i, k in enumerate(keys):
            if k.isalpha() or (k[-1:] in marks and k[:-1].isalpha()):
                (plain if k.isascii() else rest if _BEYOND_LATIN.search(k) else wide).append(i)
            else:
                rest.append(i)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        flat, base = [self.flat], len(self.flat)
        for places in (plain, wide):
            if not places:
                continue
            text = "\n".join([keys[i] for i in places])
            if places is wide:
                text = text.encode().decode("latin-1").translate(self.stand_in)
            words = _MARKED.sub(r" \g<0>", text).split("\n")
            runs = [SPACE_STAND_IN + f" {SPACE_STAND_IN}".join(words[a : a + RUN]) for a in range(0, len(words), RUN)]
            ids = np.concatenate([np.asarray(e.ids, self.dtype) for e in self.words.encode_batch_fast(runs, add_special_tokens=False)])
            stops = np.cumsum([len(k) + 1 for k in text.split("\n")])
            stops = np.searchsorted(np.cumsum(self.characters[ids]), stops, side="left") + 1
            size[places] = np.diff(stops, prepend=0)
            begin[places] = base + stops - size[places]
            flat.append(ids)
            base += len(ids)
        pieces = [keys[i][1:] if keys[i][:1] == " " else " " + keys[i] for i in rest]
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        size[rest] = [len(x) for x in found]
        begin[rest] = base + np.cumsum(size[rest]) - size[rest]
        flat.append(np.fromiter(chain.from_iterable(found), self.dtype))
        self.flat = np.concatenate(flat)
        self.begin = np.concatenate([self.begin, begin])
        self.size = np.concatenate([self.size, size])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.pieces:
            self._forget()
        keys = [self._pieces(x) for x in texts]
        stops = np.cumsum([len(k) for k in keys])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(keys)), np.int64, stops[-1] if texts else 0)
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        met = np.bincount(at, minlength=len(self.size))
        met[: len(self.used)] += self.used
        self.used = met
        begins, sizes = self.begin[at], self.size[at]
        done = np.cumsum(sizes)
        out = self.flat[np.repeat(begins - (done - sizes), sizes) + np.arange(done[-1])] if len(at) else self.flat[:0]
        return np.split(out, done[stops[:-1] - 1]) if texts else []


def encoder(path: str, pieces: int = 0) -> Encoder:
    return kept_in_worker(f"encoder {path} {pieces}", lambda: Encoder(path, pieces))


def _serialized(tool: Encoder, texts: list[str], end_id: int) -> list[bytes]:
    end = np.asarray([end_id], tool.dtype).tobytes()
    return [ids.tobytes() + end for ids in tool.encode(texts)]


def _spread(raw: bytes) -> bytes:
    """The whole of a short document; evenly spread slices of a long one."""
    if len(raw) <= DICTIONARY_DOC_BYTES:
        return raw
    size = DICTIONARY_DOC_BYTES // DICTIONARY_SLICES
    starts = np.linspace(0, (len(raw) - size) // 4, DICTIONARY_SLICES).astype(np.int64) * 4
    return b"".join(raw[a : a + size] for a in starts.tolist())


def train_dictionary(docs: DataFrame, vocabulary: str, text: str, key: str, end_id: int, pieces: int = 0) -> bytes:
    """A dictionary from a bounded sample of serialized documents, chosen by a hash of key and text (null keys too)."""
    import zstandard

    n = docs.count()
    share = min(1.0, DICTIONARY_DOCS / max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, ENCODED_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([_spread(x) for x in _serialized(encoder(vocabulary, pieces), texts_of(batch, text), end_id)], pa.binary())], ["ids"])

    chosen = docs.where(F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(text)
    samples = [bytes(r.ids) for r in chosen.mapInArrow(run, "ids binary").limit(4 * DICTIONARY_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b""


def _codec(dictionary: bytes):
    import zstandard

    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if trained:
        trained.precompute_compress(level=LEVEL)  # else it is digested anew for each frame
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained), zstandard.ZstdDecompressor(dict_data=trained)


def pack_block(keys: list[int | None], frames: list[bytes], counts: list[int], width: int) -> bytes:
    n = len(keys)
    return b"".join(
        [
            _HEADER.pack(MAGIC, 1, width, 0, n),
            np.asarray([NULL_KEY if k is None else k for k in keys], "<i8").tobytes(),
            np.asarray(counts, "<u4").tobytes(),
            np.cumsum([len(f) for f in frames]).astype("<u4").tobytes(),
            *frames,
        ]
    )


class Block:
    """A block's index; documents are decompressed one by one."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        magic, version, self.width, _, n = _HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        at = _HEADER.size
        self.keys = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u4", n, at + 8 * n)
        self.ends = np.frombuffer(data, "<u4", n, at + 12 * n)
        self.data, self.base = data, at + 16 * n
        self.decompressor = _codec(dictionary)[1]

    def ids(self, i: int) -> np.ndarray:
        begin = int(self.ends[i - 1]) if i else 0
        frame = self.data[self.base + begin : self.base + int(self.ends[i])]
        raw = self.decompressor.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write_archive(docs: DataFrame, path: str, vocabulary: str, text: str = "text", key: str = "doc_id", end_id: int = 0, pieces: int = 0) -> str:
    """Write an archive under ``path``; gives the dictionary's SHA-256 ("" if none).

    Texts are shuffled once, by range of the key. The dictionary goes to ``path/dictionary``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    dictionary = train_dictionary(docs, vocabulary, text, key, end_id, pieces)
    digest = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    spark.createDataFrame([(digest, dictionary)], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, pieces)
        compressor = _codec(dictionary)[0]
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, frames, counts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            row = {"part": part, "block": number, "first_key": keys[0], "last_key": keys[-1], "n_docs": len(keys), "n_before": before, "n_tokens": sum(counts), "dictionary_sha256": digest, "data": pack_block(keys, frames, counts, tool.dtype.itemsize)}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], [*row])

        for batch in slices(batches, text, ENCODED_BYTES):
            raw = _serialized(tool, texts_of(batch, text), end_id)
            for k, x in zip(batch.column(key).to_pylist(), raw, strict=True):
                keys.append(k)
                counts.append(len(x) // tool.dtype.itemsize)
                frames.append(compressor.compress(x))
                held += len(x)
                if held >= BLOCK_BYTES:
                    yield block()
                    number, before = number + 1, before + sum(counts)
                    keys, frames, counts, held = [], [], [], 0
        if keys:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one key are ordered by a hash of their text, so that ranges split a key that very many rows have.
    order = [F.col(key).asc_nulls_first(), F.col("text_hash")]
    ordered = docs.withColumn("text_hash", F.xxhash64(text)).repartitionByRange(parts, *order).sortWithinPartitions(*order, text).drop("text_hash")
    ordered.mapInArrow(run, ARCHIVE_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    return digest


def read_archive(spark: SparkSession, path: str, keys: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of an archive: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids themselves.

    ``start`` counts the ids of all documents before. With ``keys``, only blocks
    whose key range holds one of them are read, and only those frames opened.
    """
    digest, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(dictionary)
    if (hashlib.sha256(dictionary).hexdigest() if dictionary else "") != digest:
        raise ValueError("the dictionary does not match its hash")
    blocks = spark.read.schema(ARCHIVE_SCHEMA).parquet(f"{path}/blocks")
    # a row per range partition, whatever the number of documents
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("part_tokens").over(w), F.lit(0)).alias("part_start"))
    wanted = None
    if keys is not None:
        wanted = sorted(keys)
        hit = F.lit(False)
        for k in wanted:
            # null keys come first in a block
            hit = hit | ((F.col("first_key").isNull() | (F.col("first_key") <= k)) & (F.col("last_key") >= k))
        blocks = blocks.where(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("a block was written with another dictionary")
                block = Block(row["data"], dictionary)
                starts = row["part_start"] + row["n_before"] + np.cumsum(block.counts, dtype=np.int64) - block.counts
                take = np.arange(len(block.keys)) if wanted is None else np.flatnonzero(np.isin(block.keys, wanted))
                ids = [block.ids(i).astype("<u4") for i in take]
                bare = [None if k == NULL_KEY else int(k) for k in block.keys[take]]
                columns = {"doc_id": pa.array(bare, pa.int64()), "start": pa.array(starts[take]), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    # starts has one small row per range partition of the writing job
    joined = blocks.join(F.broadcast(starts), "part").select("n_before", "dictionary_sha256", "data", "part_start")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def archived(docs: DataFrame, vocabulary: str, end_id: int = 0, pieces: int = 0) -> DataFrame:
    """Write ``docs`` to a fresh archive and give the digest of each document read back; ``pieces`` bounds a worker's memory (0: ``CACHED_PIECES``)."""
    spark = docs.sparkSession
    path = scratch(spark, "token-archive")
    write_archive(docs, path, vocabulary, end_id=end_id, pieces=pieces)
    return read_archive(spark, path, with_ids=False)


def op6_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return archived(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
