"""Toxicity by compression distance.

Two zstandard dictionaries compress short windows of words; a window's distance is the
ordinary length less the toxic length. The ordinary dictionary is trained on ordinary
text. The toxic dictionary has the same trained tables and content, followed by what
toxic texts have beyond ordinary ones: words found in many different toxic texts and in
few ordinary ones, the most frequent last, where they are cheapest to refer to. (With zstandard's own trainer on
toxic text alone, both dictionaries fill with ordinary words and distances drown in noise.)

Calibration on labelled texts that did not shape the dictionaries: each distance has a
log-likelihood ratio, and a logistic regression over a text's sum and mean of them and its
number of windows gives the score.

Null and empty texts count as one empty window. Repeated rows each give a row. Without
both labels the score is the share of label 1 (0.5 if there are no labels).
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.labelled import Logistic, held_out, labelled_sample, scored

#: Rows of each label that fitting may use, and the bytes of all their texts.
SAMPLE_PER_CLASS = 3000
SAMPLE_BYTES = 1 << 26
WINDOW_BYTES = 64
ORDINARY_BYTES = 1 << 14
TOXIC_BYTES = 640
LEVEL = 3
STEMS = (5, 6, 7)
#: Ways to choose the toxic words; the one that tells the calibration texts apart best is taken.
CHOICES = [(least, stems) for least in (0.004, 0.015, 0.05) for stems in (False, True)]
#: Distances are told apart up to this many bytes either way.
REACH = 16


def windows(raw: bytes) -> list[bytes]:
    """Whole words in runs of at least ``WINDOW_BYTES``, the last one shorter."""
    out, run, size = [], [], 0
    for word in raw.lower().split():
        run.append(word)
        size += len(word) + 1
        if size >= WINDOW_BYTES:
            out.append(b" %b " % b" ".join(run))
            run, size = [], 0
    if run or not out:
        out.append(b" %b " % b" ".join(run))
    return out


def _words(text: str) -> set[bytes]:
    return {w.strip(b".,;:!?") for w in text.encode().lower().split()} - {b""}


def _support(texts: list[str]) -> tuple[dict[bytes, set], int]:
    """The different texts that hold each word or stem (the first bytes of longer words); near
    copies, with the same least word hash, count once."""
    found: dict[bytes, set] = defaultdict(set)
    marks = set()
    for x in texts:
        words = _words(x)
        mark = min(map(zlib.crc32, words), default=0)
        marks.add(mark)
        for w in words:
            found[w].add(mark)
            for size in STEMS:
                if len(w) > size:
                    found[w[:size] + b"-"].add(mark)
    return found, len(marks)


def toxic_content(toxic: tuple, ordinary: tuple, least: float, stems: bool) -> bytes:
    """Words that mark toxic texts, the most widespread at the end.

    ``toxic`` and ``ordinary`` come from ``_support``; a word counts from a share ``least`` of
    toxic texts. With ``stems``, a stem stands for its words where it is far more widespread
    than each of them; of nested stems the longest that loses little.
    """
    (many, n), (few, m) = toxic, ordinary
    enough = max(3, least * n)
    marked = {w: len(t) for w, t in many.items() if len(t) >= enough and len(t) / n > 8 * (len(few.get(w, ())) + 0.5) / max(m, 1)}
    kept = {w: t for w, t in marked.items() if not w.endswith(b"-")}
    if stems:
        best: dict[bytes, int] = defaultdict(int)
        for w, t in many.items():
            if not w.endswith(b"-"):
                for size in STEMS:
                    best[w[:size]] = max(best[w[:size]], len(t))
        found = {w[:-1]: t for w, t in marked.items() if w.endswith(b"-") and t >= 2 * best[w[:-1]]}
        for w in sorted(found, key=len):
            longer = [v for v in found if len(v) > len(w) and v.startswith(w)]
            if max((found[v] for v in longer), default=0) >= 0.7 * found[w]:
                found[w] = 0
            else:
                found |= dict.fromkeys(longer, 0)
        kept |= {w: t for w, t in found.items() if t}
    return b"".join(b" " + w for w in sorted(kept, key=lambda w: (kept[w], w)))[-TOXIC_BYTES:]


class Distances:
    """Compression lengths under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        import zstandard

        def compressor(data: bytes):
            shared = zstandard.ZstdCompressionDict(data)
            shared.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.ordinary, self.toxic = compressor(ordinary), compressor(ordinary + toxic)

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        import zstandard

        sizes = np.asarray([len(x) for x in parts], "<u8")
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u8").tobytes()
        source = zstandard.BufferWithSegments(b"".join(parts), segments)
        lengths = [np.asarray([len(x) for x in c.multi_compress_to_buffer(source, threads=0)]) for c in (self.ordinary, self.toxic)]
        return lengths[0] - lengths[1]


def train_ordinary(texts: list[str]) -> bytes:
    import zstandard

    parts = [w for x in texts for w in windows(x.encode())]
    parts = parts[:: max(1, len(parts) // 40_000)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, parts, d=8, k=40).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):  # too little text to train on
        return b"\0" * 8 + b"".join(parts)[-ORDINARY_BYTES:]


class ToxicityModel:
    """Dictionaries, log-likelihood ratios of distances, and the last regression."""

    def __init__(self, sample, share: float) -> None:
        self.share, self.ready = share, False
        shape = sample["key"].map(lambda k: zlib.crc32(f"part {k}".encode()) % 3 > 0)
        parts = {(a, y): sample.loc[(shape == a) & (sample["y"] == y), "text"].tolist() for a in (True, False) for y in (0, 1)}
        if min(map(len, parts.values())) < 2:
            return
        base = train_ordinary(parts[True, 0])
        support = _support(parts[True, 1]), _support(parts[True, 0])
        y = np.repeat([0, 1], [len(parts[False, k]) for k in (0, 1)])
        best = -1.0
        for content in dict.fromkeys(toxic_content(*support, *choice) for choice in CHOICES):
            self.data, self.tool = (base, content), Distances(base, content)
            seen = [self._distances(parts[False, k]) for k in (0, 1)]
            counts = np.stack([np.bincount(np.concatenate(s) + REACH, minlength=2 * REACH + 1) for s in seen]) + 3.0
            rates = counts / counts.sum(axis=1, keepdims=True)
            self.ratio = np.log(rates[1] / rates[0])
            x = np.asarray([self._features(d) for s in seen for d in s])
            regression = Logistic(x, y, share)
            p = np.where(y == 1, regression(x), 1 - regression(x))
            fitness = float(np.exp(np.mean([np.log(p[y == k]).mean() for k in (0, 1)])))
            if fitness > best:
                best, chosen = fitness, (self.data, self.ratio, regression)
        self.data, self.ratio, self.regression = chosen
        self.tool = Distances(*self.data)
        self.ready = True

    def _distances(self, texts: list[str | bytes]) -> list[np.ndarray]:
        if not hasattr(self, "tool"):
            self.tool = Distances(*self.data)
        cut = [windows(x if isinstance(x, bytes) else x.encode()) for x in texts]
        all_ = np.clip(self.tool([w for c in cut for w in c]), -REACH, REACH)
        return np.split(all_, np.cumsum([len(c) for c in cut])[:-1])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tool"}

    def _features(self, distances: np.ndarray) -> tuple[float, float, float]:
        r = self.ratio[distances + REACH]
        return r.sum(), r.mean(), np.log(len(r))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.ready:
            return np.full(len(texts), self.share)
        return self.regression(np.asarray([self._features(d) for d in self._distances(texts)])) if texts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, label: str = "toxic") -> ToxicityModel:
    return ToxicityModel(*labelled_sample(docs, labels, label, ~held_out("doc_id", modulus, remainder), SAMPLE_PER_CLASS, SAMPLE_BYTES))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
