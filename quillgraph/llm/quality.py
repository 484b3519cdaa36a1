"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's features are shares of character kinds,
repetition and shape, those of the lines before and after it, and markers for the ends of the text.
Two transition weights let neighbouring lines agree. Training lines have their document's
label. Forward-backward gives every line's marginal probability of being good; their mean,
weighted by line length, is the document's raw quality, which a one-variable logistic
regression on the labels turns into the score.

A null or empty text is one empty line. Repeated rows each give a row. Without both labels
the score is the share of label 1 (0.5 if there are no labels).
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.labelled import Logistic, held_out, labelled_sample, scored

#: Rows of each label that fitting may use, and the bytes of all their texts.
SAMPLE_PER_CLASS = 2000
SAMPLE_BYTES = 1 << 26
STEPS, RATE, RIDGE = 250, 0.1, 1e-3

LOWER, UPPER, DIGIT, SPACE, STOP, BANG, BAR, MARK = range(8)
_KINDS = np.full(256, MARK, np.uint8)
for _kind, _bytes in ((LOWER, bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))), (UPPER, bytes(range(0x41, 0x5B))), (DIGIT, b"0123456789"), (SPACE, b" \t\r\v\f"), (STOP, b".,;:'"), (BANG, b"!?"), (BAR, b"|")):
    _KINDS[list(_bytes)] = _kind
_UPPER_LEAD = 0xC3  # before 0x80-0x9E: a capital Latin letter with an accent


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, lines of each text)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    n = len(ends)
    kinds = _KINDS[data]
    accents = np.flatnonzero(data[:-1] == _UPPER_LEAD) + 1
    accents = accents[data[accents] < 0x9F]
    kinds[accents] = UPPER
    line = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(line * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    counts[:, MARK] -= 1  # the line end itself
    lines = [y for x in texts for y in x.split(b"\n")]
    words = np.empty((n, 4))
    for i, y in enumerate(lines):
        w = y.split()
        m = len(w)
        words[i] = m, len(set(w)), sum(map(eq, w, w[1:])), max(map(len, w)) if m else 0
    per_text = np.asarray([x.count(b"\n") + 1 for x in texts])
    again = np.zeros(n)
    at = 0
    for m in per_text.tolist():
        if m > 1:
            seen: set[bytes] = set()
            for i in range(at, at + m):
                if lines[i] in seen:
                    again[i] = 1
                else:
                    seen.add(lines[i])
        at += m
    size = np.maximum(sizes, 1)[:, None]
    m = np.maximum(words[:, 0], 1)
    x = np.column_stack(
        [
            counts[:, [UPPER, DIGIT, SPACE, STOP, BANG, BAR, MARK]] / size,
            np.sqrt(counts[:, [BANG, BAR, MARK]] / m[:, None]),
            1 - words[:, 1] / m,
            words[:, 2] / m,
            np.log1p(words[:, 3]),
            np.log1p(sizes),
            again,
        ]
    )
    return x, sizes, per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, those of both neighbours (zero beyond the ends), and end markers."""
    ends = np.cumsum(per_text)
    first, last = ends - per_text, ends - 1
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    marks = np.zeros((len(x), 2))
    marks[first, 0], marks[last, 1] = 1, 1
    return np.column_stack([x, before, after, marks])


def marginals(score: np.ndarray, per_text: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2), and the sum of log partition functions.

    ``score`` is a line's score for good (bad has 0). All texts advance line by line together.
    """
    ends = np.cumsum(per_text)
    first = ends - per_text
    order = np.argsort(-per_text, kind="stable")
    emit = np.column_stack([np.zeros(len(score)), score])
    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    longest = int(per_text.max(initial=0))
    live = np.searchsorted(-per_text[order], -np.arange(longest), side="left")
    # texts still running at line t: those with more than t lines
    forward[first] = emit[first]
    for t in range(1, longest):
        at = first[order[: live[t]]] + t
        forward[at] = emit[at] + np.logaddexp(*(forward[at - 1][:, a, None] + transition[a] for a in (0, 1)))
    for t in range(longest - 1, 0, -1):
        at = first[order[: live[t]]] + t
        ahead = emit[at] + backward[at]
        backward[at - 1] = np.logaddexp(*(ahead[:, b, None] + transition[:, b] for b in (0, 1)))
    last = ends - 1
    whole = np.logaddexp(forward[last, 0], forward[last, 1])
    of = np.repeat(whole, per_text)
    p = np.exp(forward[:, 1] + backward[:, 1] - of)
    inner = np.setdiff1d(np.arange(len(score)), first, assume_unique=True)
    joint = forward[inner - 1][:, :, None] + transition[None] + (emit[inner] + backward[inner])[:, None, :] - of[inner][:, None, None]
    return p, np.exp(joint).sum(axis=0), float(whole.sum())


class QualityModel:
    def __init__(self, sample, share: float) -> None:
        self.share = share
        labels = sample["y"].to_numpy().astype(int)
        self.ready = bool(len(labels)) and 0 < labels.sum() < len(labels)
        if not self.ready:
            return
        own, sizes, per_text = line_features([x.encode() for x in sample["text"]])
        x = with_neighbours(own, per_text)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        y = np.repeat(labels, per_text).astype(float)
        inner = per_text - 1
        observed = np.diag([inner[labels == 0].sum(), inner[labels == 1].sum()]).astype(float)
        weight, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
        moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(transition), np.zeros_like(transition)]
        n = len(x)
        for step in range(1, STEPS + 1):  # Adam on the penalized log-likelihood
            p, expected, _ = marginals(x @ weight, per_text, transition)
            slopes = [(x.T @ (y - p)) / n - RIDGE * weight, (observed - expected) / n - RIDGE * transition]
            for k, (value, slope) in enumerate(zip((weight, transition), slopes, strict=True)):
                moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * slope
                moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * slope**2
                value += RATE * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        self.weight, self.transition = weight, transition
        self.regression = Logistic(self._raw(own, sizes, per_text)[:, None], labels, share)

    def _raw(self, own: np.ndarray, sizes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own, per_text) - self.mean) / self.scale
        p, _, _ = marginals(self.weight[0] + x @ self.weight[1:], per_text, self.transition)
        first = np.cumsum(per_text) - per_text
        length = sizes + 1.0
        return np.add.reduceat(p * length, first) / np.add.reduceat(length, first)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.ready or not texts:
            return np.full(len(texts), self.share)
        return self.regression(self._raw(*line_features(texts))[:, None])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, label: str = "quality") -> QualityModel:
    return QualityModel(*labelled_sample(docs, labels, label, ~held_out("doc_id", modulus, remainder), SAMPLE_PER_CLASS, SAMPLE_BYTES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
