"""Language-model scoring by causal self-attention over subword ids.

A text is its words (between ASCII white space, A-Z lower-cased), each written with a
space before it, as ids of a public byte-level vocabulary; then one end. The log probability of a
text is a sum over all its ids; each comes from causal self-attention trained in numpy:

* the first id of each word (or the end) from a layer that reads the words before, each as the
  embeddings of its first and last ids;
* the other ids of a word, and the word's end, from a layer masked to the ids of the word itself, so
  that a word's own probability is worked out once for all its occurrences.

Both layers give a whole distribution over ids: a softmax over classes, and one over the ids of a class. The
``CLASSES * SLOTS`` most frequent ids have weights of their own, the others fixed shares of one class. Two
things that are counted over the whole training corpus are mixed in, each by absolute discounting, so that
probabilities still sum to one:

* words: of the share of its first id, a word known from training has its own part, and the attention over
  its ids divides what is left (the discounts);
* phrases: after every run of three words, the first ids that followed it in training have parts of their
  own, and attention divides what is left. Phrases are told by a hash: its part, and 48 bits. They are counted where texts are scored:
  each place of a text goes once to the part of its phrase, packed, and what a text gains there comes back as one sum.

Texts are scored in windows of ``WINDOW`` words that overlap by ``CONTEXT``: each word is scored
once, in the window that shows at least ``CONTEXT`` words before it (all, near the start).
Windows begin with their text, so a score depends on the text alone.

Training. Every training text is cut into windows that cover all its words, and the loss takes every word of them.
The layer inside words learns from every distinct training word, all its ids and its end. Windows and words are dealt to trainers of bounded size, each runs Adam from the same start
on its part of the round, a step a batch, and weights are averaged, for ``ROUNDS`` rounds. So windows, words and phrases
grow with the corpus; the weights do not. The driver sees averaged weights, counts of ids, and the most
frequent words, which are a cache: all others meet their counts in joins, with the same results.

The base score is the add-one unigram model over words. Null and empty texts are one end. Repeated rows
each give a row. With no training text all counts are 0, and scores come from an untrained model.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, give_back, kept_in_worker, saved, slices, table
from quillgraph.llm.labelled import held_out

WINDOW, CONTEXT = 16, 4  # words
INNER_WINDOW, INNER_CONTEXT = 12, 4  # ids inside a word
RUN = 8 * WINDOW  # words in a training row
PLACES = 32  # of ids in a word; later ones share the last
WIDTH = 16
CLASSES, SLOTS = 32, 32
INPUTS = 4096  # ids with an embedding of their own; the others share one
ROUNDS, RATE = 2, 0.02
BATCH, INNER_BATCH, STEPS = 512, 1024, 128  # smaller batches where a trainer would have fewer steps
#: About so many runs of words, or words, a trainer and round.
TRAINER_RUNS, TRAINER_WORDS = 1 << 13, 1 << 17
HOT_WORDS = 1 << 18
#: Words whose spelling is worked out at once.
PART = 1 << 14
#: About so many training words to a part of the phrases.
PHRASES = 3 << 19
DISCOUNT = 0.75

#: White space that isn't ASCII: the word splitter may join it over a space.
_RARE_SPACE = re.compile(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Subwords:
    """Ids of words; the same in every worker."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.coder = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n = max(ranks.values()) + 1
        self.end, self.size = self.n, self.n + 1  # the end of a text, or of a word
        self.begins = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.begins[i] = token[:1] == b" "
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<i4")  # of stored ids
        self.opens, self.goes_on = self.begins.copy(), ~self.begins
        self.opens[self.end] = True

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and how many each word has; they don't depend on the words beside."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if _RARE_SPACE.search(text):
            odd = np.asarray([bool(_RARE_SPACE.search(w.decode("utf-8", "replace"))) for w in words])
            found = np.empty(len(words), object)
            ids, sizes = self.ids([words[i] for i in np.flatnonzero(~odd).tolist()])
            found[~odd] = np.array([*np.split(ids, np.cumsum(sizes)[:-1]), None], object)[:-1] if len(sizes) else []
            for i in np.flatnonzero(odd).tolist():
                found[i] = self._encoded(" " + words[i].decode("utf-8", "replace"))
            return np.concatenate(found), np.asarray([len(x) for x in found])
        ids = self._encoded(text)
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))

    def _encoded(self, text: str) -> np.ndarray:
        return np.asarray(self.coder.encode_to_numpy(text, disallowed_special=()), np.int64)


def subwords(path: str) -> Subwords:
    return kept_in_worker(f"subwords {path}", lambda: Subwords(path))


def _texts(batch: pa.RecordBatch, text: str) -> list[list[bytes]]:
    return [(x or b"").lower().split() for x in pc.cast(batch.column(text), pa.binary()).to_pylist()]


# -- counts ----------------------------------------------------------------


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all texts."""
    from collections import Counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, text):
            for words in _texts(batch, text):
                found.update(words)
            if len(found) > 300_000:
                yield _counted(found)
                found = Counter()
        if found:
            yield _counted(found)

    def _counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], ["word", "c"])

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_ids(words: DataFrame, vocabulary: str) -> DataFrame:
    """(id, tokens, kinds, inside): words with the first id, by occurrence and distinct; distinct words' other ids and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = subwords(vocabulary)
        sums = np.zeros((3, tool.size), np.int64)
        for batch in slices(batches, "word"):
            ids, sizes = tool.ids(batch.column("word").to_pylist())
            first = ids[np.cumsum(sizes) - sizes]
            sums[0] += np.bincount(first, batch.column("c").to_numpy(), minlength=tool.size).astype(np.int64)
            sums[1] += np.bincount(first, minlength=tool.size)
            sums[2] += np.bincount(np.append(ids[~tool.begins[ids]], np.full(len(sizes), tool.end)), minlength=tool.size)
        met = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(s[met]) for s in sums)], ["id", "tokens", "kinds", "inside"])

    counted = words.mapInArrow(run, "id long, tokens long, kinds long, inside long")
    return counted.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("tokens", "kinds", "inside")))


def most_frequent(counts: DataFrame, count: str, kept: int) -> DataFrame:
    """Rows with the greatest counts: all above the least level (eight to a doubling) that leaves ``kept`` at most."""
    log = F.floor(8 * F.log2(F.col(count).cast("double"))).cast("int")
    sizes = sorted(((int(r[0]), int(r[1])) for r in counts.groupBy(log.alias("log")).agg(F.count("*")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for level, n in sizes:
        if total + n > kept:
            break
        least, total = level, total + n
    return counts.where(log >= least)


# -- attention -------------------------------------------------------------


class NextIds:
    """The ids that may come next: in classes of ``SLOTS`` by frequency, the rest together in one class more."""

    def __init__(self, allowed: np.ndarray, count: np.ndarray) -> None:
        weight = np.where(allowed, count + 0.5, 0)
        top = np.argsort(-weight, kind="stable")[: CLASSES * SLOTS]
        top = top[weight[top] > 0]
        self.of = np.full(len(weight), CLASSES)
        self.slot = np.zeros(len(weight), np.int64)
        self.of[top], self.slot[top] = np.divmod(np.arange(len(top)), SLOTS)
        mass = np.bincount(self.of, weight, minlength=CLASSES + 1)
        with np.errstate(divide="ignore"):
            self.share = np.where(self.of == CLASSES, np.log(weight) - np.log(max(mass[-1], 1e-9)), 0.0)
            self.bias = np.where(mass > 0, np.log(mass / mass.sum()), -1e9).astype(np.float32)
        self.slot_bias = np.full((CLASSES, SLOTS), -1e9, np.float32)
        self.slot_bias[self.of[top], self.slot[top]] = np.log(weight[top])


class Attention:
    """One layer over windows; an input is the sum of two embeddings."""

    def __init__(self, weights: dict[str, np.ndarray], nexts: NextIds, context: int) -> None:
        self.w, self.nexts, self.context = weights, nexts, context
        self.window = len(weights["near"])

    @staticmethod
    def new_weights(nexts: NextIds, window: int, seconds: int) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(0)
        draw = lambda *shape, scale=0.25: (rng.standard_normal(shape) * scale).astype(np.float32)
        return {
            "first": draw(INPUTS, WIDTH),
            "last": draw(seconds, WIDTH),
            "qkv": draw(WIDTH, 3 * WIDTH),
            "near": np.zeros(window, np.float32),
            "own": draw(WIDTH, WIDTH),
            "seen": draw(WIDTH, WIDTH),
            "hidden": np.zeros(WIDTH, np.float32),
            "out": draw(WIDTH, CLASSES + 1, scale=0.05),
            "bias": nexts.bias.copy(),
            "slots": draw(CLASSES, WIDTH, SLOTS, scale=0.05),
            "slot_bias": nexts.slot_bias.copy(),
        }

    def log_probabilities(self, first: np.ndarray, last: np.ndarray, targets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P of each target of sequences laid end to end; ``first`` and ``last`` are embedding rows of what comes before it."""
        w, end, context = self.w, len(targets) - 1, self.context
        stride = self.window - context
        x = w["first"].take(first, axis=0) + w["last"].take(last, axis=0)
        q, k, v = np.split(x @ w["qkv"], 3, axis=1)
        q, k = q * np.float32(WIDTH**-0.5), np.ascontiguousarray(k)
        v = np.column_stack([v, np.ones(len(v), np.float32)])  # so that sums come with the product
        begins = np.cumsum(sizes) - sizes
        windows = -(-sizes // stride)
        text = np.repeat(np.arange(len(sizes)), windows)
        number = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        at_first = begins[text] + number * stride
        ends = (begins + sizes)[text]
        lag = np.arange(self.window)[:, None] - np.arange(self.window)[None, :]
        near = np.where(lag >= 0, np.exp(w["near"])[np.maximum(lag, 0)], np.float32(0))[context:]
        alone = near * (np.arange(self.window) >= context)  # a first window has nothing before it
        h = np.empty((len(targets), WIDTH), np.float32)
        for rows, weight in ((np.flatnonzero(number == 0), alone), (np.flatnonzero(number > 0), near)):
            for a in range(0, len(rows), 128):
                part = rows[a : a + 128]
                seen = np.clip(at_first[part][:, None] + np.arange(-context, stride), 0, end)
                asked = seen[:, context:]
                s = np.matmul(q.take(asked, axis=0), k.take(seen, axis=0).transpose(0, 2, 1))
                np.exp(np.minimum(s, np.float32(60), out=s), out=s)
                s *= weight
                out = np.matmul(s, v.take(seen, axis=0))
                inside = at_first[part][:, None] + np.arange(stride) < ends[part][:, None]
                out = out[inside]
                h[asked[inside]] = out[:, :WIDTH] / (out[:, WIDTH:] + np.float32(1e-30))
        result = np.empty(len(targets), np.float64)
        for a in range(0, len(targets), 16384):
            part = slice(a, a + 16384)
            u = np.tanh(x[part] @ w["own"] + h[part] @ w["seen"] + w["hidden"])
            result[part] = self._log_of(u, targets[part])
        return result

    def _log_of(self, u: np.ndarray, targets: np.ndarray) -> np.ndarray:
        w, top = self.w, np.float32(60)

        def chosen(e: np.ndarray, at: np.ndarray) -> np.ndarray:
            np.minimum(e, top, out=e)
            own = e[np.arange(len(e)), at]
            return own - np.log(np.exp(e, out=e) @ np.ones(e.shape[1], np.float32))

        of = self.nexts.of[targets]
        result = chosen(u @ w["out"] + w["bias"], of) + self.nexts.share[targets]
        order = np.argsort(of, kind="stable")
        stops = np.searchsorted(of[order], np.arange(CLASSES + 1))
        u, slot = u[order], self.nexts.slot[targets[order]]
        bias = w["slot_bias"] - w["slot_bias"].max(axis=1, keepdims=True)
        inner = np.zeros(len(u))
        for c in np.flatnonzero(np.diff(stops)):
            rows = slice(stops[c], stops[c + 1])
            inner[rows] = chosen(u[rows] @ w["slots"][c] + bias[c], slot[rows])
        result[order] += inner
        return result

    def gradients(self, first: np.ndarray, last: np.ndarray, ask: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its slopes. ``ask`` (windows, asked): places whose ``targets`` are predicted, if ``real``."""
        w, d = self.w, WIDTH
        x = w["first"][first] + w["last"][last]
        row = np.arange(len(x))[:, None]
        own = x[row, ask]
        q = own @ w["qkv"][:, :d]
        k, v = np.split(x @ w["qkv"][:, d:], 2, axis=2)
        scale = np.asarray(d**-0.5, x.dtype)
        lag = ask[:, :, None] - np.arange(x.shape[1])
        s = np.matmul(q, k.transpose(0, 2, 1)) * scale + np.where(lag >= 0, w["near"][np.maximum(lag, 0)], np.asarray(-1e9, x.dtype))
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        out = np.matmul(s, v)
        u = np.tanh(own @ w["own"] + out @ w["seen"] + w["hidden"])
        n = max(int(real.sum()), 1)
        h, target = u[real], targets[real]
        of, slot = self.nexts.of[target], self.nexts.slot[target]

        def softmax(e: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
            """Loss, and the slope of its mean."""
            e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            e /= e.sum(axis=1, keepdims=True)
            loss = -np.log(np.maximum(e[np.arange(len(e)), at], 1e-30)).sum()
            e[np.arange(len(e)), at] -= 1
            e /= n
            return float(loss), e

        loss, p = softmax(h @ w["out"] + w["bias"], of)
        g = {"out": h.T @ p, "bias": p.sum(axis=0), "slots": np.zeros_like(w["slots"]), "slot_bias": np.zeros_like(w["slot_bias"])}
        dh = p @ w["out"].T
        order = np.argsort(of, kind="stable")
        stops = np.searchsorted(of[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(stops)):
            rows = order[stops[c] : stops[c + 1]]
            more, p = softmax(h[rows] @ w["slots"][c] + w["slot_bias"][c], slot[rows])
            loss += more
            g["slots"][c], g["slot_bias"][c] = h[rows].T @ p, p.sum(axis=0)
            dh[rows] += p @ w["slots"][c].T
        flat = lambda y: y.reshape(-1, y.shape[-1])
        du = np.zeros_like(u)
        du[real] = dh
        du *= 1 - u * u
        g["own"], g["seen"], g["hidden"] = flat(own).T @ flat(du), flat(out).T @ flat(du), flat(du).sum(axis=0)
        d_own = du @ w["own"].T
        d_out = du @ w["seen"].T
        dv = np.matmul(s.transpose(0, 2, 1), d_out)
        ds = np.matmul(d_out, v.transpose(0, 2, 1))
        ds = s * (ds - (ds * s).sum(axis=2, keepdims=True))
        seen = lag >= 0
        g["near"] = np.bincount(lag[seen], ds[seen], minlength=self.window)
        dq = np.matmul(ds, k) * scale
        d_kv = np.concatenate([np.matmul(ds.transpose(0, 2, 1), q) * scale, dv], axis=2)
        g["qkv"] = np.concatenate([flat(own).T @ flat(dq), flat(x).T @ flat(d_kv)], axis=1)
        dx = d_kv @ w["qkv"][:, d:].T
        dx[row, ask] += d_own + dq @ w["qkv"][:, :d].T
        dx = flat(dx)
        for name, rows in (("first", first.ravel()), ("last", last.ravel())):
            g[name] = np.stack([np.bincount(rows, column, minlength=len(w[name])) for column in dx.T], axis=1)
        return loss / n, {name: y.astype(x.dtype) for name, y in g.items()}


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], goal: int) -> None:
        self.w, self.goal, self.step = weights, goal, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def __call__(self, slopes: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = RATE * max(0.1, min(1.0, 2 * (1 - self.step / (self.goal + 1))))
        for k, g in slopes.items():
            first, second = self.first[k], self.second[k]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            self.w[k] -= (rate / (1 - 0.9**self.step) * first / (np.sqrt(second / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)


# -- the model -------------------------------------------------------------


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


class Words:
    """First and last ids, hashes and log P of words, looked up for frequent ones and worked out for others."""

    def __init__(self, model: ScoringModel, scoring: bool, hot: bool = True) -> None:
        self.model = model
        hot = model.hot_words.to_pylist() if hot else []
        self.number = _Numbered(zip(hot, range(len(hot)), strict=True))
        self.known = self._of(hot, False)
        if scoring:
            # in parts, so that work arrays stay small
            parts = [self.logs(hot[a : a + PART], model.hot_counts[a : a + PART]) for a in range(0, len(hot), PART)]
            self.known["log"] = np.concatenate([*parts, np.zeros(0)])

    def _of(self, words: list[bytes], scoring: bool) -> dict[str, np.ndarray]:
        import xxhash

        tool = self.model.tool
        ids, sizes = tool.ids(words)
        stops = np.cumsum(sizes)
        first = ids[stops - sizes]
        found = {"first": first, "last": ids[stops - 1], "hash": np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))}
        if scoring:
            mass = self.model.tokens_of[first] + 1.0
            left = (DISCOUNT * self.model.kinds_of[first] + 1) / mass
            found |= {"mass": mass, "log": self.model.spelled(ids, sizes) + np.log(left)}
        return found

    def logs(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log P of words given their first ids, from their training counts (0: unknown)."""
        found = self._of(words, True)
        own = np.maximum(counts - DISCOUNT, 0) / found["mass"]
        return np.logaddexp(found["log"], np.log(np.maximum(own, 1e-300)))

    def __call__(self, flat: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Numbers among the frequent words (-1: none) and the fields of each word; a rare word's log P is left at 0."""
        found = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        fields = {k: np.append(v, np.zeros(1, v.dtype))[found] for k, v in self.known.items()}
        rare = np.flatnonzero(found < 0)
        if len(rare):
            place: dict[bytes, int] = {}
            at = np.asarray([place.setdefault(flat[i], len(place)) for i in rare.tolist()])
            for k, v in self._of([*place], False).items():
                fields[k][rare] = v[at]
        return found, fields


class ScoringModel:
    """All that a task needs to train or score."""

    BUILT = ("tool", "tokens_of", "kinds_of", "opening", "inside", "input", "words_", "scoring_words")

    def __init__(self, vocabulary: str, counts: pa.Table, n_texts: int, hot: pa.Table) -> None:
        self.vocabulary, self.n_texts, self.counts = vocabulary, n_texts, counts
        self.hot_words, self.hot_counts = hot.column("word").combine_chunks(), hot.column("c").to_numpy()
        self.weights: dict[str, dict[str, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self.BUILT}

    def built(self) -> ScoringModel:
        """With its tables, once per worker."""
        if not hasattr(self, "input"):
            self.tool = tool = subwords(self.vocabulary)
            at = self.counts.column("id").to_numpy()
            full = {}
            for name in ("tokens", "kinds", "inside"):
                full[name] = np.zeros(tool.size)
                full[name][at] = self.counts.column(name).to_numpy()
            self.tokens_of, self.kinds_of = full["tokens"], full["kinds"]
            self.opening = NextIds(tool.opens, np.where(np.arange(tool.size) == tool.end, self.n_texts, full["tokens"]))
            self.inside = NextIds(tool.goes_on, full["inside"])
            order = np.argsort(-(full["tokens"] + full["inside"]), kind="stable")[: INPUTS - 1]
            rows = np.full(tool.size, INPUTS - 1)
            rows[order] = np.arange(len(order))
            self.input = rows
            self.weights = self.weights or {
                "words": Attention.new_weights(self.opening, WINDOW, INPUTS),
                "inner": Attention.new_weights(self.inside, INNER_WINDOW, PLACES),
            }
        return self

    def network(self, name: str) -> Attention:
        nexts, context = {"words": (self.opening, CONTEXT), "inner": (self.inside, INNER_CONTEXT)}[name]
        return Attention(self.weights[name], nexts, context)

    def lookup(self, scoring: bool) -> Words:
        self.built()
        name = "scoring_words" if scoring else "words_"
        if not hasattr(self, name):
            setattr(self, name, Words(self, scoring))
        return getattr(self, name)

    def inner_steps(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows (id, place in the word) and the id that comes next, the word's end last."""
        after = np.append(ids[1:], self.tool.end)
        after[np.cumsum(sizes) - 1] = self.tool.end
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.input[ids], np.minimum(place, PLACES - 1), after

    def spelled(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P of each word's ids after the first, and of its end."""
        if not len(sizes):
            return np.zeros(0)
        p = self.network("inner").log_probabilities(*self.inner_steps(ids, sizes), sizes)
        return np.add.reduceat(p, np.cumsum(sizes) - sizes)

    def laid(self, texts: list[list[bytes]], scoring: bool) -> dict[str, np.ndarray]:
        """Of each target (the words of a text, and its end): the ids before and its own, and the hash of its phrase (0: none)."""
        flat = [w for x in texts for w in x]
        found, words = self.lookup(scoring)(flat)
        lengths = np.asarray([len(x) for x in texts], np.int64)
        stops = np.cumsum(lengths)
        ends = lambda y, value: np.insert(y, stops, value)
        sizes = lengths + 1
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(text)) - starts[text]
        before = np.arange(len(text)) - text - 1  # the word before, in ``flat``
        phrase = np.zeros(len(text), np.uint64)
        ask = np.flatnonzero(place >= 3)
        h, b = words["hash"], before[ask]
        phrase[ask] = _mix(_mix(_mix(h[b - 2]) + h[b - 1]) + h[b] * _ODD[1])
        shifted = {k: np.where(place > 0, np.append(words[k], 0)[before], self.tool.end) for k in ("first", "last")}
        out = {"found": found, "sizes": sizes, "starts": starts, "stops": stops, "target": ends(words["first"], self.tool.end), "phrase": phrase, **shifted}
        if scoring:
            out |= {"log": ends(words["log"], 0.0), "rare": [flat[i] for i in np.flatnonzero(found < 0).tolist()]}
        return out


# -- training --------------------------------------------------------------


def training_rows(docs: DataFrame, text: str, held) -> DataFrame:
    """Runs of whole windows that cover every training text (round, place, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = held.value.built()
        end, number = model.tool.end, TaskContext.get().partitionId() << 32
        for batch in slices(batches, text):
            laid = model.laid(_texts(batch, text), scoring=False)
            # an entry more than targets in each text: what comes before the first
            first, last = (np.insert(laid[k], laid["starts"][1:], end) for k in ("first", "last"))
            steps = np.stack([np.append(first, end), np.append(last, end)], axis=1).astype(model.tool.kind)
            begins = laid["starts"] + np.arange(len(laid["starts"]))
            rows = []
            for a, n in zip(begins.tolist(), laid["sizes"].tolist(), strict=True):
                rows += [steps[i : min(i + RUN, a + n) + 1].tobytes() for i in range(a, a + n, RUN)]
            place = (_mix(np.arange(number, number + len(rows)).astype(np.uint64) * _ODD[2]) >> np.uint64(1)).view(np.int64)
            number += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array((place % ROUNDS).astype(np.int32)), pa.array(place // ROUNDS), pa.array(rows, pa.binary())], ["round", "place", "ids"])

    return docs.select(text).mapInArrow(run, "round int, place long, ids binary")


# -- phrases ---------------------------------------------------------------

#: Steps of log P to one.
LOG_STEPS = 1 << 17
SPOTS = "first long, texts int, learns binary, sizes binary, phrases binary, nexts binary, logs binary"


def _low(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _raised(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def packed_spots(laid: dict[str, np.ndarray], opening: np.ndarray, learns: np.ndarray, first: int, parts: int, kind: np.dtype) -> pa.RecordBatch:
    """part and ``SPOTS``: of each part of the phrases, how many of its places each text has, their phrases, the ids that come next and their log P.

    Texts are numbered from ``first``; ``learns``: whether each is a training text. A phrase takes 6 bytes, and log P 3 (steps of 2^-17).
    """
    spots = np.flatnonzero(laid["phrase"])
    phrase = laid["phrase"][spots]
    part = ((phrase >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    spots, phrase, part = (x[order] for order in (np.argsort(part, kind="stable"),) for x in (spots, phrase, part))
    text = np.searchsorted(laid["starts"], spots, side="right") - 1
    nexts, logs = laid["target"][spots].astype(kind), np.clip(np.rint(opening[spots] * -LOG_STEPS), 0, (1 << 24) - 1)
    met = np.unique(part)
    bounds = [*np.searchsorted(part, met).tolist(), len(part)]
    cut = lambda x, f: pa.array([f(x[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
    sizes = lambda x: _squeezed(np.bincount(x, minlength=len(learns)).astype(np.int32))
    flags = [np.packbits(learns).tobytes()] * len(met)
    columns = [pa.array(met.astype(np.int32)), pa.array(np.full(len(met), first)), pa.array(np.full(len(met), len(learns), np.int32)), pa.array(flags, pa.binary()), cut(text, sizes), cut(phrase, lambda x: _low(x, 6)), cut(nexts, _squeezed), cut(logs, lambda x: _low(x, 3))]
    return pa.RecordBatch.from_arrays(columns, ["part", "first", "texts", "learns", "sizes", "phrases", "nexts", "logs"])


def phrase_gains(spots: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(texts, gains): what the log10 probability of texts gains from the phrases of one part, counted over its training texts."""
    column = {c: spots.column(c).to_pylist() for c in spots.column_names}
    count = [len(x) // 6 for x in column["phrases"]]
    read = lambda x, n, d: np.frombuffer(pa.decompress(x, n * np.dtype(d).itemsize, "zstd"), d)
    sizes = [read(x, n, np.int32) for x, n in zip(column["sizes"], column["texts"], strict=True)]
    texts = np.concatenate([first + np.arange(n) for first, n in zip(column["first"], column["texts"], strict=True)])
    learns = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(column["learns"], column["texts"], strict=True)]).astype(bool)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.concatenate(sizes))
    phrase, following = _raised(b"".join(column["phrases"]), 6), np.concatenate([read(x, n, kind) for x, n in zip(column["nexts"], count, strict=True)])
    order = np.lexsort((following, phrase))
    phrase, following, of = phrase[order], following[order], of[order]
    log = _raised(b"".join(column["logs"]), 3)[order].astype(np.float32) / np.float32(-LOG_STEPS)
    new_phrase = np.append(True, phrase[1:] != phrase[:-1])
    new_pair = new_phrase | np.append(True, following[1:] != following[:-1])
    pair, of_phrase = np.cumsum(new_pair) - 1, np.cumsum(new_phrase) - 1
    n = np.add.reduceat(learns[of].astype(np.int64), np.flatnonzero(new_pair))
    pairs_phrase = of_phrase[new_pair]
    total = np.bincount(pairs_phrase, n)
    followers = np.bincount(pairs_phrase, n > 0)
    known = np.flatnonzero(total[of_phrase] > 0)
    p = of_phrase[known]
    own = np.maximum(n[pair[known]] - DISCOUNT, 0) / total[p]
    gain = np.log10(own / np.exp(log[known].astype(np.float64)) + DISCOUNT * followers[p] / total[p])
    sums = np.bincount(of[known], gain, minlength=len(texts))
    met = np.flatnonzero(np.bincount(of[known], minlength=len(texts)))
    return texts[met], sums[met]


# -- trainers --------------------------------------------------------------


def _window_steps(model: ScoringModel, group: pa.Table, rng: np.random.Generator) -> Iterator[tuple]:
    sizes = np.asarray([len(x) for x in group.column("ids").to_pylist()]) // (2 * model.tool.kind.itemsize)
    flat = np.frombuffer(b"".join(group.column("ids").to_pylist()), model.tool.kind).reshape(-1, 2).astype(np.int64)
    stops = np.cumsum(sizes)
    windows = -(-(sizes - 1) // WINDOW)
    run = np.repeat(np.arange(len(sizes)), windows)
    begin = (stops - sizes)[run] + WINDOW * (np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows))
    inputs, end = model.input[flat], stops[run]
    size = min(BATCH, max(16, len(run) // STEPS))
    order = rng.permutation(len(run))
    yield -(-len(run) // size)
    for a in range(0, len(run), size):
        some = order[a : a + size]
        at = np.minimum(begin[some][:, None] + np.arange(WINDOW), len(flat) - 1)
        ask = np.broadcast_to(np.arange(WINDOW), at.shape)
        target = begin[some][:, None] + ask + 1
        real = target < end[some][:, None]
        yield inputs[at, 0], inputs[at, 1], ask, flat[np.minimum(target, len(flat) - 1), 0], real


def _word_steps(model: ScoringModel, group: pa.Table, rng: np.random.Generator) -> Iterator[tuple]:
    words = group.column("word").to_pylist()
    size = min(INNER_BATCH, max(32, len(words) // STEPS))
    order = rng.permutation(len(words))
    yield -(-len(words) // size)
    for a in range(0, len(words), size):
        ids, sizes = model.tool.ids([words[i] for i in order[a : a + size].tolist()])
        first, place, after = model.inner_steps(ids, sizes)
        # windows of a word overlap, so that each id but a word's first few has some before it
        stride = INNER_WINDOW - INNER_CONTEXT
        windows = np.maximum(1, -(-(sizes - INNER_CONTEXT) // stride))
        word = np.repeat(np.arange(len(sizes)), windows)
        begin = (np.cumsum(sizes) - sizes)[word] + stride * (np.arange(len(word)) - np.repeat(np.cumsum(windows) - windows, windows))
        at = begin[:, None] + np.arange(INNER_WINDOW)
        real = at < np.cumsum(sizes)[word][:, None]
        real[1:, :INNER_CONTEXT] &= (word[1:] != word[:-1])[:, None]
        at = np.minimum(at, len(ids) - 1)
        yield first[at], place[at], np.broadcast_to(np.arange(INNER_WINDOW), at.shape), after[at], real


def _learner(held, name: str, number: int):
    """What a trainer does with its group in a round: its weights in pieces."""

    def learn(group: pa.Table) -> pa.Table:
        model = held.value.built()
        weights = {k: v.copy() for k, v in model.weights[name].items()}
        start = model.network(name)
        network = Attention(weights, start.nexts, start.context)
        batches = (_window_steps if name == "words" else _word_steps)(model, group, np.random.default_rng(number))
        adam = Adam(weights, next(batches))
        for batch in batches:
            adam(network.gradients(*batch)[1])
        flat = np.concatenate([weights[k].ravel() for k in weights])
        pieces = np.array_split(flat, max(1, len(flat) // 8192))
        give_back()
        return pa.table({"piece": pa.array(np.arange(len(pieces)), pa.int32()), "data": pa.array([p.tobytes() for p in pieces], pa.binary()), "n": pa.array(np.full(len(pieces), group.num_rows), pa.int64())})

    return learn


def train(model: ScoringModel, name: str, rows: DataFrame, place, round_of, per_trainer: int) -> None:
    """Adam in trainers of about ``per_trainer`` rows, averaged after each of ``ROUNDS`` rounds; sets the model's weights."""
    n = rows.count()
    if not n:
        return
    trainers = max(1, -(-n // (per_trainer * ROUNDS)))
    names = [*model.weights[name]]
    context = rows.sparkSession.sparkContext
    for number in range(ROUNDS):
        held = context.broadcast(model)
        learn = _learner(held, name, number)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            counts: dict[int, int] = {}
            for batch in batches:
                for piece, data, n in zip(*(batch.column(c).to_pylist() for c in ("piece", "data", "n")), strict=True):
                    sums[piece] = sums.get(piece, 0) + n * np.frombuffer(data, np.float32).astype(np.float64)
                    counts[piece] = counts.get(piece, 0) + n
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([(v / counts[k]).astype(np.float32).tobytes() for k, v in sums.items()], pa.binary()), pa.array([counts[k] for k in sums], pa.int64())], ["piece", "data", "n"])

        schema = "piece int, data binary, n long"
        dealt = rows.where(round_of == number).withColumn("trainer", F.pmod(place, F.lit(trainers)))
        trained = dealt.groupBy("trainer").applyInArrow(learn, schema).mapInArrow(summed, schema)
        averaged = trained.repartition("piece").mapInArrow(summed, schema).collect()
        held.destroy()
        if averaged:
            flat = np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(averaged)])
            shapes = [model.weights[name][k].shape for k in names]
            ends = np.cumsum([int(np.prod(s)) for s in shapes])
            model.weights[name] = {k: x.reshape(s) for k, s, x in zip(names, shapes, np.split(flat, ends[:-1]), strict=True)}


def language_model_scores(docs: DataFrame, vocabulary: str, training, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score, score; ``training`` is the condition on rows to learn from."""
    spark = docs.sparkSession
    learn = docs.where(training)
    n_texts = learn.count()
    words = saved(count_words(learn, text), "words")
    tokens, kinds = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*")).first())
    tokens, kinds = tokens + n_texts, kinds + (n_texts > 0)
    counts = count_ids(words, vocabulary).toArrow()  # the vocabulary's size at most
    hot = most_frequent(words, "c", HOT_WORDS).toArrow().sort_by("word")
    model = ScoringModel(vocabulary, counts, n_texts, hot).built()
    held = spark.sparkContext.broadcast(model)
    rows = saved(training_rows(learn, text, held), "training", partition_by="round", codec="zstd")
    train(model, "words", rows, F.col("place"), F.col("round"), TRAINER_RUNS)
    train(model, "inner", words, F.shiftright(F.xxhash64("word"), 8), F.pmod(F.xxhash64("word"), F.lit(ROUNDS)), TRAINER_WORDS)
    held.destroy()
    dropped(rows)
    parts, kept_kind = max(1, -(-tokens // PHRASES)), model.tool.kind
    held = spark.sparkContext.broadcast(model)
    del model, hot, counts, rows
    give_back()
    spark.sparkContext._jvm.System.gc()  # so that Spark drops the trainers' shuffle files before the largest shuffle
    end_log = float(np.log10(n_texts + 1.0))

    kind = docs.schema[key].dataType.simpleString()
    own = {"row": "long", "given": kind, "n_tokens": "long", "known": "long", "logs": "double", "rare": "array<binary>", "score": "double"}
    schema = ", ".join(f"{c} {x}" for c, x in own.items())
    packed = [x.split() for x in SPOTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = held.value.built()
        network = model.network("words")
        logs_of = np.append(np.log10(model.hot_counts + 1.0), 0.0)
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, text, 1 << 20):
            texts = _texts(batch, text)
            laid = model.laid(texts, scoring=True)
            opening = network.log_probabilities(model.input[laid["first"]], model.input[laid["last"]], laid["target"], laid["sizes"])
            scores = np.add.reduceat(opening + laid["log"], laid["starts"]) / np.log(10)
            found, bounds = laid["found"], np.concatenate([[0], laid["stops"]])
            logs = np.diff(np.concatenate([[0.0], np.cumsum(logs_of[found])])[bounds])
            known = np.diff(np.concatenate([[0], np.cumsum(found >= 0)])[bounds])
            rare = np.flatnonzero(found < 0)
            offsets = pa.array(np.searchsorted(rare, bounds).astype(np.int32))
            place = np.arange(number, number + len(texts))
            told = [pa.array(place), batch.column(key), pa.array([len(x) + 1 for x in texts], pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(laid["rare"], pa.binary())), pa.array(scores, pa.float64())]
            table = pa.table([pa.array((place % parts).astype(np.int32)), *told], ["part", *own])
            learns = pc.fill_null(batch.column("learn"), False).to_numpy(zero_copy_only=False)
            spots = packed_spots(laid, opening, learns, number, parts, model.tool.kind)
            number += len(texts)
            spots = pa.Table.from_batches([spots]).rename_columns(["part", *(f"spots_{c}" for c, _ in packed)])
            both = pa.concat_tables([table, spots], promote_options="default")
            yield from both.combine_chunks().to_batches()

    def settled(group: pa.Table) -> pa.Table:
        """The texts of a part as they came, and what texts gain from its phrases."""
        texts = group.filter(group.column("row").is_valid()).select([*own])
        spots = group.filter(group.column("row").is_null()).select([f"spots_{c}" for c, _ in packed]).rename_columns([c for c, _ in packed])
        place, gains = phrase_gains(spots, kept_kind) if len(spots) else (np.zeros(0, np.int64), np.zeros(0))
        gained = pa.table({"row": pa.array(place, pa.int64()), "gain": pa.array(gains, pa.float64())})
        whole = pa.concat_tables([texts.append_column("gain", pa.nulls(len(texts), pa.float64())), gained], promote_options="default")
        del group, spots
        give_back()
        return whole

    asked_of = docs.select(key, text, (F.expr(training) if isinstance(training, str) else training).alias("learn"))
    told = asked_of.mapInArrow(run, f"part int, {schema}, " + ", ".join(f"spots_{c} {x}" for c, x in packed))
    every = saved(told.groupBy("part").applyInArrow(settled, f"{schema}, gain double"), "scored", codec="zstd")
    scored = every.where("gain IS NULL").drop("gain").withColumnRenamed("given", key)
    # Rare words are worked out once each.
    asked = scored.select("row", F.explode("rare").alias("word"))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in slices(batches, "word", 1 << 17):
            words = words or Words(held.value.built(), False, hot=False)
            c = pc.fill_null(batch.column("c"), 0)
            logs = words.logs(batch.column("word").to_pylist(), c.to_numpy()) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), c, pa.array(logs, pa.float64())], ["word", "c", "log"])

    distinct = asked.select("word").distinct().join(words.hint("merge"), "word", "left").select("word", "c")
    values = saved(distinct.mapInArrow(valued, "word binary, c long, log double"), "rare-words", codec="zstd")
    rare = asked.join(values.hint("merge"), "word")
    rare = rare.select("row", (F.col("c") > 0).cast("int").alias("more"), F.log10(F.col("c") + 1.0).alias("more_logs"), F.col("log").alias("gain"))
    spots = every.where("gain IS NOT NULL").select("row", F.lit(0).alias("more"), F.lit(0.0).alias("more_logs"), "gain")
    found = rare.union(spots).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "more_logs", "gain")))
    joined = scored.drop("rare").join(found.hint("merge"), "row", "left")
    known = F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(n_texts > 0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end_log)
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1.0)))
    score = F.col("score") + F.coalesce("gain", F.lit(0.0))
    return joined.select(key, "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = language_model_scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ~held_out("doc_id", 7, 2))
    return rows.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
