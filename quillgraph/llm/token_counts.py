"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers give the number of byte-level BPE tokens of a text.

* The *word transducer* walks over characters. Its input symbol is a character's
  class, its output says whether a new word (pre-token) begins. It has eight
  states, so the action of a chunk of text is a map of eight states to eight
  states. Chunks are walked side by side from every state; the maps are composed
  by a parallel prefix scan, which gives each chunk its true start state.
* The *token transducer* walks over the bytes of a word. A transition carries the
  change in the number of tokens. Its state holds, for every position from which
  the bytes read so far still begin some vocabulary entry, the last token before
  that position and the relative token count there. The state after a byte
  follows from the vocabulary alone: an encoding is right exactly if each pair of
  neighbouring tokens stays apart when encoded on its own. States are compiled
  when first reached and kept for the life of the Python worker, up to
  ``MAX_STATES``; then compiling starts over, so memory stays bounded.

Null and empty texts have 0 tokens. Repeated rows each give a row. Columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import kept_in_worker, slices, table, texts_of

#: Compiled states kept by a worker (about 1 KB each); a slice may add to them before they go.
MAX_STATES = 3 << 16
#: Rows by which the transition tables grow, and the byte values they begin with.
ROWS, COLUMNS = 1 << 14, 128
#: Characters of a chunk whose state map is computed.
CHUNK = 128
#: Bytes of a word up to which words are walked side by side.
WIDE = 40

# States and input symbols of the word transducer.
START, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_SPACE, IN_SPACES, SHORT_1, SHORT_2 = range(8)
LETTER, DIGIT, OTHER, QUOTE_1, QUOTE_2, SPACE_LAST, WHITE_LAST, WHITE_MORE, RESET = range(9)
N_STATES, N_SYMBOLS = 8, 9


def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a word begins" for each (symbol, state).

    SPACE_LAST and WHITE_LAST are white space right before something else: they
    begin a word even inside a run of white space. QUOTE_1 and QUOTE_2 are
    apostrophes followed by a one- or two-letter ending, which binds only where
    the apostrophe itself begins a word.
    """
    nxt = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    begins = np.ones((N_SYMBOLS, N_STATES), np.uint8)
    for symbol, inside in ((LETTER, IN_LETTERS), (DIGIT, IN_DIGITS), (OTHER, IN_OTHER)):
        nxt[symbol] = inside
        begins[symbol, [inside, AFTER_SPACE]] = 0
    nxt[LETTER, [SHORT_1, SHORT_2]] = START, SHORT_1
    begins[LETTER, [SHORT_1, SHORT_2]] = 0
    for symbol, short in ((QUOTE_1, SHORT_1), (QUOTE_2, SHORT_2)):
        nxt[symbol] = short
        nxt[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[symbol, [IN_OTHER, AFTER_SPACE]] = 0
    nxt[SPACE_LAST] = AFTER_SPACE
    nxt[WHITE_LAST] = nxt[WHITE_MORE] = IN_SPACES
    begins[WHITE_MORE, IN_SPACES] = 0
    nxt[RESET], begins[RESET] = START, 0
    return nxt, begins


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts the tokens of texts as the library does for the same file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self._character_classes(Tokenizer.from_file(path))
        self._vocabulary(spec["model"])
        self.word_next, self.word_begins = (x.ravel() for x in _word_tables())
        self._forget()

    # -- compiling ---------------------------------------------------------

    def _character_classes(self, library) -> None:
        """The class of every code point, read off the library's own word splitter.

        In ``x<c>1`` a letter stays with ``x`` and a digit with ``1``; other characters stick
        to a full stop, white space doesn't. Planes without characters are left out.
        """
        split = library.pre_tokenizer.pre_tokenize_str
        kinds = np.full(0x110000, OTHER, np.uint8)
        points = np.asarray([c for c in (*range(0x40000), *range(0xE0000, 0xF0000)) if not 0xD800 <= c < 0xE000])
        for at in range(0, len(points), 1 << 16):
            part = points[at : at + (1 << 16)]
            begins = np.zeros(4 * len(part) + 1, bool)
            begins[[s for _, (s, _) in split("".join(f"x{chr(c)}1~" for c in part))]] = True
            kinds[part[~begins[1:-1:4]]] = LETTER
            kinds[part[~begins[2:-1:4]]] = DIGIT
        kinds[0x20] = WHITE_MORE
        for c in points[kinds[points] == OTHER]:
            if unicodedata.category(chr(c))[0] in "ZC" and len(split(f".{chr(c)}.")) > 1:
                kinds[c] = WHITE_MORE
        self.kinds = kinds

    def _vocabulary(self, model: dict) -> None:
        alphabet = _byte_alphabet()
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge_rank = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.halves = {ids[a + b]: (ids[a], ids[b], rank) for rank, (a, b) in reversed([*enumerate(merges)])}
        # The trie of all entries: child of (node, byte), and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ending: list[int] = [-1]
        for token, i in ids.items():
            if any(ch not in alphabet for ch in token) or (i not in self.halves and len(token) > 1):
                continue
            node = 0
            for ch in token:
                node = self.child.setdefault(node << 8 | alphabet[ch], len(self.ending))
                if node == len(self.ending):
                    self.ending.append(-1)
            self.ending[node] = i
        self.apart_cache: dict[tuple[int, int], bool] = {}

    def _apart(self, left: int, right: int) -> bool:
        """Whether both tokens, side by side, are how BPE encodes their bytes.

        Undo merges from the latest on the two sides; a merge over the seam breaks the
        pair if BPE would have reached it before the merges undone so far.
        """
        key = (left, right)
        known = self.apart_cache.get(key)
        if known is None:
            known = True
            never = 1 << 60
            due = (never, 1)  # of the merges undone so far, the earliest; 1 if on the right of the seam
            while known:
                seam = self.merge_rank.get((left, right))
                if seam is not None and (seam, 0.5) < due:
                    known = False
                    break
                a, b = self.halves.get(left), self.halves.get(right)
                if a is None and b is None:
                    break
                if b is None or (a is not None and a[2] > b[2]):
                    left, due = a[1], min(due, (a[2], 0))
                else:
                    right, due = b[0], min(due, (b[2], 1))
            if len(self.apart_cache) > 1 << 20:
                self.apart_cache.clear()
            self.apart_cache[key] = known
        return known

    def _forget(self) -> None:
        """Back to the start state alone: no token yet, one open position.

        A state is the flat tuple (last token, relative count, trie node) per open position.
        Table columns are given to byte values as they turn up.
        """
        self.column = np.full(256, -1, np.int16)
        self.columns = 0
        self.next = np.full((ROWS, COLUMNS), -1, np.int32)
        self.gain = np.zeros((ROWS, COLUMNS), np.int8)
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._state((-1, 0, 0))

    def _state(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            if at >= len(self.next):
                self._widen(ROWS, 0)
        return at

    def _widen(self, rows: int, columns: int) -> None:
        self.next = np.pad(self.next, ((0, rows), (0, columns)), constant_values=-1)
        self.gain = np.pad(self.gain, ((0, rows), (0, columns)))

    def _columns_of(self, data: np.ndarray) -> np.ndarray:
        for byte in np.flatnonzero(np.bincount(data, minlength=256) * (self.column < 0)):
            self.column[byte] = self.columns
            self.columns += 1
        if self.columns > self.next.shape[1]:
            self._widen(0, 256 - self.next.shape[1])
        return self.column[data]

    def _compile(self, at: int, byte: int) -> int:
        state, kept, last, count = self.states[at], [], None, 0
        for i in range(0, len(state), 3):
            child = self.child.get(state[i + 2] << 8 | byte)
            if child is None:
                continue
            token = self.ending[child]
            if token >= 0 and last is None and (state[i] < 0 or self._apart(state[i], token)):
                last, count = token, state[i + 1] + 1
            kept.append((state[i], state[i + 1], child))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        to = self._state((*(y for before, so_far, node in kept for y in (before, so_far - count, node)), last, 0, 0))
        self.next[at, self.column[byte]] = to
        self.gain[at, self.column[byte]] = count
        return to

    # -- running -----------------------------------------------------------

    def word_starts(self, symbols: np.ndarray) -> np.ndarray:
        """True where a word begins, by composing the state maps of chunks."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, RESET, np.uint8)
        grid[:n] = symbols
        columns = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T) * np.uint8(N_STATES)
        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (chunks, 1))
        for column in columns:
            maps = self.word_next.take(column[:, None] + maps)
        step = 1
        while step < chunks:  # parallel prefix scan: maps[k] becomes the action of chunks 0..k
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
        out = np.empty((CHUNK, chunks), np.uint8)
        for column, row in zip(columns, out, strict=True):
            at = column + state
            self.word_begins.take(at, out=row)
            state = self.word_next.take(at)
        return out.T.ravel()[:n].astype(bool)

    def word_tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start:end]``."""
        if len(self.states) > MAX_STATES:
            self._forget()
        columns = self._columns_of(data)
        width = self.next.shape[1]
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        first, size = starts[order], sizes[order]
        state = np.zeros(len(order), np.int64)
        count = np.zeros(len(order), np.int64)
        for k in range(min(WIDE, int(size[0]) if len(size) else 0)):
            live = int(np.searchsorted(-size, -k, side="left"))
            place = first[:live] + k
            at = state[:live] * width + columns[place]
            to = self.next.ravel().take(at)
            missing = np.flatnonzero(to < 0)
            if len(missing):
                _, one = np.unique(at[missing], return_index=True)
                for s, byte in zip(state[missing[one]].tolist(), data[place[missing[one]]].tolist(), strict=True):
                    self._compile(s, byte)
                to = self.next.ravel().take(at)
            count[:live] += self.gain.ravel().take(at)
            state[:live] = to
        for i in range(int(np.searchsorted(-size, -WIDE, side="left"))):  # the few very long words
            s, total, column = int(state[i]), 0, self.column
            for byte in data[first[i] + WIDE : first[i] + size[i]].tolist():
                to = int(self.next[s, column[byte]])
                if to < 0:
                    to = self._compile(s, byte)
                total += int(self.gain[s, column[byte]])
                s = to
            count[i] += total
        tokens = np.empty_like(count)
        tokens[order] = count
        return tokens

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        owner, parts = np.arange(len(texts)), texts
        if any(s in x for s in self.specials for x in texts):
            cut: list[tuple[int, str]] = []
            for i, x in enumerate(texts):
                pieces = [x]
                for s in self.specials:
                    pieces = [y for p in pieces for y in p.split(s)]
                total[i] += len(pieces) - 1
                cut += [(i, p) for p in pieces]
            owner, parts = np.asarray([i for i, _ in cut]), [p for _, p in cut]
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1  # the separators
        symbols = self.kinds[points]
        white = symbols == WHITE_MORE
        white[stops] = True
        last = white.copy()
        last[:-1] &= ~white[1:]
        last[-1] = False
        symbols[last] = WHITE_LAST
        symbols[last & (points == 0x20)] = SPACE_LAST
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):
            padded = np.concatenate([points, [0, 0]])
            one, two = padded[quotes + 1], padded[quotes + 2]
            symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_1
            for a, b in ("re", "ve", "ll"):
                symbols[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE_2
        symbols[stops] = RESET
        begins = self.word_starts(symbols)
        begins[stops] = True  # a separator ends the word before it; it is no word itself
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(width) - width
        at = np.flatnonzero(begins)
        starts = offset[at]
        ends = np.append(starts[1:], len(data))
        word = symbols[at] != RESET
        tokens = np.zeros(len(at), np.int64)
        tokens[word] = self.word_tokens(data, starts[word], ends[word])
        sums = np.cumsum(tokens)[~word]  # up to each separator
        np.add.at(total, owner, np.diff(sums, prepend=0))
        return total


def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary file."""
    return kept_in_worker(f"counter {path}", lambda: TokenCounter(path))


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """Per row: key, n_bytes, n_tokens and whether the text has over ``limit`` tokens.

    ``vocabulary`` is the path of a byte-level BPE file that all executors have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for batch in slices(batches, text):
            texts = texts_of(batch, text)
            n = tool.count(texts)
            n_bytes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
