"""What the language model's steps ask for: every word of the windows, every id of the distinct words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest

from quillgraph.llm import lm_scoring


@pytest.fixture(scope="module")
def model():
    counts = pa.table({c: pa.array([], pa.int64()) for c in ("id", "tokens", "kinds", "inside")})
    hot = pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    return lm_scoring.ScoringModel(public_tokenizers.path("byte_bpe_50k.tiktoken"), counts, 0, hot).built()


def _asked(steps) -> Counter:
    next(steps)
    found: Counter = Counter()
    for _, _, _, target, real in steps:
        found.update(target[real].tolist())
    return found


def test_the_loss_takes_every_word_of_a_window(model):
    rows = [np.arange(n, dtype=model.tool.kind).repeat(2).tobytes() for n in (130, 20, 2, 17)]
    group = pa.table({"ids": pa.array(rows, pa.binary())})
    wanted = Counter(i for n in (130, 20, 2, 17) for i in range(1, n))
    assert _asked(lm_scoring._window_steps(model, group, np.random.default_rng(0))) == wanted


def test_the_loss_takes_every_id_of_a_word(model):
    words = [b"a", b"unimaginably", b"x9q" * 20, "日本語".encode(), b"zq" * 60]
    ids, sizes = model.tool.ids(words)
    wanted = Counter(model.inner_steps(ids, sizes)[2].tolist())
    group = pa.table({"word": pa.array(words, pa.binary())})
    assert _asked(lm_scoring._word_steps(model, group, np.random.default_rng(0))) == wanted


def test_a_full_encoder_keeps_the_pieces_it_meets_often():
    import public_tokenizers

    from quillgraph.llm import token_archive

    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = token_archive.Encoder(path, 40), token_archive.Encoder(path, 1 << 20)
    asked = []
    learn = small._learn
    small._learn = lambda keys: (asked.extend(keys), learn(keys))
    texts = [f"often met words stay in, rare{i} once{i} gone{i}!" for i in range(60)]
    for text in texts:
        (ids,), (expected,) = small.encode([text]), large.encode([text])
        assert ids.tolist() == expected.tolist() == small.library.encode(text, add_special_tokens=False).ids
    assert asked.count("met") == 1 and len(small.known) <= 45


def test_every_phrase_is_counted_and_what_texts_gain_is_that_of_brute_force(model):
    texts = [b"a b c d e f", b"a b c d x", b"", b"a b c", b"b c d x b c d x", b"q a b c d"]
    learns = np.asarray([True, True, True, True, False, False])
    words = [x.split() for x in texts]
    laid = model.laid(words, scoring=False)
    places = np.concatenate([np.arange(n) for n in laid["sizes"]])
    assert ((laid["phrase"] != 0) == (places >= 3)).all()
    opening = np.log(np.random.default_rng(0).uniform(0.01, 0.9, len(places)))
    spots = [pa.Table.from_batches([lm_scoring.packed_spots(laid, opening, learns, 100, parts, model.tool.kind)]) for parts in (1, 3)]
    counts: dict = {}
    for i, n in enumerate(laid["sizes"].tolist()):
        for k in range(3, n) if learns[i] else ():
            counts.setdefault(tuple(words[i][k - 3 : k]), Counter())[int(laid["target"][laid["starts"][i] + k])] += 1
    wanted = np.zeros(len(texts))
    for i, n in enumerate(laid["sizes"].tolist()):
        for k in range(3, n):
            at = laid["starts"][i] + k
            if seen := counts.get(tuple(words[i][k - 3 : k])):
                part = max(seen[int(laid["target"][at])] - lm_scoring.DISCOUNT, 0) / seen.total()
                wanted[i] += np.log10(part / np.exp(opening[at]) + lm_scoring.DISCOUNT * len(seen) / seen.total())
    for table in spots:
        found = np.zeros(len(texts))
        for part in set(table.column("part").to_pylist()):
            at, gains = lm_scoring.phrase_gains(table.filter(pa.compute.equal(table.column("part"), part)), model.tool.kind)
            found[at - 100] += gains
        assert np.allclose(found, wanted, atol=1e-5)
