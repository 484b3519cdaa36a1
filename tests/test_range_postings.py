"""A range's postings are made of its documents' counts, without a row for each posting."""

from __future__ import annotations

import pyarrow as pa
import pytest

from quillgraph.operators import text_index


def test_postings_of_a_range():
    texts = {7: {"b": 2, "a": 1}, 3: {}, 9: {"b": 1}, **{100 + i: {"c": 1 + i % 5} for i in range(150)}}
    rows = [{"no": n, "size": sum(t.values()), "terms": [*t], "tfs": [*t.values()]} for n, t in texts.items()]
    schema = pa.schema([("no", pa.int64()), ("size", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
    found = text_index.range_postings(pa.Table.from_pylist(rows, schema), 4, 2.5, 1.2, 0.75).to_pylist()
    number = {n: i for i, n in enumerate(sorted(texts))}
    assert [r["term"] for r in found] == ["a", "b", "c"] and {r["range"] for r in found} == {4}
    for r in found:
        wanted = {number[n]: t[r["term"]] * 2.2 / (t[r["term"]] + 1.2 * (0.25 + 0.75 * sum(t.values()) / 2.5)) for n, t in texts.items() if r["term"] in t}
        assert r["docs"] == sorted(wanted)
        assert r["impacts"] == pytest.approx([wanted[d] for d in r["docs"]])
        assert r["most"] == [max(r["impacts"][i : i + text_index.BLOCK]) for i in range(0, len(r["docs"]), text_index.BLOCK)]
        assert r["tops"] == sorted(r["impacts"], reverse=True)[: text_index.TOPS]
    assert text_index.range_postings(pa.Table.from_pylist(rows[1:2], schema), 0, 0.0001, 1.2, 0.75).num_rows == 0
