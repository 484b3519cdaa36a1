"""Every registered query of the core against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quillgraph import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def cell(v):
        return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", [*queries.queries()])
def test_query_matches_sql(spark, db, name):
    got = queries.queries()[name](spark, SF).toPandas()
    expected = db.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
    assert len(got)
