"""Each research query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidemark import queries

TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or not str(df[c].dtype).startswith(("float", "int", "bool", "Int")):
            df[c] = df[c].astype(str).str[:19].replace({"None": "-", "nan": "-", "NaT": "-", "<NA>": "-"})
        else:
            df[c] = df[c].astype(float).round(4) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    mine, theirs = rows(queries.QUERIES[name](spark, sf).toPandas()), rows(con.sql(queries.ORACLE_SQL[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert len(mine) == len(theirs)
    for c in mine.columns:
        if mine[c].dtype == float:
            apart = ~((abs(mine[c] - theirs[c]) <= 2e-4 * (1 + abs(theirs[c]))) | (mine[c].isna() & theirs[c].isna()))
        else:
            apart = mine[c] != theirs[c]
        assert apart.sum() == 0, (c, mine[apart].head(), theirs[apart].head())
