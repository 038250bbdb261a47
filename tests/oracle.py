"""Rows of a query and of its SQL in DuckDB over the same Parquet files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((x is None, str(type(x)) if x is None else "", repr(x)) for x in row))


def _value(v):
    return v + 0.0 if isinstance(v, float) else v


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = _sorted(tuple(_value(r[c]) for c in cols) for r in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    expected = _sorted(tuple(_value(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert len(got) == len(expected)
    assert got == expected
