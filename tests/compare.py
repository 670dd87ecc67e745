"""Spark results against DuckDB's, as the driver compares them: columns by name, rows in any order, types and values equal."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(v.tolist() if hasattr(v, "tolist") else v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(plain(v) for v in r) for r in pdf.astype(object).itertuples(index=False, name=None))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(df, con, sql):
    got, rel = df.toArrow().to_pandas(), con.sql(sql)
    assert [(c, KINDS.get(t, t)) for c, t in sorted(df.dtypes)] == sorted(zip(rel.columns, map(str, rel.types), strict=True))
    want = rel.to_arrow_table().to_pandas()
    assert len(got) == len(want)
    assert rows(got) == rows(want)
