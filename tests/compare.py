"""Results of a query against DuckDB's on the same tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if x is None or pd.isna(x):
        return None
    if isinstance(x, (int, float, np.number)):
        return float(x)
    return str(x)


def rows_of(frame):
    return sorted(repr([plain(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def check(query, sql, spark, sf_dir):
    own, theirs = query(spark, sf_dir).toPandas(), oracle(sql, sf_dir)
    assert sorted(own.columns) == sorted(theirs.columns)
    assert rows_of(own) == rows_of(theirs)
