"""Compare a query with its SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
        return "null"
    if isinstance(value, (bool,)) or str(type(value)).endswith("bool'>"):
        return str(bool(value))
    if isinstance(value, float) or hasattr(value, "dtype") and value.dtype.kind == "f":
        return f"{float(value):.9g}"
    return str(value).removesuffix(" 00:00:00")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    out = []
    for r in frame.itertuples(index=False):
        out.append("|".join(f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else text(v) for v in r))
    return sorted(out)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
