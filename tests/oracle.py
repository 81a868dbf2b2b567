"""Compare a Spark result with DuckDB's, whatever the order of rows and columns."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def _cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, list):
        return tuple(map(_cell, x))
    return None if x is pd.NaT or x is pd.NA else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(_cell, r)) for r in frame.itertuples(index=False)), key=repr)
