"""Runs SQL over the given tables and compares rows without regard to order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(map(plain, value.values())) + "}"
    return str(value)


def same(df, con, sql):
    names = sorted(df.columns)
    found = sorted(tuple(plain(r.asDict(True)[n]) for n in names) for r in df.collect())
    con.execute(sql)
    at = [x[0] for x in con.description]
    assert sorted(at) == names
    wanted = sorted(tuple(plain(r[at.index(n)]) for n in names) for r in con.fetchall())
    assert found == wanted
    return len(found)
