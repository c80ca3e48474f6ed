"""Compares a DataFrame with DuckDB SQL over the same tables."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def rows_in_duckdb(sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        at = [names.index(n) for n in sorted(names)]
        return sorted(names), sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)
