"""Run queries in Spark and DuckDB over the same Parquet files and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when columns and all rows agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(spark_df.columns) != sorted(names):
        return f"columns differ: spark {sorted(spark_df.columns)} duckdb {sorted(names)}"
    hugeint = [n for n, t in types.items() if t in ("HUGEINT",) or t.startswith("DECIMAL")]
    if hugeint:
        return f"duckdb types to cast: {[(n, types[n]) for n in hugeint]}"
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = _rows(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"row counts differ: spark {len(ours)} duckdb {len(theirs)}\n{ours[:3]}\n{theirs[:3]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ; columns {sorted(names)}; first spark {bad[0][0]} duckdb {bad[0][1]}"
    return None
