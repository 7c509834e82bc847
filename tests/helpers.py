"""Frames from arrays, and DuckDB's answer to an oracle."""

from __future__ import annotations

import os

import numpy as np

SCHEMA = "party int, row_id long, features array<double>, label int"
DATA_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark, parties, labels=None):
    rows, k = [], 0
    for p, x in enumerate(parties):
        for i, row in enumerate(np.asarray(x)):
            rows.append((p, k, [float(v) for v in row], int(labels[p][i]) if labels is not None else p))
            k += 1
    return spark.createDataFrame(rows, SCHEMA)


def norm(rows):
    return sorted(tuple("null" if v is None else repr(float(f"{v:.9g}") + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


def duck(sql, folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def agrees(df, sql, folder):
    """Same columns, and the same rows in any order."""
    names, want = duck(sql, folder)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    got = norm(tuple(r[c] for c in cols) for r in df.collect())
    return got == norm(tuple(r[names.index(c)] for c in cols) for r in want)
