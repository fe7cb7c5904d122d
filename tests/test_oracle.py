"""Spark queries vs their DuckDB oracle on the smallest tables (a subset of the driver's gate)."""
import hashlib

import duckdb
import pandas as pd
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E

KEYS = ["N1_split_lines", "M1_shannon_entropy", "X7_first_per_line_rule", "P5_prefix_dedup", "D4_decode_chain",
        "R2_split_assignments", "C10_rank_findings", "E3_file_report", "S5_filter_binary_ext"]
TABLES = "orders documents pages conversations".split()


def digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(repr(None if pd.isna(v) else (round(v, 6) if isinstance(v, float) else v))
                           for v in (r[c] for c in cols)) for r in df.to_dict("records"))
    return cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    s = E.queries()[key](spark, SF_SMALL).toPandas()
    d = con.sql(E.oracle_sql()[key]).df()
    assert len(s) == len(d)
    assert digest(s) == digest(d)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["doc_id", "file", "line"]
