"""The numbered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from floorlake.llm import queries

DATA = "/root/testdata/sf0.001"
NAMES = ["op1_html", "op2_mixing", "op3_decontamination", "op4_quality", "op5_warc", "op6_sharding", "op7_chat", "op8_suffix", "op9_minhash", "op10_toxicity", "op11_repair", "op12_licenses", "op13_alignment"]


def normal(df):
    one = lambda v: None if v is None or v is pd.NA or v != v else (v if isinstance(v, str) else round(float(v), 6))
    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def test_every_operator_has_a_query():
    assert list(queries.QUERIES) == NAMES and set(queries.ORACLE_SQL) <= set(NAMES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
