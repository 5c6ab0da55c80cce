import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyforge.queries import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def text(x):
        if hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str(list(x))
        return "" if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(text, row)) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_the_oracle(spark, oracle, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = oracle.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lever", "n", "hits", "hit_rate", "avg_inter"]
