"""Every registered query of the library against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from codestrata import plans

SF = "/root/testdata/sf0.001"


def rows(df):
    c = sorted(df.columns)
    return sorted(map(str, df[c].astype(object).where(df[c].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", list(plans.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_registrations_use_every_core(spark):
    assert plans.QUERIES["source_registrations"](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
