import pytest

import __spark_entry__ as entry
from lectern.plans import catalog
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_oracle(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "score", "rank"] and df.count() == 10


def test_registry_holds_the_catalog():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.operators import search

    spark.range(100).select(F.col("id"), F.lit("d1").alias("domain"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "p"))
    best = search.top_k(spark.read.parquet(str(tmp_path / "p")), [1.0, 0.0], 3, {"domain": "d1"}).select("id", "score")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(domain,d1)" in plan and "TakeOrderedAndProject" in plan and "unused" not in plan.split("ReadSchema")[1]
