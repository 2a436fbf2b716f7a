import pytest
from pyspark.sql import functions as F

from gleaner.operators.lookup import join_counted


@pytest.mark.parametrize("most", [100, 7, 1])
def test_keys_are_found_whether_broadcast_or_not(spark, most):
    left = spark.range(500).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('k', cast(sqrt(id) AS int)) END AS key")
    counted = spark.range(20).selectExpr("concat('k', id) AS key", "id % 4 AS often", "array(id, id) AS scores")
    got = join_counted(left, counted, 20, "key", "often", most)
    want = left.join(counted, "key", "left")
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_only_rows_of_rare_keys_are_shuffled(spark):
    left = spark.range(1_000).select(F.concat(F.lit("k"), F.when(F.col("id") < 990, 0).otherwise(F.col("id"))).alias("key"))
    counted = spark.createDataFrame([("k0", 990), ("k995", 1), ("k996", 1)], "key string, often long")
    out = join_counted(left, counted, 3, "key", "often", 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and out.where("often is not null").count() == 992 and out.count() == 1_000
