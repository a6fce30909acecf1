from pyspark.sql import functions as F

from spindrift.llm import common


def test_null_fields_meet_and_the_rows_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, None), (None, "x"), (None, None), (2, "y")], "a long, b string")
    others = spark.createDataFrame([(1, None), (None, None), (None, "x"), (3, "y")], "a long, b string")
    left = rows.select(F.struct("a", "b", F.xxhash64("a").alias("tag")).alias("key"), F.lit("r").alias("row"))
    right = others.select(F.struct("a", "b", F.expr("if(a is null, xxhash64(a), nullif(xxhash64(a), 0))").alias("tag")).alias("key"))
    once = common.meet(left, right, "left_semi").dropDuplicates(["key"])
    assert once.count() == 3
    assert common.meet(left, right.where("false")).count() == 0
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
