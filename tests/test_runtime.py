from pyspark.sql import functions as F

from corvane import runtime


def test_materialized_frames_lie_in_the_shared_folder(spark):
    df = runtime.materialize(spark.range(10).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 10 and runtime.shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    assert runtime.materialize(df.limit(0)).count() == 0
    assert runtime.release(spark) >= 2 and runtime.release(spark) == 0


def test_labels(spark):
    x = spark.createDataFrame([(" Hard-Negative ",), ("hard  negative",), (None,), ("",)], "v string")
    assert [r[0] for r in x.select(runtime.uniform_label(F.col("v"))).collect()] == ["hard_negative", "hard_negative", None, ""]
