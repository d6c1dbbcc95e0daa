from siftwell.operators.joins import spread


def test_spread_equals_a_join(spark, rows):
    left = spark.createDataFrame([("hub", i) for i in range(500)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hub", "x")] + [(f"k{i}", f"x{i}") for i in range(200)], "k string, w string")
    weights = left.where("k is not null").groupBy("k").count().withColumnRenamed("count", "_n")
    assert rows(spread(left, right, "k", weights, "v"), "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")
