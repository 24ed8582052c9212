import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import hot


def table(spark):
    rng = random.Random(3)
    rows = [("big", rng.choice([None, *range(500)]), f"i{k}") for k in range(3000)] + [(None, k % 7, f"n{k}") for k in range(900)] + [(f"g{k % 40}", k, f"s{k}") for k in range(200)]
    return spark.createDataFrame(rows, "g string, t long, id string")


def test_places_are_those_of_a_plain_window(spark):
    df = table(spark)
    order = [F.col("t"), F.col("id")]
    want = {tuple(r) for r in df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
    assert {tuple(r) for r in hot.ranked(df, "g", "t", order, hot_rows=500).collect()} == want
    assert {tuple(r) for r in hot.ranked(df, "g", "t", order).collect()} == want
    assert hot.ranked(df.limit(0), "g", "t", order, hot_rows=5).count() == 0


def test_windows_over_blocks_see_the_rows_before(spark):
    placed = hot.ranked(table(spark), "g", "t", [F.col("t"), F.col("id")])
    want = {tuple(r) for r in placed.withColumn("before", F.lag("id", 3).over(Window.partitionBy("g").orderBy("place"))).collect()}
    blocks = hot.neighbourly(placed, "place", 3, rows=50)
    got = blocks.withColumn("before", F.lag("id", 3).over(Window.partitionBy("g", "_block").orderBy("place"))).where("_guest = 0").drop("_block", "_guest")
    assert {tuple(r) for r in got.collect()} == want
