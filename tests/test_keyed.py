import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlens.operators import keyed as K


def rows(spark, n=400):
    """Half of all rows share one key; values are often missing."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", i, rng.choice([None, i])) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, i int, v int").repartition(5)


def same(left, right):
    return sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def test_previous_row_equals_a_plain_window(spark):
    df = rows(spark)
    order = Window.partitionBy("k").orderBy("i")
    plain = df.select("k", "i", F.lag("i").over(order).alias("p"))
    for block in (1, 7, 1000):
        split = K.previous_row(df, ["k"], [F.col("i")], F.floor(F.col("i") / block), ["i"], "old")
        assert same(split.select("k", "i", F.col("old.i").alias("p")), plain)


def test_fill_forward_equals_a_plain_window(spark):
    df = rows(spark)
    order = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", "i", F.last("v", ignorenulls=True).over(order).alias("v"))
    for block in (1, 7, 1000):
        split = K.fill_forward(df, ["k"], [F.col("i")], F.floor(F.col("i") / block), ["v"])
        assert same(split.select("k", "i", "v"), plain)


def test_running_position_equals_a_plain_window(spark):
    df = rows(spark)
    plain = df.select("k", "i", F.row_number().over(Window.partitionBy("k").orderBy("i")).cast("bigint").alias("n"))
    split = K.running_position(df, ["k"], [F.col("i")], F.floor(F.col("i") / 16), "n")
    assert same(split.select("k", "i", F.col("n").cast("bigint")), plain)


def test_keep_first_and_last(spark):
    df = rows(spark)
    firsts = {r["k"]: r["i"] for r in K.keep_first(df, ["k"], [F.col("i")]).collect()}
    lasts = {r["k"]: r["i"] for r in K.keep_last(df, ["k"], [F.col("i")]).collect()}
    assert firsts == {r[0]: r[1] for r in df.groupBy("k").agg(F.min("i")).collect()}
    assert lasts == {r[0]: r[1] for r in df.groupBy("k").agg(F.max("i")).collect()}


def test_top_k(spark):
    df = rows(spark)
    kept = K.top_k(df, ["k"], [F.col("i").desc()], 2, "rank")
    assert kept.filter("k = 'hot'").count() == 2
    assert {r["rank"] for r in kept.collect()} <= {1, 2}
