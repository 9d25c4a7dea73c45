import random

from pyspark.sql import functions as F

from quibble.operators.latest import latest_per_key
from quibble.operators.numbering import number_rows
from quibble.sources.staging import stage


def test_numbers_follow_the_order_with_nulls_last(spark):
    random.seed(1)
    values = [random.choice([None, *range(20)]) for _ in range(2000)]
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    got = number_rows(df, [F.col("v").asc_nulls_last(), F.col("i")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 2001))
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r.i for r in got] == [r[0] for r in want]


def test_copies_are_numbered_and_spread_over_partitions(spark):
    df = spark.range(6000).select((F.col("id") % 3 == 0).alias("hot"), F.col("id")).select(
        F.when(F.col("hot"), F.lit(1)).otherwise(F.col("id")).alias("k")
    )
    keyed = stage(df.repartition(3), "copies", "row_key")
    assert keyed.select("row_key").distinct().count() == 6000
    numbered = number_rows(keyed, [F.col("k"), F.col("row_key")], "n")
    assert numbered.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (6000, 1, 6000)
    placed = stage(
        keyed.repartitionByRange(4, "k", "row_key").withColumn("p", F.spark_partition_id()), "placed"
    )
    assert placed.filter("k = 1").select("p").distinct().count() > 1


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int")
    assert number_rows(df, [F.col("k")], "n").count() == 0


def test_latest_per_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "n"), ("b", 1, "m"), (None, 1, "q")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = {(r.k, r.v) for r in latest_per_key(df, ["k"], [F.col("t").desc_nulls_first()]).collect()}
    assert got == {("a", "y"), ("b", "n"), (None, "q")}
    plan = latest_per_key(df, ["k"], [F.col("t").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_latest_ties_are_decided_by_content(spark):
    rows = [("a", 1, str(i)) for i in range(50)]
    runs = {
        latest_per_key(spark.createDataFrame(random.sample(rows, 50), "k string, t int, v string"), ["k"], [F.col("t")]).first().v
        for _ in range(3)
    }
    assert len(runs) == 1
