import random
import statistics

from pyspark.sql import functions as F

from quibble.catalog.fixtures import fixture
from quibble.operators.clean import clean_meta, clean_reviews
from quibble.operators.complaints import COMPLAINT_COLUMNS, category_medians, score_complaints, strong_complaints
from quibble.operators.enrich import enrich_reviews, hot_keys, product_health_daily
from quibble.plans import pipeline

SF = "/root/testdata/sf0.001"


def test_median_is_exact(spark):
    random.seed(3)
    rows = [(c, random.randint(31, 400)) for c in ("electronics", "home_kitchen") for _ in range(random.choice([101, 102]))]
    rows += [("electronics", 77)] * 90
    got = {r.category: r.median_review_length for r in category_medians(spark.createDataFrame(rows, "category string, review_length int")).collect()}
    for c in got:
        assert got[c] == statistics.median(n for k, n in rows if k == c)


def test_signals_and_cut(spark):
    rows = [(2.0, 1, 5, 100), (2.5, 1, 5, 100), (2.0, None, None, 10), (1.0, 0, 1, 100), (3.0, 0, 0, 99)]
    df = spark.createDataFrame(
        [(i, "electronics", *r) for i, r in enumerate(rows)],
        "i int, category string, overall double, verified_flag int, vote_count bigint, review_length int",
    )
    medians = spark.createDataFrame([("electronics", 99.5)], "category string, median_review_length double")
    scored = score_complaints(df, medians)
    got = [r.signal_score for r in scored.orderBy("i").collect()]
    assert got == [4, 3, 1, 3, 0]
    assert sorted(r.i for r in strong_complaints(scored).collect()) == [0, 1, 3]


def layers(spark):
    reviews = clean_reviews(fixture(spark, SF, "reviews_raw"))
    meta = clean_meta(fixture(spark, SF, "meta_raw"))
    return reviews, meta


def test_pipeline_properties(spark):
    reviews, meta = layers(spark)
    confident = pipeline.confident_complaints(reviews, meta)
    complaints = pipeline.complaint_layer(reviews, meta)
    assert complaints.columns == COMPLAINT_COLUMNS + [pipeline.ROW_KEY]
    docs = pipeline.document_layer(complaints).collect()
    assert 0 < len(docs) == complaints.count() < confident.count()
    assert sorted(d.doc_id for d in docs) == list(range(1, len(docs) + 1))
    in_order = sorted(docs, key=lambda d: d.doc_id)
    assert in_order == sorted(docs, key=lambda d: (d.review_date, d.asin, d.reviewer_id))
    assert all(3 <= d.signal_score <= 4 for d in docs)
    d = docs[0]
    assert d.retrieval_text.startswith(f"Product: {d.title or ''} Brand: {d.brand or ''} Category: {d.category} Complaint Type:")
    agree = confident.filter("operational_complaint_flag = 0").count()
    assert agree == 0


def test_health_counts_every_review_once(spark):
    reviews, meta = layers(spark)
    health = product_health_daily(reviews, meta)
    total = health.agg(F.sum("review_count").alias("n"), F.min("negative_rate"), F.max("positive_rate")).first()
    assert total.n == reviews.count()
    assert total[1] >= 0 and total[2] <= 1
    # The same as grouping the joined reviews.
    keys = ["review_date", "week_bucket", "month_bucket", "category", "brand", "asin", "complaint_type_candidate"]
    joined = enrich_reviews(reviews, meta).groupBy(*keys).agg(F.count(F.lit(1)).alias("review_count"))
    assert joined.exceptAll(health.select(*keys, "review_count")).isEmpty()
    assert health.count() == joined.count()


def test_salted_join_equals_plain_join(spark):
    # One product and one group of full copies hold most rows.
    reviews, meta = layers(spark)
    one = reviews.limit(1).collect()
    copies = spark.createDataFrame(one * 700, reviews.schema)
    skewed = reviews.unionByName(copies)
    hot = hot_keys(skewed, "asin", rows_per_task=300)
    assert [r.asin for r in hot.collect()] == [one[0].asin]
    plain, salted = enrich_reviews(skewed, meta), enrich_reviews(skewed, meta, hot)
    assert plain.columns == salted.columns
    assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()


def test_salting_spreads_a_hot_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
        right = spark.range(9000).select(F.col("id").alias("k"), F.col("id").alias("v"))
        hot = hot_keys(left, "k", rows_per_task=95)
        from quibble.operators.enrich import salted_left_join

        joined = salted_left_join(left, right, "k", hot)
        assert joined.count() == 9000 and joined.filter("v IS NULL OR v <> k").isEmpty()
        parts = joined.filter("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_two_hundred_hot_keys_are_all_split(spark):
    from quibble.operators.enrich import salted_left_join

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        left = spark.range(40_000).select((F.col("id") % 200).alias("k"), "id")
        right = spark.range(200).select(F.col("id").alias("k"), F.col("id").alias("v"))
        hot = hot_keys(left, "k", rows_per_task=20)
        assert hot.count() == 200 and {r.salts for r in hot.collect()} == {10}
        joined = salted_left_join(left, right, "k", hot)
        assert joined.count() == 40_000 and joined.filter("v IS NULL OR v <> k").isEmpty()
        largest = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert largest < 200  # a key has 200 rows, a task no more than a few of its twentieths
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_keys_with_empty_and_keyless_inputs(spark):
    keys = spark.range(0, 1000, 1, 3).select(F.when(F.col("id") % 2 == 0, F.lit("h")).otherwise(F.col("id").cast("string")).alias("k"))
    assert [tuple(r) for r in hot_keys(keys, "k", 100).collect()] == [("h", 5)]
    assert hot_keys(keys.filter("k = 'none'"), "k").count() == 0
    assert hot_keys(keys.select(F.lit(None).cast("string").alias("k")), "k", 1).count() == 0
