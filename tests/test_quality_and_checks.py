import pytest
from pyspark.sql import functions as F

from quibble.operators import checks, dashboard, quality


def test_rules_and_gate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "z"), (None, "a")], "k int, v string")
    out = quality.check_table(df, "t", ["k", "v"], ["k", "v"], {"v": ["a", "b"]})
    got = {(r.rule, r.column_name): r.failures for r in out.collect()}
    assert got == {("not_null", "k"): 2, ("not_null", "v"): 1, ("unique", "k"): 1, ("unique", "v"): 1, ("accepted_values", "v"): 1}
    with pytest.raises(quality.QualityError, match="t.k not_null: 2"):
        quality.require_quality(out)
    quality.require_quality(out.filter("failures = 0"))


def test_rule_counts():
    assert sum(map(len, quality.NOT_NULL.values())) == 37
    assert sum(map(len, quality.UNIQUE.values())) == 2


def test_join_coverage_counts_joined_rows(spark):
    r = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "asin string")
    m = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("x",), (None,)], "asin string")
    assert checks.join_coverage(r, m).first()[:] == (2 * 3 + 1 + 1 + 1, 3, 2, 2)
    assert checks.join_coverage(r, m, True).first()[:] == (5, 3, 2, 2)


def test_small_checks(spark):
    raw = spark.createDataFrame([(None, "f1"), ("x" * 30, "f1"), ("x" * 31, "f2")], "reviewText string, source_file string")
    assert checks.length_profile(raw).first()[:] == (1, 1, 3)
    assert [r[:] for r in checks.oversized_sources(raw, 1).collect()] == [("f1", 2)]
    rates = spark.createDataFrame([(0.0, 1.0), (1.5, 0.0), (0.5, -0.1)], "positive_rate double, negative_rate double")
    assert checks.rate_range_check(rates).first().bad_rows == 2
    docs = spark.createDataFrame([(None,), (" ",), ("x",)], "retrieval_text string")
    assert checks.blank_documents(docs).first()[:] == (1, 1)


DOCS = [
    # brand, asin, category, type, subtype, title, score
    ("Sony", "A", "electronics", "damage_defect", "hard_defect", "Head &amp; phones", 3),
    ("Sony", "A", "electronics", "damage_defect", "hard_defect", "Head &amp; phones", 4),
    ("Sony", "B", "electronics", "wrong_item", None, "  ", 3),
    (None, "C", "home_kitchen", "quality_issue", "other", "Pan_100", 3),
    ("Bose", "D", "home_kitchen", "other", "x", "Ignored", 3),
    ("Bose", "E", "home_kitchen", "missing_parts", "core_parts_missing", None, 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(
        DOCS, "brand string, asin string, category string, complaint_type string, complaint_subtype string, title string, signal_score int"
    )
    return df.withColumns({"review_date": F.lit("2018-01-05").cast("date"), "month_bucket": F.lit("2018-01-01").cast("date")})


def rows(df):
    return [r[:] for r in df.collect()]


def test_dashboard(docs):
    assert rows(dashboard.overview(docs)) == [(5, 2, 4, 2)]
    assert rows(dashboard.overview(docs, "Electronics", approximate=True)) == [(3, 1, 2, 1)]
    assert rows(dashboard.type_distribution(docs)) == [
        ("damage_defect", 2), ("missing_parts", 1), ("quality_issue", 1), ("wrong_item", 1),
    ]
    assert rows(dashboard.category_distribution(docs)) == [("electronics", 3), ("home_kitchen", 2)]
    assert rows(dashboard.top_brands(docs, limit=1)) == [("Sony", "electronics", 3, 2, 3.33)]
    assert rows(dashboard.subtype_distribution(docs)) == [("hard_defect", 2), ("core_parts_missing", 1)]
    assert rows(dashboard.top_products(docs, "Any", "wrong_item")) == [("Untitled Product", "B", "Sony", "electronics", 1, 1)]
    assert rows(dashboard.monthly_trend(docs))[0][1] == 5


def test_search(docs):
    found = dashboard.complaint_search(docs, brand=" SONY ")
    assert [(r[0], r[4], r[5]) for r in rows(found)] == [("Head &amp; phones", "hard_defect", 2), ("Untitled Product", "-", 1)]
    assert rows(dashboard.search_breakdown(found)) == [("damage_defect", 2), ("wrong_item", 1)]
    shown = dashboard.for_display(found).first()
    assert (shown.product, shown.complaint_type, shown.complaint_subtype) == ("Head & phones", "Damage Defect", "Hard Defect")
    assert dashboard.complaint_search(docs, product="n_1").count() == 1
    assert dashboard.complaint_search(docs, product="%1").count() == 1
    assert dashboard.complaint_search(docs, product="%1", literal=True).count() == 0
    assert dashboard.complaint_search(docs, brand="sony", product="pan").count() == 0
