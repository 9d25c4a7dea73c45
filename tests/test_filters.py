import datetime

import pytest
from pyspark.sql import functions as F

from quibble.functions import filters

VALID = [
    None,
    {"@eq": {"a": 1}},
    {"@and": []},
    {"@and": [{"@gte": {"n": 3}}, {"@and": [{"@lte": {"n": 4}}]}]},
]
INVALID = ["null", "", [], {}, {"category": "x"}, {"@or": []}, {"@eq": {"a": 1, "b": 2}}, {"@eq": 3}, {"@and": {}}, {"@and": [{"x": 1}]},
           {"@eq": {"a": 1}, "bad": 1}]


@pytest.mark.parametrize("spec", VALID)
def test_valid(spec):
    assert filters.is_valid_filter(spec)


@pytest.mark.parametrize("spec", INVALID)
def test_invalid_means_no_filter(spec):
    assert filters.normalize_filter(spec) is None


def test_compiled_filter(spark):
    rows = [(i, "e" if i % 2 else "h", datetime.date(2017, 1, 1) + datetime.timedelta(days=i * 100)) for i in range(10)]
    df = spark.createDataFrame(rows, "n int, c string, d date")

    def ids(spec):
        return [r.n for r in filters.apply_filter(df, spec).orderBy("n").collect()]

    assert ids(None) == ids({"@and": []}) == ids({"c": "e"}) == list(range(10))
    assert ids({"@eq": {"c": "e"}}) == [1, 3, 5, 7, 9]
    assert ids({"@and": [{"@eq": {"c": "h"}}, {"@gte": {"n": 3}}, {"@lte": {"n": "8"}}]}) == [4, 6, 8]
    assert ids({"@and": [{"@gte": {"d": "2017-04-11"}}, {"@lte": {"d": "2017-10-28"}}]}) == [1, 2, 3]
    assert ids({"@gte": {"n": 2}, "@lte": {"n": 3}}) == [2, 3]


def test_selection():
    assert filters.selection_filter("Any", None) is None
    assert filters.selection_filter("Electronics", "any") == {"@eq": {"category": "electronics"}}
    both = filters.selection_filter("electronics", "wrong_item")
    assert both == {"@and": [{"@eq": {"category": "electronics"}}, {"@eq": {"complaint_type": "wrong_item"}}]}


def test_question_table(spark):
    rows = [
        (1, "LATE delivery of electronics", "Any", None),
        (2, "kitchen charger missing", "", "Any"),
        (3, "nothing known", "Home_Kitchen", "Wrong_Item"),
        (4, "broken and late", None, None),
        (5, "nothing", "Any", "any"),
        (6, "broken kitchen thing", "electronics", None),
    ]
    df = spark.createDataFrame(rows, "i int, q string, c string, t string")
    derived = filters.text_clauses("q")
    resolved = filters.resolve_clauses(filters.selection_clauses(F.col("c"), F.col("t")), derived)
    got = df.select("i", filters.clauses_text(resolved).alias("r"), filters.clauses_conflict(resolved).alias("x")).orderBy("i").collect()
    assert [(r.r, r.x) for r in got] == [
        ("category=electronics & complaint_type=delivery_issue", False),
        ("category=home_kitchen & complaint_type=missing_parts", False),
        ("category=home_kitchen & complaint_type=wrong_item", False),
        ("complaint_type=delivery_issue & complaint_type=damage_defect", True),
        (None, False),
        ("category=electronics", False),
    ]
