import datetime

from pyspark.sql import functions as F

from quibble.functions.dates import parse_date
from quibble.functions.text import brand_case, clean_text, currency_amount, display_label, unescape_html
from quibble.operators.clean import CLEAN_META_COLUMNS, CLEAN_REVIEW_COLUMNS, clean_meta, clean_reviews
from quibble.sources.schemas import META_RAW, REVIEWS_RAW

NOW = datetime.datetime(2026, 1, 4, 6)
DAY = datetime.date(2026, 1, 1)
LONG = "This thing arrived broken and I want my money back"


def review(**changes):
    row = dict(
        asin="A1", reviewerID="R1", reviewerName=" Ann ", overall=2.0, summary="s", reviewText=LONG,
        unixReviewTime="1483228800", reviewTime=None, verified="true", vote=None, category="electronics",
        ingest_dt=DAY, source_file="f", load_ts=NOW,
    )
    return tuple({**row, **changes}.values())


def cleaned(spark, *rows):
    out = clean_reviews(spark.createDataFrame(list(rows), REVIEWS_RAW))
    assert out.columns == CLEAN_REVIEW_COLUMNS
    return out.orderBy("reviewer_id").collect()


def column(spark, values, f, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text_cleaning(spark):
    got = column(
        spark,
        ["<p>a</p>\t\tb\r\nc ", None, "", "1 < 2 and 3 > 2", "<>x", "a\x00\x1f\x7fb", "<" * 50_000, "\n" * 50_000 + "z", "x<b", "<a" * 50_000 + ">" + "<b" * 50_000, "> x <"],
        clean_text,
    )
    assert got == ["a b c", "", "", "1 2", "<>x", "a b", "<" * 50_000, "z", "x<b", "<b" * 50_000, "> x <"]


def test_length_gate_counts_cleaned_characters(spark):
    rows = [review(reviewerID=f"R{n}", reviewText="<b>" + "é" * n + "</b>") for n in (29, 30, 31)]
    assert [(r.reviewer_id, r.review_length) for r in cleaned(spark, *rows)] == [("R31", 31)]


def test_gates(spark):
    rows = [
        review(reviewerID="a", asin=" "), review(reviewerID="b", category=""), review(reviewerID="c", overall=None),
        review(reviewerID="d", ingest_dt=None), review(reviewerID="e", reviewText=None),
        review(reviewerID="f", reviewText=LONG + " the SELLER"), review(reviewerID="g"),
    ]
    assert [r.reviewer_id for r in cleaned(spark, *rows)] == ["g"]


def test_ratings(spark):
    rows = [review(reviewerID=str(r), overall=r) for r in (2.0, 2.5, 3.0, 3.5, 4.0)]
    got = [(r.positive_flag, r.neutral_flag, r.negative_flag, r.is_low_rating_review) for r in cleaned(spark, *rows)]
    assert got == [(0, 0, 1, 1), (0, 0, 0, 1), (0, 1, 0, 1), (0, 0, 0, 0), (1, 0, 0, 0)]


def test_votes_and_verified(spark):
    votes = ["1,234", "", "1.5", "x", None]
    rows = [review(reviewerID=str(i), vote=v, verified=w) for i, (v, w) in enumerate(zip(votes, ["Y", "no", "?", " ", None]))]
    got = cleaned(spark, *rows)
    assert [r.vote_count for r in got] == [1234, None, 2, None, None]
    assert [r.verified_flag for r in got] == [1, 0, None, None, None]


def test_dates(spark):
    rows = [
        review(reviewerID="1", reviewTime="2018-01-07"),
        review(reviewerID="2", reviewTime="09 13, 2018"),
        review(reviewerID="3", unixReviewTime="x"),
    ]
    got = cleaned(spark, *rows)
    assert [str(r.review_date) for r in got] == ["2018-01-07", "2017-01-01", "None"]
    assert (str(got[0].week_bucket), str(got[0].month_bucket)) == ("2018-01-01", "2018-01-01")
    forms = ["09 13, 2018", "9/3/2018", "13-Sep-2018", "2018", "99/99/2018"]
    assert [str(d) for d in column(spark, forms, lambda c: parse_date(c, True))] == [
        "2018-09-13", "2018-09-03", "2018-09-13", "None", "None",
    ]


def test_amounts_and_labels(spark):
    assert column(spark, ["$1,299.00", "", "None", "nan", "$5.99 - $10.99", " 7 ", "1d"], currency_amount) == [
        1299.0, None, None, None, None, 7.0, None,
    ]
    assert column(spark, ["home_kitchen", "poor_build_quality", "Any"], display_label) == [
        "Home & Kitchen", "Poor Build Quality", "Any",
    ]
    assert column(spark, ["a &amp;lt; b &quot;c&quot; &#39;"], unescape_html) == ["a &lt; b \"c\" '"]
    assert column(spark, ["caf&eacute; &#233;&#xe9; &hellip;", "AT&T", None, "plain"], unescape_html) == ["café éé …", "AT&T", None, "plain"]
    assert column(spark, ["at&t MOBILE o'neil", None], lambda c: brand_case(c, True)) == ["At&T Mobile O'Neil", None]
    assert column(spark, ["at&t MOBILE"], brand_case) == ["At&t Mobile"]


def test_meta_newest_record_and_categories(spark):
    def meta(asin, title, listed, day, price=9.5, hour=6):
        return (asin, title, "sony", price, "M", listed, "dev", datetime.date(2026, 1, day), "f", NOW.replace(hour=hour))

    rows = [
        meta("A", "old", '["x"]', 1), meta("A", "new", '["Home"," Kitchen ","Pans"]', 2, 12345678.0),
        meta("A", "new, earlier load", "[]", 2, hour=5),
        meta("B", " ", "not json", 1), meta("C", "t", "[]", 1), meta("D", "t", '["One"]', 1),
        meta("E", "t", '{"a": 1}', 1), meta("F", "t", '["a", null, "c"]', 1), meta(None, "t", "[]", 1),
    ]
    out = clean_meta(spark.createDataFrame(rows, META_RAW))
    assert out.columns == CLEAN_META_COLUMNS
    got = {r.asin: r for r in out.collect()}
    assert set(got) == set("ABCDEF")
    a = got["A"]
    assert (a.title, a.brand, a.price, a.root_category, a.sub_category, a.leaf_category, a.category_depth, a.category_path) == (
        "new", "Sony", 12345678.0, "Home", "Kitchen", "Pans", 3, "Home >  Kitchen  > Pans",
    )
    assert (got["B"].title, got["B"].category_depth, got["B"].category_path) == (None, None, None)
    assert (got["C"].leaf_category, got["C"].category_depth, got["C"].category_path) == (None, 0, "")
    assert (got["D"].root_category, got["D"].sub_category, got["D"].leaf_category) == ("One", None, "One")
    assert got["E"].category_depth is None
    assert got["F"].category_path == "a >  > c"


def test_meta_price_text(spark):
    schema = META_RAW.replace("price double", "price string")
    rows = [(k, "t", "b", p, "m", "[]", "dev", DAY, "f", NOW) for k, p in (("A", "$1,299.00"), ("B", "5.99 - 10.99"), ("C", None))]
    assert {r.asin: r.price for r in clean_meta(spark.createDataFrame(rows, schema)).collect()} == {"A": 1299.0, "B": None, "C": None}


def test_text_is_cleaned_once_per_row(spark):
    plan = clean_reviews(spark.createDataFrame([review()], REVIEWS_RAW))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<[^>]++>") == 1
    assert plan.count("Exchange") == 0
