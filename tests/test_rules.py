from pyspark.sql import functions as F

from quibble.functions import rules
from quibble.functions.text import _needed


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, lc string")


def test_every_phrase_sets_its_flag_and_no_text_sets_none(spark):
    phrases = [(t, p) for t, ps in rules.TYPE_PHRASES.items() for p in ps]
    df = texts(spark, [f"well, {p} indeed" for _, p in phrases] + ["all is well"])
    rows = df.select("i", *[c.alias(n) for n, c in rules.type_flags("lc").items()]).orderBy("i").collect()
    for (t, _), row in zip(phrases, rows):
        assert row[f"has_{t}"] == 1
    assert sum(rows[-1][1:]) == 0


def test_dropping_contained_phrases_keeps_the_meaning():
    for phrases in [*rules.TYPE_PHRASES.values(), rules.SELLER_PHRASES, *[p for _, _, p in rules.SUBTYPE_RULES]]:
        kept = _needed(phrases)
        assert len(kept) < len(phrases) or kept == phrases
        for p in phrases:
            assert any(k in p for k in kept)


def test_seller_phrases(spark):
    df = texts(spark, [f"the {p}." for p in rules.SELLER_PHRASES] + ["the product"])
    hits = [r.hit for r in df.select("i", rules.seller_noise("lc").alias("hit")).orderBy("i").collect()]
    assert hits == [True] * len(rules.SELLER_PHRASES) + [False]


def test_precedence_and_hints(spark):
    df = texts(spark, ["broken, missing part", "missing part arrived late", "arrived late, cheap", "cheap wrong item", "fine"])
    flagged = df.withColumns(rules.type_flags("lc"))
    rows = flagged.select("i", rules.type_by_precedence().alias("t"), rules.type_hints().alias("h")).orderBy("i").collect()
    assert [r.t for r in rows] == ["damage_defect", "missing_parts", "delivery_issue", "quality_issue", "other"]
    assert [r.h for r in rows] == [
        "damage_defect, missing_parts", "missing_parts, delivery_issue", "delivery_issue, quality_issue",
        "quality_issue, wrong_item", "",
    ]


def subtype_of(spark, pairs):
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(pairs)], "i int, t string, lc string")
    return [r.s for r in df.select("i", rules.subtype("t", "lc").alias("s")).orderBy("i").collect()]


def first_match(of_type, text):
    """The first rule of the type with a phrase in the text, read off the table."""
    import re

    for name, t, phrases in rules.SUBTYPE_RULES:
        if t == of_type and any(re.search(re.escape(p).replace("%", ".*"), text, re.S) for p in phrases):
            return name
    return f"general_{of_type}"


def test_every_subtype_phrase(spark):
    pairs = [(t, f"it {p} x") for _, t, phrases in rules.SUBTYPE_RULES for p in phrases]
    pairs += [(t, "nothing known") for t in rules.COMPLAINT_TYPES]
    pairs += [("quality_issue", "lasted 3 days"), ("quality_issue", "lasted about two weeks"), ("quality_issue", "lasted days")]
    got = subtype_of(spark, pairs)
    assert got == [first_match(t, x) for t, x in pairs]
    assert got[-3:] == ["durability_issue", "durability_issue", "general_quality_issue"]


def test_narrative_modes(spark):
    df = texts(spark, ["i've read novel i've read before", "boring book", "a plot", "camera"])
    rows = df.select(
        "i", rules.narrative_noise("lc").alias("s"), rules.narrative_noise("lc", "full").alias("f")
    ).orderBy("i").collect()
    assert [(r.s, r.f) for r in rows] == [(1, 0), (1, 1), (1, 0), (0, 0)]


def test_domain_match(spark):
    cases = [
        # category, root, path, main, sub, expected
        ("electronics", "Electronics", None, "Toys", None, 1),
        ("electronics", None, "Electronics > Audio", "Toys", None, 1),
        ("electronics", None, None, "All Electronics", None, 1),
        ("electronics", None, None, "Toys", "Car Electronics", 1),
        ("electronics", None, None, None, None, 1),
        ("electronics", "Toys", "Toys", "Toys", "Toys", 0),
        ("home_kitchen", "Home and Kitchen", None, "Toys", None, 1),
        ("home_kitchen", None, "Home & Kitchen > X", "Toys", None, 1),
        ("home_kitchen", None, None, "Smart Home", None, 1),
        ("home_kitchen", None, None, "Toys", "kitchen ware", 1),
        ("home_kitchen", None, None, "Electronics", None, 0),
        ("dev", None, None, None, None, 0),
    ]
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i int, c string, r string, p string, m string, s string, want int"
    )
    rows = df.select("i", "want", rules.domain_match("c", "r", "p", "m", "s").alias("got")).orderBy("i").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert F is not None
