import re

from pyspark.sql import functions as F

from quibble.functions import answers

TEXTS = [
    "Issue Summary:\n- a\n\nLikely Recurring Pattern: b\nRoot Cause Hypothesis:\nc\nBusiness Impact:\nd\nRecommended Actions:\n- e\n- f\n",
    "intro Issue Summary: one Issue Summary: two",
    "Recommended Actions -\n x\nNext Steps:\n y",
    "issue summary:\n\n lower case\nEnd of it: z",
    "no sections at all  ",
    "Issue Summary:",
    "Issue Summary:\n",
    "",
]


def rows(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return df.select("i", *columns).orderBy("i").collect()


def expected_sections(text):
    """By walking over the label positions."""
    marks = sorted((m.start(), m.end(), label) for label in answers.SECTION_LABELS for m in re.finditer(re.escape(label + ":"), text))
    ends = [m[0] for m in marks[1:]] + [len(text)]
    return {label: text[start:end].strip() for (_, start, label), end in zip(marks, ends)}


def test_sections(spark):
    got = rows(spark, TEXTS, *[c.alias(n) for n, c in answers.answer_sections("t").items()])
    for text, row in zip(TEXTS, got):
        want = expected_sections(text)
        assert {label: row[answers.section_column(label)] for label in answers.SECTION_LABELS} == {
            label: want.get(label) for label in answers.SECTION_LABELS
        }


def test_section_or_text(spark):
    got = rows(
        spark, TEXTS,
        answers.section_or_text(F.col("t"), "Issue Summary").alias("a"),
        answers.section_or_text(F.col("t"), "Recommended Actions").alias("b"),
    )
    assert [r.a for r in got] == [
        "- a", TEXTS[1], TEXTS[2].strip(), "lower case", "no sections at all", "Issue Summary:", "", "",
    ]
    assert got[0].b == "- e\n- f" and got[2].b == "x"


def test_verification(spark):
    texts = [
        "Verification:\n- fine highlights\nConfidence:\n- High",
        "verification -\nok\nCONFIDENCE: medium",
        "Verification:\nok\nConfidence\n• low",
        "only highlights",
        "",
        None,
    ]
    got = rows(
        spark, texts,
        answers.verification_body(F.col("t")).alias("b"),
        answers.confidence_level(F.col("t")).alias("c"),
        answers.confidence_by_substring(F.col("t")).alias("s"),
    )
    assert [r.b for r in got] == ["- fine highlights", "ok", "ok", "only highlights", "", ""]
    assert [r.c for r in got] == ["High", "Medium", "Low", "", "", ""]
    assert [r.s for r in got] == ["High", "Medium", "Low", "High", "", ""]


def test_scores(spark):
    cases = {
        '{"score": 0.8}': 0.8,
        ' {"score": "0.5"}\n': 0.5,
        'x {"score" : 0.35} y': 0.35,
        '{"other": {"score": 1}}': 0.0,
        '[{"score": 1}]': 1.0,
        "none": 0.0,
        '{"score": null}': 0.0,
        '"score": 1.2.3': 0.0,
        '{"score": 7}': 7.0,
        '{"score": -1}': -1.0,
        '{"score": true}': 1.0,
        "": 0.0,
    }
    s = answers.judge_score(F.col("t"))
    got = rows(spark, list(cases), s.alias("s"), answers.clamp_score(s).alias("c"), answers.answerable(s).alias("a"))
    assert [r.s for r in got] == list(cases.values())
    assert [r.c for r in got] == [min(1.0, max(0.0, v)) for v in cases.values()]
    assert [r.a for r in got] == [1.0 if v >= 0.5 else 0.0 for v in cases.values()]
