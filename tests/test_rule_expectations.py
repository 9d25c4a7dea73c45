"""Complaint type and subtype of whole sentences, written down by hand and not read off the rule tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quibble.functions import rules
from quibble.functions.dates import review_date
from quibble.functions.text import to_double

SENTENCES = [
    # text, type by precedence, subtype
    ("the hinge was broken on day one", "damage_defect", "hard_defect"),
    ("screen came cracked", "damage_defect", "hard_defect"),
    ("glass shattered in my hand", "damage_defect", "hard_defect"),
    ("a defective unit", "damage_defect", "hard_defect"),
    ("box was damaged", "damage_defect", "general_damage_defect"),
    ("it stopped working in june", "damage_defect", "hard_defect"),
    ("made my lamp stop working", "damage_defect", "hard_defect"),
    ("it did not work", "damage_defect", "hard_defect"),
    ("it does not work", "damage_defect", "hard_defect"),
    ("it would not work", "damage_defect", "hard_defect"),
    ("it won't work", "damage_defect", "hard_defect"),
    ("could not work it", "damage_defect", "general_damage_defect"),
    ("battery is dead", "damage_defect", "hard_defect"),
    ("the motor failed", "damage_defect", "hard_defect"),
    ("damaged and burnt", "damage_defect", "hard_defect"),
    ("damaged, burned wires", "damage_defect", "hard_defect"),
    ("damaged by a malfunction", "damage_defect", "hard_defect"),
    ("damaged, keeps freezing up", "damage_defect", "hard_defect"),
    ("damaged: black screen", "damage_defect", "hard_defect"),
    ("damaged and phony", "damage_defect", "counterfeit_or_fake"),
    ("damaged, a fake", "damage_defect", "counterfeit_or_fake"),
    ("damaged counterfeit", "damage_defect", "counterfeit_or_fake"),
    ("damaged, what a scam", "damage_defect", "counterfeit_or_fake"),
    ("damaged and not genuine", "damage_defect", "counterfeit_or_fake"),
    ("damaged, not compatible", "damage_defect", "compatibility_fit_issue"),
    ("damaged and incompatible", "damage_defect", "compatibility_fit_issue"),
    ("broken, does not fit", "damage_defect", "compatibility_fit_issue"),
    ("broken, did not fit", "damage_defect", "compatibility_fit_issue"),
    ("broken, doesn't fit", "damage_defect", "compatibility_fit_issue"),
    ("failed, card not recognized", "damage_defect", "compatibility_fit_issue"),
    ("failed, phone not supported", "damage_defect", "compatibility_fit_issue"),
    ("broken, won't fit", "damage_defect", "compatibility_fit_issue"),
    ("broken, would not fit", "damage_defect", "compatibility_fit_issue"),
    ("dead, interferes with radio", "damage_defect", "compatibility_fit_issue"),
    ("dead, fits but wobbles", "damage_defect", "compatibility_fit_issue"),
    ("does not work with it", "damage_defect", "compatibility_fit_issue"),
    ("did not work with it", "damage_defect", "compatibility_fit_issue"),
    ("failed to work with my car", "damage_defect", "compatibility_fit_issue"),
    ("failed, works with my old one", "damage_defect", "compatibility_fit_issue"),
    ("a missing part", "missing_parts", "core_parts_missing"),
    ("two missing parts", "missing_parts", "core_parts_missing"),
    ("a missing piece", "missing_parts", "core_parts_missing"),
    ("some missing pieces", "missing_parts", "core_parts_missing"),
    ("one part missing", "missing_parts", "general_missing_parts"),
    ("some parts missing", "missing_parts", "general_missing_parts"),
    ("set is incomplete", "missing_parts", "core_parts_missing"),
    ("lid not included", "missing_parts", "accessory_missing"),
    ("did not include a lid", "missing_parts", "general_missing_parts"),
    ("no charger", "missing_parts", "accessory_missing"),
    ("no cable", "missing_parts", "accessory_missing"),
    ("no remote", "missing_parts", "accessory_missing"),
    ("incomplete, missing screws", "missing_parts", "accessory_missing"),
    ("incomplete, missing screw", "missing_parts", "accessory_missing"),
    ("incomplete, missing remote", "missing_parts", "accessory_missing"),
    ("incomplete, missing adapter", "missing_parts", "accessory_missing"),
    ("it never arrived", "delivery_issue", "not_received"),
    ("it was not delivered", "delivery_issue", "general_delivery_issue"),
    ("delivered late", "delivery_issue", "late_delivery"),
    ("arrived late", "delivery_issue", "late_delivery"),
    ("a late delivery", "delivery_issue", "late_delivery"),
    ("a late arrival", "delivery_issue", "late_delivery"),
    ("delay in delivery", "delivery_issue", "general_delivery_issue"),
    ("did not receive it", "delivery_issue", "not_received"),
    ("was not received", "delivery_issue", "not_received"),
    ("received it late", "delivery_issue", "general_delivery_issue"),
    ("a delivery delay", "delivery_issue", "late_delivery"),
    ("not delivered, shipping costs lost", "delivery_issue", "shipping_cost_issue"),
    ("not delivered yet charged for shipping", "delivery_issue", "shipping_cost_issue"),
    ("not delivered, they charge for shipping", "delivery_issue", "shipping_cost_issue"),
    ("poor quality", "quality_issue", "poor_build_quality"),
    ("low quality", "quality_issue", "poor_build_quality"),
    ("bad quality", "quality_issue", "poor_build_quality"),
    ("cheaply made", "quality_issue", "poor_build_quality"),
    ("looks cheap", "quality_issue", "poor_build_quality"),
    ("flimsy", "quality_issue", "poor_build_quality"),
    ("not durable", "quality_issue", "durability_issue"),
    ("soles wear out", "quality_issue", "durability_issue"),
    ("soles wore out", "quality_issue", "durability_issue"),
    ("wrong item", "wrong_item", "wrong_item_received"),
    ("wrong product", "wrong_item", "wrong_item_received"),
    ("a different item", "wrong_item", "wrong_item_received"),
    ("a different product", "wrong_item", "wrong_item_received"),
    ("an incorrect item", "wrong_item", "wrong_item_received"),
    ("received the wrong one", "wrong_item", "wrong_item_received"),
    ("sent the wrong one", "wrong_item", "wrong_item_received"),
    ("not as described", "wrong_item", "general_wrong_item"),
    ("all is well", "other", "general_other"),
    ("cheap and broken", "damage_defect", "hard_defect"),
    ("wrong item arrived late", "delivery_issue", "late_delivery"),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "i int, lc string")
    typed = df.withColumns(rules.type_flags("lc")).withColumn("t", rules.type_by_precedence())
    got = [(r.lc, r.t, r.s) for r in typed.select("i", "lc", "t", rules.subtype("t", "lc").alias("s")).orderBy("i").collect()]
    assert got == SENTENCES


@pytest.mark.parametrize(
    "text",
    ["high shipping cost", "charged for shipping", "charge for shipping", "the seller lied", "customer service", "a fake", "counterfeit", "bulk packaging", "scam"],
)
def test_seller_texts(spark, text):
    assert spark.createDataFrame([(text,)], "lc string").select(rules.seller_noise("lc")).first()[0]


@pytest.mark.parametrize(
    "text",
    ["boring novel", "boring book", "poor writing", "bad writing", "story line", "storyline", "plot", "characters", "author", "chapter", "hardcover", "paperback", "read this book", "novel i've read"],
)
def test_narrative_texts(spark, text):
    df = spark.createDataFrame([(f"a {text} here",)], "lc string")
    assert df.select(rules.narrative_noise("lc")).first()[0] == 1


def test_dates_and_ratings_at_the_edges(spark):
    rows = [("2018-02-28", None), (None, "1519862400"), (None, None), ("2018-02-30", "1519862400")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, u string")
    got = [r.d for r in df.select("i", review_date(F.col("t"), F.col("u")).alias("d")).orderBy("i").collect()]
    assert got[:3] == [datetime.date(2018, 2, 28), datetime.date(2018, 3, 1), None]
    ratings = spark.createDataFrame([("5",), ("4.5",), ("x",), ("",), ("5d",)], "v string").select(to_double(F.col("v")).alias("v"))
    assert [r.v for r in ratings.collect()] == [5.0, 4.5, None, None, None]
