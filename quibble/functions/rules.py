"""Complaint rules as data, and the columns built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quibble.functions.text import contains_any, sql_text

# ---------------------------------------------------------------------------
# Phrases of each complaint type, in order of precedence.
# ---------------------------------------------------------------------------
TYPE_PHRASES: dict[str, list[str]] = {
    "damage_defect": [
        "broken", "damaged", "defective", "cracked", "shattered", "stopped working",
        "stop working", "did not work", "does not work", "not work", "would not work",
        "won't work", "dead", "failed",
    ],
    "missing_parts": [
        "missing part", "missing parts", "missing piece", "missing pieces", "part missing",
        "parts missing", "incomplete", "not included", "did not include", "no charger",
        "no cable", "no remote",
    ],
    "delivery_issue": [
        "never arrived", "not delivered", "delivered late", "arrived late", "late delivery",
        "late arrival", "delay in delivery", "package never arrived", "item never arrived",
        "did not receive", "not received", "received it late", "delivery delay",
    ],
    "quality_issue": [
        "poor quality", "low quality", "bad quality", "cheaply made", "cheap", "flimsy",
        "not durable", "wear out", "wore out",
    ],
    "wrong_item": [
        "wrong item", "wrong product", "different item", "different product",
        "received the wrong", "sent the wrong", "not as described", "incorrect item",
    ],
}

COMPLAINT_TYPES = list(TYPE_PHRASES)

# Phrases about the seller rather than the product.
SELLER_PHRASES = [
    "shipping cost", "shipping costs", "charged for shipping", "charge for shipping", "seller",
    "customer service", "fake", "counterfeit", "bulk packaging", "scam",
]

# Subtype rules, first match wins: (subtype, complaint type, phrases).
SUBTYPE_RULES: list[tuple[str, str, list[str]]] = [
    ("compatibility_fit_issue", "damage_defect", [
        "not compatible", "incompatible", "does not fit", "did not fit", "doesn't fit",
        "not recognized", "not supported", "won't fit", "would not fit", "interferes with",
        "fits but", "not work with", "did not work with", "work with my", "works with my",
        "not compatible with", "does not work with",
    ]),
    ("counterfeit_or_fake", "damage_defect", ["fake", "counterfeit", "phony", "scam", "not genuine"]),
    ("hard_defect", "damage_defect", [
        "broken", "cracked", "shattered", "burnt", "burned", "dead", "defective", "failed",
        "stopped working", "stop working", "would not work", "won't work", "does not work",
        "did not work", "malfunction", "freezing up", "black screen",
    ]),
    ("not_received", "delivery_issue", [
        "never arrived", "not received", "did not receive", "package never arrived",
        "item never arrived",
    ]),
    ("late_delivery", "delivery_issue", [
        "arrived late", "delivered late", "late delivery", "late arrival", "delivery delay",
    ]),
    ("shipping_cost_issue", "delivery_issue", [
        "shipping cost", "shipping costs", "charged for shipping", "charge for shipping",
    ]),
    ("accessory_missing", "missing_parts", [
        "no charger", "no cable", "no remote", "missing remote", "missing screw",
        "missing screws", "missing adapter", "adapter not included", "not included",
    ]),
    ("core_parts_missing", "missing_parts", [
        "missing part", "missing parts", "missing piece", "missing pieces", "incomplete",
    ]),
    ("poor_build_quality", "quality_issue", [
        "poor quality", "low quality", "bad quality", "cheaply made", "cheap", "flimsy",
    ]),
    ("durability_issue", "quality_issue", [
        "wear out", "wore out", "not durable", "lasted % day", "lasted % week", "lasted % month",
    ]),
    ("wrong_item_received", "wrong_item", [
        "wrong item", "wrong product", "different item", "different product", "incorrect item",
        "received the wrong", "sent the wrong",
    ]),
]

# Phrases of book and film reviews.
NARRATIVE_PHRASES = [
    "boring novel", "boring book", "poor writing", "bad writing", "story line", "storyline",
    "plot", "characters", "author", "chapter", "hardcover", "paperback", "read this book",
    "novel i've read",
]

# The product metadata that fits each review category.
DOMAIN_RULES: dict[str, dict[str, list[str]]] = {
    "electronics": {
        "root": ["electronics"],
        "path_prefix": ["electronics"],
        "main": ["electronics"],
        "sub": ["electronics"],
    },
    "home_kitchen": {
        "root": ["home & kitchen", "home and kitchen"],
        "path_prefix": ["home & kitchen", "home and kitchen"],
        "main": ["kitchen", "home"],
        "sub": ["kitchen", "home"],
    },
}

COMPLAINT_CATEGORIES = list(DOMAIN_RULES)


def type_flag_name(complaint_type: str) -> str:
    return f"has_{complaint_type}"


def _bit(test: str) -> Column:
    return F.expr(f"CASE WHEN {test} THEN 1 ELSE 0 END")


def type_flags(text_lc: str) -> dict[str, Column]:
    """One 0/1 column per complaint type over a lower-cased text column."""
    return {type_flag_name(t): _bit(contains_any(text_lc, p)) for t, p in TYPE_PHRASES.items()}


def seller_noise(text_lc: str) -> Column:
    return F.expr(contains_any(text_lc, SELLER_PHRASES))


def type_hints() -> Column:
    """Names of the set flags, comma separated, in order of precedence."""
    names = ", ".join(f"CASE WHEN {type_flag_name(t)} = 1 THEN '{t}' END" for t in COMPLAINT_TYPES)
    return F.expr(f"concat_ws(', ', {names})")


def type_by_precedence() -> Column:
    picked = " ".join(f"WHEN {type_flag_name(t)} = 1 THEN '{t}'" for t in COMPLAINT_TYPES)
    return F.expr(f"CASE {picked} ELSE 'other' END")


def type_agrees_with_flag(complaint_type: str) -> Column:
    """1 when the flag of the chosen type is set."""
    return _bit(" OR ".join(f"({complaint_type} = '{t}' AND {type_flag_name(t)} = 1)" for t in COMPLAINT_TYPES))


def subtype(complaint_type: str, text_lc: str) -> Column:
    rules = " ".join(
        f"WHEN {complaint_type} = '{of_type}' AND {contains_any(text_lc, phrases)} THEN '{name}'"
        for name, of_type, phrases in SUBTYPE_RULES
    )
    return F.expr(f"CASE {rules} ELSE concat('general_', {complaint_type}) END")


def domain_match(category: str, root: str, path: str, main: str, sub: str) -> Column:
    """1 when product metadata fits the review category; a missing main category fits."""
    tests = []
    for name, rule in DOMAIN_RULES.items():
        fits = [f"{main} IS NULL", contains_any(f"lower({main})", rule["main"])]
        fits += [f"lower({root}) = {sql_text(r)}" for r in rule["root"]]
        fits += [f"startswith(lower({path}), {sql_text(p)})" for p in rule["path_prefix"]]
        fits.append(contains_any(f"lower({sub})", rule["sub"]))
        tests.append(f"({category} = '{name}' AND ({' OR '.join(fits)}))")
    return _bit(" OR ".join(tests))


def narrative_noise(text_lc: str, match: str = "search") -> Column:
    """1 for narrative reviews. ``search``: a phrase occurs anywhere;
    ``full``: the whole text is one phrase."""
    if match == "search":
        return _bit(contains_any(text_lc, NARRATIVE_PHRASES))
    if match == "full":
        return _bit(f"{text_lc} IN ({', '.join(sql_text(p) for p in NARRATIVE_PHRASES)})")
    raise ValueError(f"unknown narrative match: {match!r}")
