"""Scalar column helpers: blank handling, safe casts, text cleaning, labels."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = r"<[^>]++>"
# Control characters become blanks and runs of blanks one blank, in one pass.
_BLANKS = r"[\p{Cntrl}\s]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_double(c: Column) -> Column:
    """String to double, null when it is no number (``1d`` and ``1f`` are none)."""
    text = c.cast("string")
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))


def to_number(c: Column) -> Column:
    """String to whole number, rounding half up, null when it is no number."""
    return c.try_cast("decimal(38,0)").try_cast("bigint")


def vote_count(c: Column) -> Column:
    return to_number(F.replace(c, F.lit(","), F.lit("")))


def price_digits(c: Column, dtype: str = "string") -> Column:
    """Digits and dots of a price text as double; a numeric price passes through
    (printing a large double yields an exponent, which would be read as digits)."""
    if dtype != "string":
        return c.cast("double")
    return F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")


def currency_amount(c: Column) -> Column:
    """Amount with optional ``$`` and thousands commas; anything else is null."""
    amount = to_double(F.trim(F.regexp_replace(F.trim(c), r"[$,]", "")))
    return F.when(~F.isnan(amount), amount)


def without_tags(c: Column) -> Column:
    """Each ``<...>`` becomes a blank.

    Only the text up to its last ``>`` is searched: past it no tag can close,
    and every unclosed ``<`` would be followed to the end of the text.
    """
    rest = F.substring_index(c, ">", -1)
    tagged = F.left(c, F.length(c) - F.length(rest))
    return F.when(c.contains("<") & c.contains(">"), F.concat(F.regexp_replace(tagged, _TAG, " "), rest)).otherwise(c)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(without_tags(F.coalesce(c, F.lit(""))), _BLANKS, " "))


def verified_flag(c: Column) -> Column:
    v = F.lower(c)
    return F.when(v.isin("true", "y", "yes"), 1).when(v.isin("false", "n", "no"), 0)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name`` so that it is evaluated exactly once per row.

    A projected alias is substituted into every predicate above it when the
    optimizer pushes filters down, and a filter has no common-subexpression
    elimination: ten tests on a cleaned text would clean it ten times. A
    one-element generator is a boundary predicates on its output cannot cross.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _needed(patterns: Sequence[str]) -> list[str]:
    """Patterns left after dropping each one that another pattern is part of."""
    unique = list(dict.fromkeys(patterns))
    return [p for p in unique if not any(q != p and "%" not in q and q in p for q in unique)]


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_shared_word(patterns: list[str]) -> list[tuple[str | None, list[str]]]:
    """Patterns grouped by a word that several of them contain (``None``: no such word)."""
    left, groups = list(patterns), []
    while left:
        words = {w for p in left if "%" not in p for w in p.split() if len(w) > 3}
        having = {w: [p for p in left if "%" not in p and w in p] for w in sorted(words)}
        best = max(having, key=lambda w: len(having[w]), default=None)
        if best is None or len(having[best]) < 2:
            return groups + [(None, left)]
        groups.append((best, having[best]))
        left = [p for p in left if p not in having[best]]
    return groups


def contains_any(column: str, patterns: Sequence[str]) -> str:
    """SQL test: any pattern occurs in ``column``; ``%`` inside a pattern is a wildcard.

    Plain patterns stay substring searches, which run several times faster on
    the JVM than one regex alternation; patterns that share a word are only
    searched in texts with that word. SQL text, because a rule table is then
    one call to Spark and not one per phrase.
    """

    def test(p: str) -> str:
        return f"{column} LIKE {sql_text(f'%{p}%')}" if "%" in p else f"contains({column}, {sql_text(p)})"

    tests = []
    for word, group in _by_shared_word(_needed(patterns)):
        any_of = " OR ".join(test(p) for p in group)
        if any_of:
            tests.append(f"({test(word)} AND ({any_of}))" if word else any_of)
    return "(" + " OR ".join(tests) + ")"


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    """All named and numeric entities, each once. Texts without an ampersand stay as they are."""
    return F.when(c.contains("&"), _unescaped(F.when(c.contains("&"), c))).otherwise(c)


# Display labels.
DISPLAY_LABELS = {
    "Any": "Any",
    "electronics": "Electronics",
    "home_kitchen": "Home & Kitchen",
    "damage_defect": "Damage Defect",
    "missing_parts": "Missing Parts",
    "delivery_issue": "Delivery Issue",
    "wrong_item": "Wrong Item",
    "quality_issue": "Quality Issue",
}


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def display_label(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DISPLAY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), title_label(c))


def product_label(title: Column) -> Column:
    return F.coalesce(blank_to_null(title), F.lit("Untitled Product"))


def brand_case(c: Column, after_punctuation: bool = False) -> Column:
    """Title-case a brand. By default words break at spaces only; with
    ``after_punctuation`` every non-alphanumeric character starts a new word."""
    if not after_punctuation:
        return F.initcap(c)
    # A boundary after each separator, proper-case the piece, glue it back.
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), ""
    )
