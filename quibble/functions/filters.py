"""Retrieval filters: compiling them, and deriving them from choices or query text."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quibble.functions.text import contains_any

_COMPARISONS = {
    "@eq": lambda c, v: c == v,
    "@gte": lambda c, v: c >= v,
    "@lte": lambda c, v: c <= v,
}

# What words in a question say about the wanted documents.
QUERY_RULES: list[tuple[str, str, list[str]]] = [
    ("category", "electronics", ["electronics"]),
    ("category", "home_kitchen", ["home kitchen", "home_kitchen", "kitchen"]),
    ("complaint_type", "delivery_issue", ["delivery", "late", "arrived"]),
    ("complaint_type", "missing_parts", ["missing", "accessory", "charger", "cable"]),
    ("complaint_type", "wrong_item", ["wrong item", "wrong product"]),
    ("complaint_type", "damage_defect", ["broken", "failed", "stopped working", "not working"]),
]


def is_valid_filter(spec: Any) -> bool:
    """``None``, single-field ``@eq``/``@gte``/``@lte``, or ``@and`` over valid filters."""
    if spec is None:
        return True
    if not isinstance(spec, dict) or not spec:
        return False
    for op, arg in spec.items():
        if op in _COMPARISONS:
            if not (isinstance(arg, dict) and len(arg) == 1):
                return False
        elif op == "@and":
            if not (isinstance(arg, list) and all(is_valid_filter(a) for a in arg)):
                return False
        else:
            return False
    return True


def normalize_filter(spec: Any) -> dict | None:
    """The filter if it is a valid one, else no filter."""
    return spec if isinstance(spec, dict) and is_valid_filter(spec) else None


def compile_filter(spec: Any, schema: T.StructType) -> Column | None:
    """Predicate for a filter over columns of ``schema``; ``None`` means no filter.

    Values are cast to the column's type, so ISO texts compare as dates and the
    predicate still reaches the Parquet scan.
    """
    spec = normalize_filter(spec)
    if spec is None:
        return None
    tests: list[Column] = []
    for op, arg in spec.items():
        if op == "@and":
            tests += [t for t in (compile_filter(a, schema) for a in arg) if t is not None]
        else:
            ((field, value),) = arg.items()
            tests.append(_COMPARISONS[op](F.col(field), F.lit(value).cast(schema[field].dataType)))
    return reduce(and_, tests) if tests else None


def filter_clauses(spec: Any) -> list[tuple[str, str, str]]:
    """(field, operator, value as text) of a filter; empty for none."""
    spec = normalize_filter(spec)
    if spec is None:
        return []
    out: list[tuple[str, str, str]] = []
    for op, arg in spec.items():
        if op == "@and":
            out += [c for a in arg for c in filter_clauses(a)]
        else:
            out += [(field, op.removeprefix("@"), str(value)) for field, value in arg.items()]
    return out


def with_operator(clauses: Column) -> Column:
    """Equality clauses (field, value) as (field, op, value)."""
    return F.transform(clauses, lambda c: F.struct(c["field"].alias("field"), F.lit("eq").alias("op"), c["value"].alias("value")))


def equality_clauses(columns: list[str]) -> Column:
    """(field, op, value) for each of the query's columns that is not null."""
    asked = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.lit("eq").alias("op"), F.col(c).cast("string").alias("value")))
        for c in columns
    ]
    return F.array_compact(F.array(*asked))


def clauses_hold(clauses: Column, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Whether a document with ``fields`` (name to column and type) meets all clauses of a query's row.

    Values are cast to the field's type. A clause over another field, or whose value can't be
    cast, holds for no document; no clauses hold for all.
    """

    def holds(c: Column) -> Column:
        out = F.lit(False)
        for name, (column, kind) in fields.items():
            value = c["value"].try_cast(kind)
            test = F.when(c["op"] == "eq", column == value).when(c["op"] == "gte", column >= value)
            test = test.when(c["op"] == "lte", column <= value)
            out = F.when(c["field"] == name, test).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.forall(clauses, holds), F.lit(True))


def apply_filter(df: DataFrame, spec: Any) -> DataFrame:
    test = compile_filter(spec, df.schema)
    return df if test is None else df.filter(test)


def selection_filter(category: str | None, complaint_type: str | None) -> dict | None:
    """Filter for two choices; ``Any`` or blank chooses nothing."""
    chosen = {"category": category, "complaint_type": complaint_type}
    clauses = [
        {"@eq": {field: value.lower()}} for field, value in chosen.items() if value and value.lower() != "any"
    ]
    if len(clauses) > 1:
        return {"@and": clauses}
    return clauses[0] if clauses else None


def _clause(field: str, value: Column | str) -> Column:
    v = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(field).alias("field"), v.alias("value"))


def _non_empty(clauses: Column) -> Column:
    return F.when(F.size(clauses) > 0, clauses)


def selection_clauses(category: Column, complaint_type: Column) -> Column:
    """:func:`selection_filter` for a table of questions: equality clauses, null for none."""
    clauses = []
    for field, c in (("category", category), ("complaint_type", complaint_type)):
        v = F.lower(c)
        clauses.append(F.when(~v.isin("any", ""), _clause(field, v)))
    return _non_empty(F.array_compact(F.array(*clauses)))


def text_clauses(query: str) -> Column:
    """Equality clauses that words in the question call for, null for none."""
    clauses = ", ".join(
        f"CASE WHEN {contains_any(f'lower({query})', words)}"
        f" THEN named_struct('field', '{field}', 'value', '{value}') END"
        for field, value, words in QUERY_RULES
    )
    return _non_empty(F.expr(f"array_compact(array({clauses}))"))


def resolve_clauses(given: Column, derived: Column) -> Column:
    """The caller's clauses win over derived ones."""
    return F.coalesce(given, derived)


def clauses_conflict(clauses: Column) -> Column:
    """True when two clauses ask one field for different values, so nothing can match."""
    fields = F.transform(clauses, lambda x: x["field"])
    return F.coalesce(F.size(F.array_distinct(fields)) < F.size(F.array_distinct(clauses)), F.lit(False))


def clauses_text(clauses: Column) -> Column:
    return F.array_join(F.transform(clauses, lambda x: F.concat(x["field"], F.lit("="), x["value"])), " & ")
