"""Answer, verification and judge texts taken apart into columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section labels of an answer, confidence levels of a verification.
SECTION_LABELS = [
    "Issue Summary", "Likely Recurring Pattern", "Root Cause Hypothesis", "Business Impact",
    "Recommended Actions",
]
CONFIDENCE_LEVELS = ["High", "Medium", "Low"]


def strip(c: Column) -> Column:
    """Drop blanks of any kind from both ends. The look-behind keeps long runs of
    blanks inside the text from being tried at each of their positions."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+\z", "")


def section_column(label: str) -> str:
    return label.lower().replace(" ", "_")


def answer_sections(text: str) -> dict[str, Column]:
    """One column per label over a text column: the text up to the next label, null
    when absent. If a label occurs again, its last body counts."""
    sections = {}
    for label in SECTION_LABELS:
        body = f"substring_index({text}, '{label}:', -1)"
        for end in SECTION_LABELS:
            body = f"substring_index({body}, '{end}:', 1)"
        found = F.expr(f"CASE WHEN contains({text}, '{label}:') THEN {body} END")
        sections[section_column(label)] = strip(found)
    return sections


# The text format of answers and verifications. A heading is its name in any case, then
# colons, dashes or blanks. A section's heading ends with its line, and a line that begins with a capital
# and runs on in letters and blanks to a colon opens the next section. A stated level may stand on the
# line after its heading, behind one list mark.
HEADING_TAIL = r"[:\s\-]*"
NEXT_HEADING = r"\n[A-Z][a-zA-Z ]+:"
LIST_MARK = r"\n?[•\-\*]?\s*"
SCORE_FIELD = r'"score"\s*:\s*([0-9.]+)'


def _body_or_text(text: Column, label: str, end: str) -> Column:
    """The text between the first heading ``label`` and the first ``end`` behind it, the whole text without such a heading.

    Headings and ends are marked first, so that the body is what stands between two marks.
    """
    heading = rf"(?is){label}{HEADING_TAIL}\n"
    behind = F.element_at(F.split(text, heading, 2), 2)
    return strip(F.when(text.rlike(heading), F.element_at(F.split(behind, rf"(?is){end}", 2), 1)).otherwise(text))


def section_or_text(text: Column, label: str) -> Column:
    """Body of one section, up to the next capitalised heading; the whole text if there is none."""
    return _body_or_text(text, label, NEXT_HEADING)


def verification_body(text: Column) -> Column:
    return F.coalesce(_body_or_text(text, "Verification", r"Confidence[:\s\-]"), F.lit(""))


def confidence_level(text: Column) -> Column:
    """High, Medium or Low as stated after ``Confidence``, else blank."""
    levels = "|".join(CONFIDENCE_LEVELS)
    stated = F.regexp_extract(text, rf"(?i)Confidence{HEADING_TAIL}{LIST_MARK}({levels})", 1)
    return F.coalesce(F.initcap(stated), F.lit(""))


def confidence_by_substring(text: Column) -> Column:
    """First level whose name occurs anywhere, also inside words such as ``highlights``."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.contains(level.lower()), level) for level in CONFIDENCE_LEVELS], F.lit(""))


def judge_score(text: Column) -> Column:
    """``score`` of a JSON object, else the first ``"score": n`` in the text, else 0."""
    t = strip(text)
    value = F.get_json_object(t, "$.score")
    is_object = t.startswith("{") & F.get_json_object(t, "$").isNotNull()
    stated = F.when(value == "true", 1.0).otherwise(value.try_cast("double"))
    found = F.regexp_extract(t, SCORE_FIELD, 1).try_cast("double")
    return F.coalesce(stated, F.when(~is_object, found), F.lit(0.0))


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def answerable(score: Column) -> Column:
    return F.when(score >= 0.5, 1.0).otherwise(0.0)
