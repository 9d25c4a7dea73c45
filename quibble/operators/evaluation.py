"""Benchmark sampling, result assembly and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quibble.functions.answers import confidence_by_substring
from quibble.functions.rules import COMPLAINT_CATEGORIES, COMPLAINT_TYPES
from quibble.operators.numbering import number_rows

# Columns of the evaluation tables.
METRICS = ["retrieval_relevance", "answerability", "answer_correctness", "faithfulness"]
RESULT_ROW_COLUMNS = [
    "question_id", "question", "category", "complaint_type", *METRICS, "evidence_count",
    "confidence_raw", "error",
]
DETAIL_TEXTS = {
    "ground_truth_answer": "ground_truth_answer",
    "interpreted_intent": "pipeline_interpreted_intent",
    "retrieval_notes": "pipeline_retrieval_notes",
    "final_answer": "pipeline_answer",
    "verification": "pipeline_verification",
}
SAMPLE_COLUMNS = [
    "doc_id", "asin", "brand", "category", "complaint_type", "complaint_subtype", "title", "summary",
    "signal_score",
]
SAMPLE_SIZE = 15
LOW_CORRECTNESS = 0.7


def category_type_grid(spark: SparkSession) -> DataFrame:
    """Every (category, complaint type) pair of the fixed taxonomy."""
    one = spark.range(1).select(
        F.explode(F.lit(COMPLAINT_CATEGORIES)).alias("category"), F.lit(COMPLAINT_TYPES).alias("types")
    )
    return one.select("category", F.explode("types").alias("complaint_type"))


def sample_per_group(docs: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """The ``size`` highest scored documents of each category and type that have
    a summary and a title. Each task keeps its own ``size`` per group before the shuffle."""
    usable = docs.filter(
        F.col("category").isin(*COMPLAINT_CATEGORIES)
        & F.col("complaint_type").isin(*COMPLAINT_TYPES)
        & F.col("summary").isNotNull()
        & F.col("title").isNotNull()
    )
    w = Window.partitionBy("category", "complaint_type").orderBy(F.col("signal_score").desc(), "doc_id")
    ranked = usable.select(*SAMPLE_COLUMNS).withColumn("sample_rank", F.row_number().over(w))
    return ranked.filter(F.col("sample_rank") <= size)


def number_questions(questions: DataFrame, order: list[Column]) -> DataFrame:
    """Question ids ``q_1..q_n`` in ``order``."""
    numbered = number_rows(questions, order, "_n")
    return numbered.withColumn("question_id", F.concat(F.lit("q_"), F.col("_n"))).drop("_n")


def join_ids(ids: Column) -> Column:
    return F.array_join(ids, "|")


def split_ids(text: Column) -> Column:
    """Document ids of a bar-separated list; a ``doc_id_`` prefix is dropped."""
    return F.transform(F.split(text, r"\|"), lambda x: F.regexp_replace(x, "^doc_id_", "").try_cast("bigint"))


def eval_results(benchmark: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per benchmark question. Questions without a run, or whose run
    failed, keep null scores; ``runs`` has one row per question at most."""
    joined = benchmark.join(runs, "question_id", "left")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    ran = F.col("evidence_count").isNotNull() & ~failed
    return joined.select(
        "question_id",
        "question",
        "category",
        "complaint_type",
        *[F.when(ran, F.round(F.col(m), 3)).alias(m) for m in METRICS],
        F.when(failed, 0).otherwise(F.coalesce("evidence_count", F.lit(0))).cast("int").alias("evidence_count"),
        F.when(ran, confidence_by_substring(F.col("verification"))).otherwise("").alias("confidence_raw"),
        F.coalesce(
            "error", F.when(F.col("evidence_count").isNull(), "no run for this question").otherwise("")
        ).alias("error"),
    )


def eval_details(benchmark: DataFrame, runs: DataFrame) -> DataFrame:
    """Scores next to the texts they judge; texts a run lacks are blank."""
    scores = eval_results(benchmark, runs).select(
        "question_id", "question", "category", "complaint_type", *METRICS, "confidence_raw"
    )
    have = {c: df for df in (benchmark, runs) for c in df.columns if c in DETAIL_TEXTS}
    for df in (benchmark, runs):
        texts = [c for c, owner in have.items() if owner is df]
        if texts:
            scores = scores.join(df.select("question_id", *texts), "question_id", "left")
    return scores.select(
        *scores.columns[:9],
        *[
            (F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(shown)
            for c, shown in DETAIL_TEXTS.items()
        ],
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """Question counts and the average of each metric; nulls do not count."""
    scored = F.col("retrieval_relevance").isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(scored).alias("evaluated"),
        F.count_if(~scored).alias("failed"),
        *[F.round(F.avg(F.when(scored, F.col(m))), 3).alias(f"avg_{m}") for m in METRICS],
    )


def select_results(
    results: DataFrame,
    category: str | None = None,
    complaint_type: str | None = None,
    low_correctness: bool = False,
) -> DataFrame:
    """Result rows by choice; a correctness that is no number counts as low."""
    out = results
    if category:
        out = out.filter(F.col("category") == category)
    if complaint_type:
        out = out.filter(F.col("complaint_type") == complaint_type)
    if low_correctness:
        low = F.col("answer_correctness").try_cast("double") < LOW_CORRECTNESS
        out = out.filter(F.coalesce(low, F.lit(True)))
    return out
