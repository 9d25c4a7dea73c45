from pyspark.sql import functions as F

from quibble.operators import evaluation, evidence

# Published scores of ten questions: relevance, answerability, correctness, faithfulness.
PUBLISHED = [
    (0.9, 1.0, 0.85, 0.8), (0.9, 1.0, 0.85, 0.8), (0.9, 1.0, 0.85, 0.8), (1.0, 1.0, 0.85, 0.8), (1.0, 1.0, 0.95, 0.8),
    (1.0, 1.0, 0.85, 0.9), (1.0, 1.0, 0.85, 0.9), (0.8, 1.0, 0.93, 0.8), (0.9, 1.0, 0.72, 0.8), (1.0, 1.0, 0.93, 0.8),
]


def test_published_summary(spark):
    df = spark.createDataFrame(PUBLISHED, ", ".join(f"{m} double" for m in evaluation.METRICS))
    assert evaluation.eval_summary(df).first()[:] == (10, 10, 0, 0.94, 1.0, 0.863, 0.82)


def test_results_keep_every_question(spark):
    benchmark = spark.createDataFrame(
        [("q1", "a?", "electronics", "wrong_item", "truth"), ("q2", "b?", "Any", "Any", "t"), ("q3", "c?", "x", "y", "t")],
        "question_id string, question string, category string, complaint_type string, ground_truth_answer string",
    )
    runs = spark.createDataFrame(
        [("q1", 0.98765, 1.0, 0.5, 0.25, 10, "all highlights", None, "answer"), ("q2", 0.5, 1.0, 0.5, 0.5, 7, "", "boom", "x")],
        "question_id string, retrieval_relevance double, answerability double, answer_correctness double,"
        " faithfulness double, evidence_count int, verification string, error string, final_answer string",
    )
    out = evaluation.eval_results(benchmark, runs)
    assert out.columns == evaluation.RESULT_ROW_COLUMNS
    got = {r.question_id: r for r in out.collect()}
    assert (got["q1"].retrieval_relevance, got["q1"].confidence_raw, got["q1"].error, got["q1"].evidence_count) == (0.988, "High", "", 10)
    assert (got["q2"].faithfulness, got["q2"].error, got["q2"].evidence_count) == (None, "boom", 0)
    assert got["q3"].retrieval_relevance is None and got["q3"].error
    assert evaluation.eval_summary(out).first()[:3] == (3, 1, 2)
    details = {r.question_id: r for r in evaluation.eval_details(benchmark, runs).collect()}
    assert details["q1"].pipeline_answer == "answer" and details["q1"].ground_truth_answer == "truth"
    assert details["q3"].pipeline_answer == "" and details["q1"].pipeline_retrieval_notes == ""


def test_low_correctness_keeps_what_is_no_number(spark):
    df = spark.createDataFrame(
        [("a", "e", "0.69"), ("b", "e", "0.7"), ("c", "e", ""), ("d", "e", None), ("f", "h", "0.1")],
        "question_id string, category string, answer_correctness string",
    )
    got = [r.question_id for r in evaluation.select_results(df, "e", low_correctness=True).orderBy("question_id").collect()]
    assert got == ["a", "c", "d"]


def test_sample_and_grid(spark):
    rows = [(i, "electronics", "wrong_item", "s" if i % 5 else None, 3 + i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, category string, complaint_type string, summary string, signal_score int")
    df = df.withColumns({c: F.lit("x") for c in ("asin", "brand", "complaint_subtype", "title")})
    got = [r.doc_id for r in evaluation.sample_per_group(df, 15).orderBy("sample_rank").collect()]
    assert got == [i for i in range(1, 100, 2) if i % 5][:15]
    grid = evaluation.category_type_grid(spark)
    assert grid.distinct().count() == grid.count() == 10


def test_ids(spark):
    df = spark.createDataFrame([("doc_id_385292|513588|x",)], "t string")
    assert df.select(evaluation.split_ids(F.col("t")).alias("v")).first().v == [385292, 513588, None]
    assert df.select(evaluation.join_ids(F.array(F.lit("1"), F.lit("2"))).alias("v")).first().v == "1|2"


def found(spark):
    rows = [
        (1, 2, 20, "T2", "B", "electronics", "wrong_item", None, None, 3, None),
        (1, 1, 10, "T1", "B", "electronics", "damage_defect", "hard_defect", "s" * 150, 4, None),
        (1, 3, 30, None, None, "home_kitchen", "wrong_item", "w", "z", 3, None),
        (2, 1, 40, "T", "B", "electronics", "quality_issue", "q", "y", 3, None),
    ]
    return spark.createDataFrame(
        rows,
        "query_id int, rank int, doc_id bigint, title string, brand string, category string, complaint_type string,"
        " complaint_subtype string, summary string, signal_score int, review_date date",
    )


def test_contexts(spark):
    out = {r.query_id: r for r in evidence.evidence_context(found(spark), list(evidence.CONTEXT_LAYOUTS)).collect()}
    block = "Complaint {}:\nProduct: {}\nBrand: {}\nCategory: {}\nComplaint Type: {}\nComplaint Subtype: {}\nSummary: {}\n"
    assert out[1].reasoning == "\n".join(
        [
            block.format(1, "T1", "B", "electronics", "damage_defect", "hard_defect", "s" * 150),
            block.format(2, "T2", "B", "electronics", "wrong_item", "", ""),
            block.format(3, "", "", "home_kitchen", "wrong_item", "w", "z"),
        ]
    )
    assert out[2].relevance == (
        "  Complaint 1: category=electronics, complaint_type=quality_issue, subtype=q, brand=B, signal_score=3, summary=y"
    )
    assert out[1].faithfulness.split("\n")[0] == "  [1] complaint_type=damage_defect | subtype=hard_defect | summary=" + "s" * 100
    assert out[2]["sample"] == "doc_id: 40\ntitle: T\nbrand: B\ncomplaint_type: quality_issue\nsubtype: q\nsummary: y"
    assert out[2].detailed.endswith("Signal Score: 3\nReview Date: \n")


def test_counts_and_summaries(spark):
    df = found(spark)
    assert {r.query_id: r.evidence_count for r in evidence.evidence_count(df).collect()} == {1: 3, 2: 1}
    top = {r.query_id: r[1:] for r in evidence.dominant_type(df).collect()}
    assert top == {1: ("wrong_item", 2, 3), 2: ("quality_issue", 1, 1)}
    texts = {r.query_id: r.evidence_summary for r in evidence.evidence_summary(df, 2).collect()}
    assert texts == {1: "damage_defect(hard_defect); wrong_item()", 2: "quality_issue(q)"}
    first = evidence.evidence_preview(df).filter("query_id = 1 AND rank = 2").first()
    assert (first.summary, first.title) == ("", "T2")
    assert df.select(evidence.answer_excerpt(F.lit("  " + "x" * 900))).first()[0] == "x" * 800
