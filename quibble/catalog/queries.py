"""Every query by name: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quibble.catalog.fixtures import fixture, table
from quibble.functions import answers, filters, rules
from quibble.functions.text import brand_case, clean_text, flag, pin, unescape_html
from quibble.operators import checks, dashboard, evaluation, evidence, quality, retrieval, search_index, vector_index
from quibble.operators.clean import clean_meta, clean_reviews, with_issue_flags
from quibble.operators.complaints import SIGNAL_COLUMNS, category_medians, complaint_candidates
from quibble.operators.enrich import enrich_reviews, heavy_hitters, hot_keys, product_health_daily
from quibble.operators.keyword_index import tokens
from quibble.operators.latest import latest_per_key
from quibble.plans import pipeline
from quibble.sources import csv_files, jsonl, landing, schemas, tables
from quibble.sources.staging import delete_unread, new_folder, run_folder, scope, stage
from quibble.sources.versions import delete
from quibble.streaming import ledger, loader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_table")] = f
    return f


# --- layers the queries start from ---------------------------------------------------


def _reviews(spark, sf):
    return clean_reviews(fixture(spark, sf, "reviews_raw"))


def _meta(spark, sf):
    return clean_meta(fixture(spark, sf, "meta_raw"))


def _inputs(spark, sf):
    """Clean reviews, clean products, and the products with very many reviews."""
    raw = fixture(spark, sf, "reviews_raw")
    return clean_reviews(raw), _meta(spark, sf), hot_keys(raw, "asin")


def _enriched(spark, sf):
    return enrich_reviews(*_inputs(spark, sf))


def _staged_layers(spark, sf):
    """Clean reviews, clean products and what is built from both, each clean table written once."""
    raw = fixture(spark, sf, "reviews_raw")
    reviews, meta = stage(clean_reviews(raw), "reviews"), stage(_meta(spark, sf), "meta")
    enriched = enrich_reviews(reviews, meta, hot_keys(reviews, "asin"))
    health = product_health_daily(reviews, meta)
    return {"clean_reviews": reviews, "clean_meta": meta, "review_enriched": enriched, "product_health_daily": health}


def _gated(spark, sf):
    return pipeline.gated_candidates(*_inputs(spark, sf))


def _confident(spark, sf):
    return pipeline.confident_complaints(*_inputs(spark, sf))


def _complaints(spark, sf):
    return pipeline.complaint_layer(*_inputs(spark, sf))


def _documents(spark, sf):
    return pipeline.document_layer(_complaints(spark, sf))


def _reports(spark, sf):
    return pipeline.dashboard_layer(_complaints(spark, sf))


def _searchable(spark, sf):
    """Published documents with the vector of the text they came from."""
    vectors = table(spark, sf, "embeddings").select(
        F.concat(F.lit("R"), F.col("vec_id").cast("string")).alias("reviewer_id"), "embedding"
    )
    return _documents(spark, sf).join(vectors, "reviewer_id", "left")


def _label_centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))


def _evidence(spark, sf):
    docs = _searchable(spark, sf)
    queries = _label_centroids(spark, sf).withColumnRenamed("label", "query_id")
    found = retrieval.batch_semantic_topk(docs, queries, k=10)
    return retrieval.with_documents(found, docs)


# --- text and rules ------------------------------------------------------------------


@query
def clean_text_documents(spark, sf):
    cleaned = pin(table(spark, sf, "documents"), "text_clean", clean_text(F.col("text")))
    return cleaned.select("doc_id", "text_clean", F.length("text_clean").alias("text_length"))


@query
def clean_text_pages(spark, sf):
    cleaned = pin(table(spark, sf, "pages"), "text_clean", clean_text(F.col("html")))
    return cleaned.select("page_id", "text_clean", F.length("text_clean").alias("text_length"))


def _flagged(spark, sf):
    raw = fixture(spark, sf, "reviews_raw")
    lowered = pin(raw.select("reviewerID", "reviewText"), "lc", F.lower(clean_text(F.col("reviewText"))))
    return with_issue_flags(lowered, "lc").withColumn("has_seller_fulfillment_noise", flag(rules.seller_noise("lc")))


@query
def issue_flags(spark, sf):
    return _flagged(spark, sf).select(
        "reviewerID", *[rules.type_flag_name(t) for t in rules.COMPLAINT_TYPES], "has_seller_fulfillment_noise"
    )


@query
def complaint_type(spark, sf):
    return _flagged(spark, sf).select("reviewerID", "issue_hint_keywords", "complaint_type_candidate")


# --- clean and curated tables --------------------------------------------------------


@query
def clean_reviews_table(spark, sf):
    return _reviews(spark, sf)


@query
def clean_meta_table(spark, sf):
    return _meta(spark, sf)


@query
def review_enriched(spark, sf):
    return _enriched(spark, sf)


@query
def metadata_coverage(spark, sf):
    return checks.metadata_coverage(_enriched(spark, sf))


@query
def coverage_by_category(spark, sf):
    return checks.coverage_by_category(_enriched(spark, sf))


@query
def product_health_daily_table(spark, sf):
    return product_health_daily(_reviews(spark, sf), _meta(spark, sf))


@query
def rate_range_check(spark, sf):
    return checks.rate_range_check(product_health_daily_table(spark, sf))


@query
def complaint_subtype(spark, sf):
    return _gated(spark, sf).select("reviewer_id", "complaint_type_candidate", "complaint_subtype")


@query
def domain_match(spark, sf):
    return _gated(spark, sf).select(
        "reviewer_id", "category", "main_cat", "operational_complaint_flag", "metadata_domain_match_flag"
    )


@query
def narrative_noise(spark, sf):
    search = _gated(spark, sf).select("reviewer_id", "review_text_clean", "narrative_content_noise_flag")
    full = rules.narrative_noise("lower(review_text_clean)", "full")
    return search.select("reviewer_id", "narrative_content_noise_flag", full.alias("full_match_flag"))


@query
def category_median(spark, sf):
    return category_medians(_confident(spark, sf))


@query
def signal_score(spark, sf):
    scored = pipeline.scored_complaints(_confident(spark, sf))
    return scored.select("reviewer_id", "category", *SIGNAL_COLUMNS, "signal_score")


@query
def scored_complaints(spark, sf):
    return _complaints(spark, sf).drop(pipeline.ROW_KEY)


@query
def review_documents(spark, sf):
    return _documents(spark, sf)


# --- dashboard -----------------------------------------------------------------------


@query
def overview(spark, sf):
    return dashboard.overview(_reports(spark, sf))


@query
def type_distribution(spark, sf):
    return dashboard.type_distribution(_reports(spark, sf))


@query
def type_distribution_by_category(spark, sf):
    return dashboard.type_distribution(_reports(spark, sf), "electronics")


@query
def category_distribution(spark, sf):
    return dashboard.category_distribution(_reports(spark, sf))


@query
def top_brands(spark, sf):
    return dashboard.top_brands(_reports(spark, sf))


@query
def subtype_distribution(spark, sf):
    return dashboard.subtype_distribution(_reports(spark, sf))


@query
def top_products(spark, sf):
    return dashboard.top_products(_reports(spark, sf), "home_kitchen", "Any")


def _search(spark, sf):
    return dashboard.complaint_search(_reports(spark, sf), brand="Brand", product="b", limit=50)


@query
def complaint_search(spark, sf):
    return _search(spark, sf)


@query
def complaint_search_display(spark, sf):
    return dashboard.for_display(_search(spark, sf))


@query
def search_breakdown(spark, sf):
    return dashboard.search_breakdown(_search(spark, sf))


@query
def monthly_trend(spark, sf):
    return dashboard.monthly_trend(_reports(spark, sf))


# --- windows -------------------------------------------------------------------------


@query
def latest_record_per_key(spark, sf):
    orders = table(spark, sf, "orders")
    return latest_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query
def latest_event_per_user(spark, sf):
    events = table(spark, sf, "events")
    return latest_per_key(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@query
def sample_per_group(spark, sf):
    return evaluation.sample_per_group(_documents(spark, sf))


@query
def number_questions(spark, sf):
    questions = fixture(spark, sf, "questions").select("conv_id", "turn", "question")
    return evaluation.number_questions(questions, [F.col("conv_id"), F.col("turn")])


# --- checks --------------------------------------------------------------------------


@query
def partition_sanity(spark, sf):
    return checks.partition_sanity(fixture(spark, sf, "reviews_raw"))


@query
def null_keys(spark, sf):
    return checks.null_keys(fixture(spark, sf, "reviews_raw"), "summary")


@query
def rating_distribution(spark, sf):
    return checks.rating_distribution(fixture(spark, sf, "reviews_raw"))


@query
def join_coverage(spark, sf):
    return checks.join_coverage(fixture(spark, sf, "reviews_raw"), fixture(spark, sf, "meta_raw"))


@query
def join_coverage_distinct(spark, sf):
    return checks.join_coverage(fixture(spark, sf, "reviews_raw"), fixture(spark, sf, "meta_raw"), True)


@query
def length_profile(spark, sf):
    return checks.length_profile(fixture(spark, sf, "reviews_raw"))


@query
def layer_counts(spark, sf):
    raw = {name: fixture(spark, sf, name) for name in ("reviews_raw", "meta_raw")}
    return checks.layer_counts({**raw, **_staged_layers(spark, sf)})


@query
def total_counts(spark, sf):
    return checks.layer_counts({t: table(spark, sf, t) for t in ("documents", "part", "orders", "customer", "events")})


@query
def oversized_sources(spark, sf):
    files = fixture(spark, sf, "reviews_raw")
    return checks.oversized_sources(files, rows=200)


@query
def dedup_check(spark, sf):
    return checks.dedup_check(fixture(spark, sf, "meta_raw"))


@query
def blank_documents(spark, sf):
    return checks.blank_documents(_reports(spark, sf))


@query
def newest_rows(spark, sf):
    raw = fixture(spark, sf, "reviews_raw").select("asin", "reviewerID", "overall", "category", "load_ts")
    return checks.newest_rows(raw, 10, "reviewerID")


# --- quality rules -------------------------------------------------------------------


@query
def not_null_rules(spark, sf):
    return quality.check_table(
        fixture(spark, sf, "reviews_raw"), "reviews_raw", ["asin", "overall", "summary", "verified", "category"]
    )


@query
def unique_rules(spark, sf):
    lines = quality.check_table(table(spark, sf, "lineitem"), "lineitem", unique_columns=["l_orderkey"])
    orders = quality.check_table(table(spark, sf, "orders"), "orders", unique_columns=["o_orderkey", "o_custkey"])
    return lines.unionByName(orders)


@query
def accepted_values_rules(spark, sf):
    return quality.check_table(
        table(spark, sf, "orders"),
        "orders",
        accepted={"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]},
    )


@query
def layer_rules(spark, sf):
    layers = _staged_layers(spark, sf)
    reviews, meta = layers["clean_reviews"], layers["clean_meta"]
    candidates = complaint_candidates(reviews)  # what is joined decides which keys are hot
    complaints = stage(pipeline.complaint_layer(reviews, meta, hot_keys(candidates, "asin")), "complaints")
    documents = stage(pipeline.document_layer(complaints), "documents")
    return quality.check_layers({**layers, "review_enriched_complaints": complaints, "review_documents": documents})


# --- retrieval and evidence ----------------------------------------------------------


@query
def semantic_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    return retrieval.semantic_topk(vectors, first, k=10, doc_id="vec_id")


@query
def semantic_topk_filtered(spark, sf):
    vectors = table(spark, sf, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    wanted = {
        "@and": [
            {"@eq": {"category": "electronics"}},
            {"@gte": {"signal_score": 3}},
            {"@gte": {"review_date": "2017-01-01"}},
            {"@lte": {"review_date": "2018-12-31"}},
        ]
    }
    found = retrieval.semantic_topk(_searchable(spark, sf), first, k=10, filters=wanted)
    return found.select(*retrieval.RESULT_COLUMNS, "score")


@query
def batch_semantic_topk(spark, sf):
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = _label_centroids(spark, sf).withColumnRenamed("label", "query_id")
    return retrieval.batch_semantic_topk(docs, queries, k=5)


@query
def batch_semantic_topk_filtered(spark, sf):
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    queries = _label_centroids(spark, sf).withColumn("query_id", F.col("label"))
    return retrieval.batch_semantic_topk(docs, queries, k=5, filter_by=["label"])


def _vector_index(spark, sf):
    """The index of the vectors, and every fiftieth of them as a query."""
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    index = vector_index.build_vector_index(docs)
    return index, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@query
def indexed_semantic_topk(spark, sf):
    """Exact search by cells: those that can't reach a query's k-th score are left out."""
    index, queries = _vector_index(spark, sf)
    return vector_index.search_vectors(index, queries, k=10)


@query
def vector_index_recall(spark, sf):
    """Five sixths of the cells a query (the vectors form no clusters): how many queries, and whether recall against the exact search is 0.9 on average."""
    index, queries = _vector_index(spark, sf)
    found = vector_index.search_vectors(index, queries, 10, probes=-(-index.cells * 5 // 6))
    per_query = vector_index.recall(found, vector_index.search_vectors(index, queries, 10))
    return per_query.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


@query
def hot_products(spark, sf):
    """Products of more than 30 reviews with exact counts, from frequent-item summaries of 64 counters a task."""
    hot = heavy_hitters(fixture(spark, sf, "reviews_raw"), "asin", 30, counters=64)
    return hot.select(F.col("key").alias("asin"), F.col("n").alias("reviews"), F.ceil(F.col("n") / 30).cast("int").alias("salts"))


@query
def keyword_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    queries = fixture(spark, sf, "search_questions").select("query_id", "query")
    return retrieval.keyword_topk(docs, queries, k=10, text="text")


# The five retrieval scenarios (query text, filter).
SCENARIOS = [
    ("memory card not recognized camera compatibility issue", None),
    ("item arrived broken stopped working after few days", {"@eq": {"category": "electronics"}}),
    ("package late never arrived delivery delay", {"@eq": {"complaint_subtype": "late_delivery"}}),
    (
        "missing charger cable adapter not included",
        {
            "@and": [
                {"@eq": {"category": "electronics"}},
                {"@eq": {"complaint_subtype": "accessory_missing"}},
                {"@gte": {"signal_score": 3}},
            ]
        },
    ),
    (
        "wrong item received different product shipped",
        {
            "@and": [
                {"@eq": {"complaint_type": "wrong_item"}},
                {"@gte": {"review_date": "2017-01-01"}},
                {"@lte": {"review_date": "2018-12-31"}},
            ]
        },
    ),
]


@query
def keyword_topk_filtered(spark, sf):
    """Each question among the documents of its language: the statistics stay those of all documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (F.col("query_id") % 4 + 1).cast("int"))
    queries = fixture(spark, sf, "search_questions").select("query_id", "query", F.when(F.col("query_id") % 5 > 0, lang).alias("lang"))
    return retrieval.keyword_topk(docs, queries, k=10, text="text", filter_by=["lang"])


@query
def retrieval_scenarios(spark, sf):
    """All five scenarios in one call; their filters travel with them."""
    docs = stage(_documents(spark, sf), "documents")
    rows = [(i, text, filters.filter_clauses(wanted)) for i, (text, wanted) in enumerate(SCENARIOS, 1)]
    asked = spark.createDataFrame(rows, f"query_id int, query string, wanted {retrieval.CLAUSES}")
    fields = ["category", "complaint_type", "complaint_subtype", "signal_score", "review_date"]
    found = retrieval.keyword_topk(docs.select("doc_id", "retrieval_text", *fields), asked, k=5, clauses="wanted")
    shown = retrieval.with_documents(found, docs)
    return shown.select(F.col("query_id").alias("scenario"), *retrieval.RESULT_COLUMNS, "score")


@query
def question_evidence(spark, sf):
    """Questions to filters to search to context: selections win over what the question's words call for."""
    docs = stage(_documents(spark, sf), "documents")
    asked = fixture(spark, sf, "search_questions")
    given = filters.selection_clauses(F.col("category"), F.col("complaint_type"))
    wanted = filters.with_operator(filters.resolve_clauses(given, filters.text_clauses("query")))
    asked = asked.select("query_id", "query", wanted.alias("wanted"))
    searched = docs.select("doc_id", "retrieval_text", "category", "complaint_type")
    found = retrieval.with_documents(retrieval.keyword_topk(searched, asked, k=5, clauses="wanted"), docs)
    return found.select("query_id", "doc_id", "category", "complaint_type", "score", "rank")


@query
def query_filters(spark, sf):
    asked = fixture(spark, sf, "search_questions")
    given = filters.selection_clauses(F.col("category"), F.col("complaint_type"))
    derived = filters.text_clauses("query")
    resolved = filters.resolve_clauses(given, derived)
    return asked.select(
        "query_id",
        filters.clauses_text(given).alias("given"),
        filters.clauses_text(derived).alias("derived"),
        filters.clauses_text(resolved).alias("resolved"),
        filters.clauses_conflict(resolved).alias("conflict"),
    )


@query
def evidence_preview(spark, sf):
    return evidence.evidence_preview(_evidence(spark, sf))


@query
def evidence_context(spark, sf):
    return evidence.evidence_context(_evidence(spark, sf), list(evidence.CONTEXT_LAYOUTS))


@query
def evidence_count(spark, sf):
    return evidence.evidence_count(_evidence(spark, sf))


@query
def dominant_type(spark, sf):
    return evidence.dominant_type(_evidence(spark, sf))


@query
def evidence_summary(spark, sf):
    return evidence.evidence_summary(_evidence(spark, sf))


# --- answers and evaluation ----------------------------------------------------------


@query
def answer_sections(spark, sf):
    return fixture(spark, sf, "answers").select(
        "conv_id",
        "turn",
        *[c.alias(n) for n, c in answers.answer_sections("answer").items()],
        answers.section_or_text(F.col("answer"), "Issue Summary").alias("issue_or_text"),
        answers.section_or_text(F.col("answer"), "Recommended Actions").alias("actions_or_text"),
        evidence.answer_excerpt(F.col("answer")).alias("excerpt"),
    )


@query
def verification_parse(spark, sf):
    return fixture(spark, sf, "answers").select(
        "conv_id",
        "turn",
        answers.verification_body(F.col("verification")).alias("body"),
        answers.confidence_level(F.col("verification")).alias("confidence"),
    )


@query
def confidence_label(spark, sf):
    return fixture(spark, sf, "answers").select(
        "conv_id", "turn", answers.confidence_by_substring(F.col("verification")).alias("confidence")
    )


@query
def score_extract(spark, sf):
    score = answers.judge_score(F.col("judge_text"))
    return fixture(spark, sf, "answers").select(
        "conv_id",
        "turn",
        score.alias("score"),
        F.round(answers.clamp_score(score), 3).alias("clamped"),
        answers.answerable(score).alias("answerability"),
    )


def _runs(spark, sf):
    score = answers.judge_score(F.col("judge_text"))
    return fixture(spark, sf, "answers").select(
        F.concat_ws("_", "conv_id", F.col("turn") - 1).alias("question_id"),
        answers.clamp_score(score).alias("retrieval_relevance"),
        answers.answerable(score).alias("answerability"),
        answers.clamp_score(score * 0.75).alias("answer_correctness"),
        answers.clamp_score(score / 3).alias("faithfulness"),
        (F.col("turn") % 11).cast("int").alias("evidence_count"),
        F.col("answer").alias("final_answer"),
        "verification",
        F.when(F.col("conv_id") % 10 == 9, "pipeline failed").alias("error"),
    )


def _results(spark, sf):
    benchmark = fixture(spark, sf, "questions").withColumnRenamed("question_key", "question_id")
    return evaluation.eval_results(benchmark, _runs(spark, sf))


@query
def eval_results(spark, sf):
    return _results(spark, sf)


@query
def eval_summary(spark, sf):
    return evaluation.eval_summary(_results(spark, sf))


@query
def eval_details(spark, sf):
    benchmark = fixture(spark, sf, "questions").withColumnRenamed("question_key", "question_id")
    return evaluation.eval_details(benchmark.withColumn("ground_truth_answer", F.concat(F.lit("truth: "), "question")), _runs(spark, sf))


@query
def low_correctness(spark, sf):
    return evaluation.select_results(_results(spark, sf), "electronics", low_correctness=True).select(
        "question_id", "complaint_type", "answer_correctness"
    )


@query
def grid_counts(spark, sf):
    per_pair = _reports(spark, sf).groupBy("category", "complaint_type").agg(F.count(F.lit(1)).alias("n"))
    grid = evaluation.category_type_grid(spark)
    return grid.join(per_pair, ["category", "complaint_type"], "left").select(
        "category", "complaint_type", F.coalesce("n", F.lit(0)).alias("documents")
    )


@query
def id_lists(spark, sf):
    """All turns of each conversation as one list and back; a conversation is a bounded group."""
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    joined = evaluation.join_ids(F.transform("turns", lambda t: F.concat(F.lit("doc_id_"), t.cast("string"))))
    back = evaluation.split_ids(F.col("ids"))
    return lists.withColumn("ids", joined).select(
        "conv_id", "ids", F.size(back).alias("n_ids"), F.get(back, F.lit(0)).alias("first_id"), F.element_at(back, -1).alias("last_id")
    )


# --- sources, sinks, loads -----------------------------------------------------------


@query
def incremental_load(spark, sf):
    """Two loads, the second with nothing to do, and a third after a file with an old date has come."""
    events = table(spark, sf, "events")
    landed, root = new_folder(spark, "landing"), new_folder(spark, "raw")
    late = F.col("event_id") % 10 == 0
    events.where(~late).write.parquet(f"{landed}/first")
    for _ in range(2):
        ledger.load_changes(spark, landed, _ddl(events), root, "raw.events", ["event_type"])
    events.where(late).write.parquet(f"{landed}/late")
    _set_modified(spark, f"{landed}/late", 1_500_000_000)
    ledger.load_changes(spark, landed, _ddl(events), root, "raw.events", ["event_type"])
    return ledger.current_rows(spark, root, _ddl(events)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows_loaded"), F.countDistinct("event_id").alias("distinct_events")
    )


def _set_modified(spark, folder, seconds):
    for f in landing.list_files(spark, folder, "*.parquet").collect():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(path, seconds * 1000, -1)


def _rewrite_file(df, folder):
    """The folder's one file, under its old name, with other rows."""
    spark, other = df.sparkSession, new_folder(df.sparkSession, "rewritten")
    df.write.parquet(other)
    new, old = (landing.list_files(spark, f, "*.parquet").first().path for f in (other, folder))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(old), False)
    fs.rename(hadoop.Path(new), hadoop.Path(old))


@query
def changed_files_load(spark, sf):
    """Orders in five folders: between two loads one is rewritten, one removed, one comes late with an old
    date, one only gets another date. What the second load did to each, and the rows there are then."""
    orders = table(spark, sf, "orders").withColumn("part", (F.col("o_orderkey") % 5).cast("int"))
    landed, root = new_folder(spark, "landing"), new_folder(spark, "raw")
    part = lambda i: orders.where(F.col("part") == i).coalesce(1)
    for i in range(4):
        part(i).write.parquet(f"{landed}/{i}")
    schema = _ddl(orders)
    ledger.load_changes(spark, landed, schema, root, "raw.orders", ["o_orderstatus"])
    _rewrite_file(part(1).withColumn("o_totalprice", F.col("o_totalprice") * 2), f"{landed}/1")
    delete(spark, f"{landed}/2")
    _set_modified(spark, f"{landed}/3", 1_600_000_000)
    part(4).write.parquet(f"{landed}/4")
    _set_modified(spark, f"{landed}/4", 1_500_000_000)
    ledger.load_changes(spark, landed, schema, root, "raw.orders", ["o_orderstatus"])
    done = ledger.history(spark, root).where("load_no = 2")
    done = done.select(F.regexp_extract("source_file", "/([0-9])/[^/]*$", 1).cast("int").alias("part"), "change", "row_count")
    changes = done.groupBy("part").agg(F.array_join(F.sort_array(F.collect_set("change")), "+").alias("changes"), F.sum("row_count").alias("rows_loaded"))
    rows = ledger.current_rows(spark, root, schema).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price")
    )
    return rows.join(changes, "part", "full").select("part", "changes", "rows_loaded", "rows", "orders", "total_price")


@query
def load_audit(spark, sf):
    """Orders land in files of three kinds, and one that is no Parquet; the audit row goes to its table."""
    orders = table(spark, sf, "orders")
    landed, root = new_folder(spark, "landing"), new_folder(spark, "raw")
    as_text = orders.filter("o_orderkey % 3 = 1").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    wide = orders.filter("o_orderkey % 3 = 2").withColumn("o_orderkey", F.col("o_orderkey").cast("decimal(20,0)"))
    for kind, part in (("own", orders.filter("o_orderkey % 3 = 0")), ("text", as_text), ("wide", wide)):
        part.write.parquet(f"{landed}/{kind}")
    spark.range(1).selectExpr("'no parquet' AS value").coalesce(1).write.text(f"{landed}/broken")
    files = landing.list_files(spark, f"{landed}/broken").collect()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for i, f in enumerate(files):
        path = hadoop.Path(f.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, hadoop.Path(f"{landed}/broken-{i}.parquet"))
    ledger.load_changes(spark, landed, _ddl(orders), root, "raw.orders", ["o_orderstatus"])
    done = ledger.history(spark, root)
    prices = ledger.current_rows(spark, root, _ddl(orders)).agg(F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    failed = done.where("first_error IS NOT NULL").agg(
        F.max(F.regexp_extract("source_file", "[^/]+$", 0)).alias("failed_file"), F.max(F.substring_index("first_error", ":", 1)).alias("error_kind")
    )
    with tables.temporary_schema(spark, "raw") as schema:
        tables.create_raw_tables(spark, schema)
        ledger.insert_audit(loader.load_audit(done, "raw.orders", F.current_timestamp()), f"{schema}.load_audit")
        kept = spark.table(f"{schema}.load_audit")
        has_error = F.col("first_error").isNotNull().alias("has_error")
        return stage(kept.select("target_table", "rows_loaded", has_error).join(prices).join(failed), "result")


def _ddl(df):
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


@query
def json_lines_roundtrip(spark, sf):
    raw = fixture(spark, sf, "reviews_raw").select(*schemas.REVIEW_JSON_FIELDS)
    lines = raw.select(F.to_json(F.struct("*")).alias("value"))
    # Every line again cut short, which is no JSON, and a blank one.
    broken = lines.select(F.expr("left(value, length(value) - 1)").alias("value")).unionByName(
        lines.select(F.lit(" ").alias("value"))
    )
    folder = new_folder(spark, "json")
    lines.unionByName(broken).write.option("compression", "gzip").text(folder)
    return jsonl.read_reviews(spark, folder, "electronics", "2026-01-01", tasks=spark.sparkContext.defaultParallelism)


@query
def parquet_landing(spark, sf):
    folder = new_folder(spark, "landing")
    landing.write_landing(fixture(spark, sf, "reviews_raw").drop("source_file", "load_ts"), folder)
    loaded = landing.load_landing(spark, folder, schemas.REVIEWS_LANDING)
    lineage = loaded.filter(F.col("source_file").isNotNull() & F.col("load_ts").isNotNull())
    return lineage.drop("source_file", "load_ts")


@query
def ingest_metrics(spark, sf):
    folder = new_folder(spark, "landing")
    landing.write_landing(fixture(spark, sf, "reviews_raw").drop("source_file", "load_ts"), folder)
    return landing.ingest_metrics(spark, folder)


@query
def source_manifest(spark, sf):
    folder = new_folder(spark, "files")
    documents = table(spark, sf, "documents").select("source", "text")
    documents.write.partitionBy("source").parquet(folder)
    files = landing.source_manifest(spark, folder, "*.parquet")
    # Spark's own reader and digest are the yardstick for sizes and checksums.
    direct = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    direct = direct.select(path, F.col("length").alias("own_bytes"), F.md5("content").alias("own_md5"))
    source = F.regexp_extract("path", "source=([^/]+)", 1).alias("source")
    return files.withColumn("path", path).join(direct, "path", "full").groupBy(source).agg(
        F.bool_and(F.col("bytes").eqNullSafe(F.col("own_bytes"))).alias("sizes_agree"),
        F.bool_and(F.col("md5_hex").eqNullSafe(F.col("own_md5"))).alias("checksums_agree"),
    )


@query
def csv_roundtrip(spark, sf):
    folder = new_folder(spark, "csv")
    asked = fixture(spark, sf, "questions").select("question_key", "question", "category")
    csv_files.write_csv(asked, folder)
    return csv_files.read_csv(spark, folder, "question_key string, question string, category string")


@query
def drop_category(spark, sf):
    with tables.temporary_schema(spark, "raw") as schema:
        tables.create_raw_tables(spark, schema)
        tables.append_rows(fixture(spark, sf, "reviews_raw"), f"{schema}.reviews_raw")
        tables.drop_category(spark, f"{schema}.reviews_raw", "dev")
        return stage(checks.partition_sanity(spark.table(f"{schema}.reviews_raw")), "result")


@query
def full_reload(spark, sf):
    """A table with two loads of the reviews, reloaded with those of one category: nothing else is left."""
    reviews = fixture(spark, sf, "reviews_raw")
    with tables.temporary_schema(spark, "raw") as schema:
        tables.create_raw_tables(spark, schema)
        for _ in range(2):
            tables.append_rows(reviews, f"{schema}.reviews_raw")
        tables.reload_table(reviews.filter("category = 'electronics'"), f"{schema}.reviews_raw")
        return stage(spark.table(f"{schema}.reviews_raw").select("reviewerID", "category", "ingest_dt", "overall"), "result")


@query
def model_refresh(spark, sf):
    """A model table saved twice holds the second version alone."""
    meta = _meta(spark, sf).select("asin", "title", "brand", "price")
    with tables.temporary_schema(spark, "model") as schema:
        tables.save_model(meta.limit(5), "clean_meta", schema)
        name = tables.save_model(meta, "clean_meta", schema)
        return stage(spark.table(name), "result")


@query
def meta_json_roundtrip(spark, sf):
    raw = fixture(spark, sf, "meta_raw").withColumn("category", F.col("category_list"))
    folder = new_folder(spark, "json")
    raw.select(F.to_json(F.struct(*schemas.META_JSON_FIELDS)).alias("value")).write.option("compression", "gzip").text(folder)
    return jsonl.read_meta(spark, folder, "home_kitchen", "2026-01-01")


@query
def display_entities(spark, sf):
    """Titles with named and numeric entities, unescaped once."""
    title = F.concat(F.lit("caf&eacute; &amp; &#233;&#xe9; &lt;b&gt; &amp;amp; "), "p_name")
    return table(spark, sf, "part").select("p_partkey", unescape_html(title).alias("title"))


@query
def brand_case_after_punctuation(spark, sf):
    brand = F.concat(F.lower("p_brand"), F.lit("-pro o'neil"))
    return table(spark, sf, "part").select(
        "p_partkey", brand_case(brand, True).alias("brand"), brand_case(brand).alias("brand_by_blanks")
    )


@query
def index_refresh(spark, sf):
    """Publish once with other texts in some months and every row twice, then as the table is: the
    second run rewrites those months and leaves the rest."""
    month = F.add_months(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 12).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", month.alias("month_bucket"), "text")
    docs = docs.unionByName(docs)
    other = F.when(F.month("month_bucket") > 9, F.upper("text")).otherwise(F.col("text"))
    with tables.temporary_schema(spark, "index") as schema:
        for version in (docs.withColumn("text", other), docs):
            loader.refresh_index(version, f"{schema}.documents", lambda: quality.require_quality(
                quality.check_table(version, "documents", ["doc_id", "text"], [])
            ))
        return stage(spark.table(f"{schema}.documents").select("doc_id", "index_month", "text"), "result")


@query
def months_touched(spark, sf):
    """The months that one earlier document makes the index rewrite: its own alone."""
    month = F.add_months(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 12).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", month.alias("month_bucket"), "text")
    early = docs.limit(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit("2018-03-01").cast("date").alias("month_bucket"), F.lit("new").alias("text"))
    later = docs.withColumn("doc_id", F.col("doc_id") + 1).unionByName(early)
    with tables.temporary_schema(spark, "index") as schema:
        loader.refresh_index(loader.with_document_key(docs), f"{schema}.documents", lambda: None)
        touched = loader.refresh_index(loader.with_document_key(later), f"{schema}.documents", lambda: None)
        counted = stage(spark.table(f"{schema}.documents").groupBy("index_month").agg(F.count(F.lit(1)).alias("documents")), "result")
    return counted.withColumn("rewritten", F.col("index_month").isin(touched))


def _dated(spark, sf):
    """Documents with a month and no dense id of their own: what the refresh tells apart by content."""
    month = F.date_format(F.add_months(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 12).cast("int")), "yyyy-MM")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), month.alias("month"), "text")


def _later(docs):
    """One document more in March, one less in May, another text in July."""
    changed = F.when(F.col("source_id") == 6, F.lit("memory card arrived broken")).otherwise(F.col("text"))
    early = docs.limit(1).select(F.lit(-1).cast("long").alias("source_id"), F.lit("2018-03").alias("month"), F.lit("broken charger cable").alias("text"))
    return docs.where("source_id <> 4").withColumn("text", changed).unionByName(early)


def _refreshed(spark, sf):
    """An index built and refreshed once, opened at either version, and what the refresh wrote."""
    root, docs = new_folder(spark, "search-index"), _dated(spark, sf)
    written = []
    for version in (docs, _later(docs)):
        with scope(spark, "keyed") as folder:
            keyed = loader.with_document_key(version)
            written = search_index.refresh_search_index(keyed, root, text="text", keep=["source_id"])
        delete_unread(folder, docs)  # of ``keyed`` only the types are used below
    return [search_index.open_search_index(keyed, root, "doc_key", ["source_id"], v) for v in (1, 2)], written


@query
def segment_refresh(spark, sf):
    """The segments and tombstones that a refresh after three changes writes."""
    _, written = _refreshed(spark, sf)
    rows = [(r.month, r.documents, r.dead) for r in written]
    return spark.createDataFrame(rows, "month string, documents long, dead boolean")


@query
def segment_search(spark, sf):
    """The same questions to a reader of the version before the refresh, and to one of the version after."""
    versions, _ = _refreshed(spark, sf)
    asked = fixture(spark, sf, "search_questions").select("query_id", "query")
    out = None
    for index in versions:
        terms = asked.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        scores = search_index.score_blocks(index, terms, 10, tie="source_id").scores
        named = scores.join(index.documents.select(F.col("doc").alias("doc_id"), "source_id"), "doc_id")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source_id")
        part = named.withColumn("rank", F.row_number().over(best)).where("rank <= 10")
        part = part.select(F.lit(index.version).alias("version"), "query_id", "source_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _kept_index(spark, sf):
    """The index of a documents table, kept for the application: built by the first search, opened by the others."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit("all").alias("month"), "lang")
    state = landing.list_files(spark, f"{sf}/documents.parquet").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "path", "bytes", "modified"))), "\n"))).first()[0]
    root = f"{run_folder(spark)}/kept-index-{state}"
    index = search_index.open_search_index(docs, root, "doc_id", ["lang"])
    if not index.version:
        search_index.refresh_search_index(docs, root, "doc_id", text="text", keep=["lang"])
        index = search_index.open_search_index(docs, root, "doc_id", ["lang"])
    return docs, index


@query
def indexed_keyword_topk(spark, sf):
    """The searches of ``keyword_topk`` and ``keyword_topk_filtered`` by a kept index."""
    docs, index = _kept_index(spark, sf)
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (F.col("query_id") % 4 + 1).cast("int"))
    queries = fixture(spark, sf, "search_questions").select("query_id", "query", F.when(F.col("query_id") % 5 > 0, lang).alias("lang"))
    filtered = retrieval.keyword_topk(docs, queries, k=10, text="text", filter_by=["lang"], index=index)
    open_to_all = retrieval.keyword_topk(docs, queries.drop("lang"), k=10, text="text", index=index)
    return open_to_all.withColumn("filtered", F.lit(False)).unionByName(filtered.withColumn("filtered", F.lit(True)))


@query
def index_blocks_read(spark, sf):
    """How many blocks the terms of a question have, and whether the search left some of them unread."""
    _, index = _kept_index(spark, sf)
    asked = fixture(spark, sf, "search_questions").select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    blocks = search_index.score_blocks(index, asked, 1).blocks
    return blocks.agg(F.count(F.lit(1)).alias("questions"), (F.sum("blocks_read") < F.sum("blocks")).alias("some_unread"))


@query
def publication_gate(spark, sf):
    """A version that breaks a rule is not published: the table keeps the one before."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit("2018-01-01").cast("date").alias("month_bucket"), "text")
    broken = docs.withColumn("text", F.when(F.col("doc_id") % 7 > 0, F.upper("text")))
    with tables.temporary_schema(spark, "index") as schema:
        for version in (docs, broken):
            try:
                loader.refresh_index(version, f"{schema}.documents", lambda: quality.require_quality(
                    quality.check_table(version, "documents", ["doc_id", "text"], ["doc_id"])
                ))
            except quality.QualityError:
                if version is not broken:
                    raise
        return stage(spark.table(f"{schema}.documents").select("doc_id", "text"), "result")


@query
def new_data_gate(spark, sf):
    """Per landed partition, whether a load has something to do."""
    folder = new_folder(spark, "landing")
    landing.write_landing(fixture(spark, sf, "reviews_raw").drop("source_file", "load_ts"), folder)
    has = {d: landing.has_new_data(spark, folder, "dev", d) for d in ("2026-01-01", "2027-01-01")}
    landed = landing.ingest_metrics(spark, folder).filter("category = 'dev'")
    return landed.select("ingest_dt", "rows_written").withColumns(
        {"first_day": F.lit(has["2026-01-01"]), "next_year": F.lit(has["2027-01-01"])}
    )
