"""DuckDB SQL with the result each query must have, over the same given tables."""

from __future__ import annotations

from quibble.catalog.fixtures import fixture_sql
from quibble.catalog.queries import SCENARIOS
from quibble.functions import rules
from quibble.functions.filters import QUERY_RULES
from quibble.operators.clean import CLEAN_META_COLUMNS, CLEAN_REVIEW_COLUMNS
from quibble.operators.complaints import COMPLAINT_COLUMNS
from quibble.operators.documents import DOCUMENT_COLUMNS, RETRIEVAL_LABELS
from quibble.operators.enrich import ENRICHED_REVIEW_COLUMNS, PRODUCT_COLUMNS
from quibble.operators.evaluation import METRICS, SAMPLE_COLUMNS
from quibble.operators.quality import ACCEPTED, NOT_NULL, UNIQUE
from quibble.operators.retrieval import RESULT_COLUMNS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_quoted(v) for v in values)


def _like(column: str, phrases, wild: bool = True) -> str:
    return "(" + " OR ".join(f"{column} LIKE {_quoted('%' + p + '%')}" for p in phrases) + ")"


def _bit(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def _clean(column: str) -> str:
    out = f"coalesce(nullif(trim({column}), ''), '')"
    for pattern in ("<[^>]+>", "[[:cntrl:]]", r"\s+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out})"


def _columns(names, alias: str = "") -> str:
    return ", ".join(f"{alias}{n}" for n in names)


_FLAGS = ", ".join(f"{_bit(_like('lc', p))} AS has_{t}" for t, p in rules.TYPE_PHRASES.items())
_HINTS = "concat_ws(', ', " + ", ".join(f"CASE WHEN has_{t} = 1 THEN '{t}' END" for t in rules.COMPLAINT_TYPES) + ")"
_TYPE = "CASE " + " ".join(f"WHEN has_{t} = 1 THEN '{t}'" for t in rules.COMPLAINT_TYPES) + " ELSE 'other' END"
_SUBTYPE = (
    "CASE "
    + " ".join(
        f"WHEN complaint_type_candidate = '{t}' AND {_like('lc', p)} THEN '{s}'" for s, t, p in rules.SUBTYPE_RULES
    )
    + " ELSE concat('general_', complaint_type_candidate) END"
)


def _domain() -> str:
    parts, sub_category = [], "lower(coalesce(sub_category, ''))"
    for category, rule in rules.DOMAIN_RULES.items():
        prefix = " OR ".join(f"starts_with(lower(coalesce(category_path, '')), {_quoted(p)})" for p in rule["path_prefix"])
        parts.append(
            f"(category = '{category}' AND (main_cat IS NULL OR lower(coalesce(root_category, '')) IN ({_list(rule['root'])})"
            f" OR {prefix} OR {_like('lower(main_cat)', rule['main'])}"
            f" OR {_like(sub_category, rule['sub'])}))"
        )
    return " OR ".join(parts)


_REVIEW_EXPRESSIONS = {
    "reviewer_id": "nullif(trim(reviewerID), '')",
    "reviewer_name": "nullif(trim(reviewerName), '')",
    "review_text": "nullif(trim(reviewText), '')",
    "unix_review_time_str": "nullif(trim(unixReviewTime), '')",
    "review_time_str": "nullif(trim(reviewTime), '')",
    "week_bucket": "cast(date_trunc('week', review_date) AS date)",
    "month_bucket": "cast(date_trunc('month', review_date) AS date)",
    "verified_str": "nullif(trim(verified), '')",
    "verified_flag": "CASE WHEN lower(trim(verified)) IN ('true','y','yes') THEN 1 WHEN lower(trim(verified)) IN ('false','n','no') THEN 0 END",
    "vote_count": "cast(try_cast(replace(nullif(trim(vote), ''), ',', '') AS decimal(38,0)) AS bigint)",
    "review_length": "cast(length(review_text_clean) AS int)",
    "positive_flag": _bit("overall >= 4"),
    "neutral_flag": _bit("overall = 3"),
    "negative_flag": _bit("overall <= 2"),
    "is_low_rating_review": _bit("overall <= 3"),
    "issue_hint_keywords": _HINTS,
    "complaint_type_candidate": _TYPE,
}

# Each layer as one common table expression: name -> (layers it reads, SQL).
_CTES: dict[str, tuple[list[str], str]] = {
    name: ([], fixture_sql(name)) for name in ("reviews_raw", "meta_raw", "answers", "questions", "search_questions")
}
_CTES["texts"] = (
    ["reviews_raw"],
    f"SELECT *, lower(review_text_clean) AS lc FROM (SELECT *, {_clean('reviewText')} AS review_text_clean FROM reviews_raw)",
)
_CTES["flagged"] = (
    ["texts"],
    f"""SELECT *, {_FLAGS}, {_bit(_like('lc', rules.SELLER_PHRASES))} AS has_seller_fulfillment_noise,
        coalesce(try_cast(nullif(trim(reviewTime), '') AS date),
                 date '1970-01-01' + cast(cast(unixReviewTime AS bigint) // 86400 AS int)) AS review_date
        FROM texts""",
)
_CTES["clean_reviews"] = (
    ["flagged"],
    "SELECT "
    + ", ".join(f"{_REVIEW_EXPRESSIONS[c]} AS {c}" if c in _REVIEW_EXPRESSIONS else c for c in CLEAN_REVIEW_COLUMNS)
    + " FROM flagged WHERE asin IS NOT NULL AND category IS NOT NULL AND ingest_dt IS NOT NULL AND overall IS NOT NULL"
    " AND length(review_text_clean) > 30 AND has_seller_fulfillment_noise = 0",
)
_CTES["clean_meta"] = (
    ["meta_raw"],
    f"""SELECT {_columns(CLEAN_META_COLUMNS)} FROM (
          SELECT asin, nullif(trim(title), '') AS title,
                 concat(upper(substr(brand, 1, 1)), lower(substr(brand, 2))) AS brand,
                 try_cast(regexp_replace(price, '[^0-9.]', '', 'g') AS double) AS price,
                 nullif(trim(main_cat), '') AS main_cat, nullif(trim(category_list), '') AS category_list,
                 nullif(trim(category), '') AS category, ingest_dt, source_file, load_ts,
                 items[1] AS root_category, trim(items[2]) AS sub_category, items[len(items)] AS leaf_category,
                 cast(len(items) AS int) AS category_depth,
                 CASE WHEN items IS NULL THEN NULL WHEN len(items) = 0 THEN '' ELSE array_to_string(items, ' > ') END
                   AS category_path
          FROM (SELECT *, CASE WHEN json_valid(category_list) THEN cast(cast(category_list AS json) AS varchar[]) END AS items
                FROM meta_raw
                QUALIFY row_number() OVER (PARTITION BY asin ORDER BY ingest_dt DESC, load_ts DESC) = 1))""",
)
_CTES["review_enriched"] = (
    ["clean_reviews", "clean_meta"],
    f"SELECT {_columns(ENRICHED_REVIEW_COLUMNS, 'r.')}, {_columns(PRODUCT_COLUMNS, 'm.')}"
    " FROM clean_reviews r LEFT JOIN clean_meta m ON r.asin = m.asin",
)
_CTES["product_health_daily"] = (
    ["review_enriched"],
    """SELECT review_date, week_bucket, month_bucket, category, brand, asin, complaint_type_candidate,
         count(*) AS review_count, cast(sum(negative_flag) AS bigint) AS negative_reviews,
         cast(sum(neutral_flag) AS bigint) AS neutral_reviews, cast(sum(positive_flag) AS bigint) AS positive_reviews,
         round(sum(negative_flag) / count(*), 6) AS negative_rate, round(sum(positive_flag) / count(*), 6) AS positive_rate,
         avg(overall) AS avg_rating FROM review_enriched GROUP BY ALL""",
)
_CTES["gated"] = (
    ["review_enriched"],
    f"""SELECT *, 1 AS operational_complaint_flag, {_bit(_domain())} AS metadata_domain_match_flag,
          {_bit("regexp_matches(lc, " + _quoted("(" + "|".join(rules.NARRATIVE_PHRASES) + ")") + ")")} AS narrative_content_noise_flag,
          {_bit("regexp_full_match(lc, " + _quoted("(" + "|".join(rules.NARRATIVE_PHRASES) + ")") + ")")} AS full_match_flag,
          {_SUBTYPE} AS complaint_subtype
        FROM (SELECT *, lower(review_text_clean) AS lc FROM review_enriched
              WHERE category IN ({_list(rules.COMPLAINT_CATEGORIES)}) AND overall <= 3 AND complaint_type_candidate <> 'other')""",
)
_CTES["confident"] = (
    ["gated"],
    "SELECT * FROM gated WHERE metadata_domain_match_flag = 1 AND narrative_content_noise_flag = 0",
)
_CTES["medians"] = (
    ["confident"],
    "SELECT category, cast(quantile_cont(review_length, 0.5) AS double) AS median_review_length FROM confident GROUP BY category",
)
_CTES["scored"] = (
    ["confident", "medians"],
    f"""SELECT *, severity_signal + verified_signal + community_signal + detail_signal AS signal_score FROM (
          SELECT c.*, {_bit('overall <= 2')} AS severity_signal, {_bit('verified_flag = 1')} AS verified_signal,
                 {_bit('vote_count >= 1')} AS community_signal,
                 {_bit('review_length >= median_review_length')} AS detail_signal
          FROM confident c JOIN medians m ON c.category = m.category)""",
)
_CTES["complaints"] = (["scored"], f"SELECT {_columns(COMPLAINT_COLUMNS)} FROM scored WHERE signal_score >= 3")
_CTES["docs"] = (
    ["complaints"],
    "SELECT row_number() OVER (ORDER BY review_date NULLS LAST, asin NULLS LAST, reviewer_id NULLS LAST) AS doc_id, "
    + ", ".join(
        {
            "complaint_type": "complaint_type_candidate AS complaint_type",
            "review_text": "review_text_clean AS review_text",
            "retrieval_text": "concat_ws(' ', "
            + ", ".join(
                f"'{label}', coalesce({ {'complaint_type': 'complaint_type_candidate', 'review_text': 'review_text_clean'}.get(c, c) }, '')"
                for label, c in RETRIEVAL_LABELS
            )
            + ") AS retrieval_text",
        }.get(c, c)
        for c in DOCUMENT_COLUMNS[1:]
    )
    + " FROM complaints",
)
_CTES["centroids"] = (
    [],
    """SELECT label, list(x ORDER BY i) AS v FROM (
         SELECT label, i, avg(cast(embedding[i] AS double)) AS x
         FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i)
       GROUP BY label""",
)
_CTES["searchable"] = (
    ["docs"],
    "SELECT d.*, cast(e.embedding AS double[]) AS v FROM docs d JOIN embeddings e ON d.reviewer_id = concat('R', e.vec_id)",
)
_CTES["evidence"] = (
    ["searchable", "centroids"],
    f"""SELECT * FROM (
          SELECT c.label AS query_id, {_columns(RESULT_COLUMNS, 's.')}, round(list_cosine_similarity(s.v, c.v), 6) AS score,
                 row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(s.v, c.v), 6) DESC, s.doc_id) AS rank
          FROM searchable s, centroids c) WHERE rank <= 10""",
)
_SCORE = """coalesce(CASE WHEN json_valid(judge_text) THEN try_cast(json_extract_string(judge_text, '$.score') AS double) END,
  CASE WHEN NOT json_valid(judge_text) THEN try_cast(regexp_extract(judge_text, '"score"\\s*:\\s*([0-9.]+)', 1) AS double) END, 0.0)"""
_CTES["results"] = (
    ["questions", "answers"],
    f"""SELECT q.question_key AS question_id, question, category, complaint_type,
          CASE WHEN ran THEN round(least(s, 1.0), 3) END AS retrieval_relevance,
          CASE WHEN ran THEN CASE WHEN s >= 0.5 THEN 1.0::double ELSE 0.0::double END END AS answerability,
          CASE WHEN ran THEN round(least(s * 0.75::double, 1.0), 3) END AS answer_correctness,
          CASE WHEN ran THEN round(least(s / 3, 1.0), 3) END AS faithfulness,
          cast(CASE WHEN ran THEN n ELSE 0 END AS int) AS evidence_count,
          CASE WHEN ran THEN CASE WHEN lower(verification) LIKE '%high%' THEN 'High' WHEN lower(verification) LIKE '%medium%' THEN 'Medium'
               WHEN lower(verification) LIKE '%low%' THEN 'Low' ELSE '' END ELSE '' END AS confidence_raw,
          CASE WHEN n IS NULL THEN 'no run for this question' WHEN failed THEN 'pipeline failed' ELSE '' END AS error
        FROM (SELECT q.*, a.s, a.n, a.verification, a.failed, a.n IS NOT NULL AND NOT a.failed AS ran
              FROM questions q LEFT JOIN (
                SELECT concat(conv_id, '_', turn - 1) AS k, {_SCORE} AS s, turn % 11 AS n, verification, conv_id % 10 = 9 AS failed
                FROM answers) a ON q.question_key = a.k) q""",
)
_VALID = f"complaint_type IN ({_list(rules.COMPLAINT_TYPES)})"
_CTES["search"] = (
    ["docs"],
    f"""SELECT coalesce(nullif(trim(title), ''), 'Untitled Product') AS product, asin, brand, complaint_type,
          coalesce(complaint_subtype, '-') AS complaint_subtype, complaint_count, avg_signal_score, earliest_review, latest_review
        FROM (SELECT title, asin, brand, complaint_type, complaint_subtype, count(*) AS complaint_count,
                     round(avg(signal_score), 2) AS avg_signal_score, min(review_date) AS earliest_review,
                     max(review_date) AS latest_review
              FROM docs WHERE {_VALID} AND title IS NOT NULL AND lower(brand) LIKE '%brand%' AND lower(title) LIKE '%b%'
              GROUP BY ALL
              ORDER BY complaint_count DESC, asin NULLS LAST, title, brand NULLS LAST, complaint_type, complaint_subtype NULLS LAST
              LIMIT 50)""",
)


def _sql(body: str, *layers: str) -> str:
    """``body`` over the named layers, with everything they read in front."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for inner in _CTES[name][0]:
                add(inner)
            needed.append(name)

    for layer in layers:
        add(layer)
    return ("WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in needed) + "\n" if needed else "") + body


def _bm25(docs: str, text: str, asked: str, k: int, test: str = "true") -> str:
    """Keyword top-k of the rows ``asked`` (query_id, query) over ``docs``; ``test`` picks documents d for query q."""
    return f"""SELECT query_id, doc_id, score, cast(rank AS int) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                                 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM (SELECT doc_id, term, count(*) AS tf FROM (
                SELECT doc_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {docs}) GROUP BY ALL) tf
        JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (
                SELECT doc_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {docs}) GROUP BY ALL) USING (term)
        JOIN (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {asked}) qt USING (term)
        JOIN (SELECT doc_id, len(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS length FROM {docs}) USING (doc_id),
        (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) AS mean FROM {docs})
        WHERE (query_id, doc_id) IN (SELECT (q.query_id, d.doc_id) FROM {docs} d, {asked} q WHERE {test})
        GROUP BY query_id, doc_id))
    WHERE rank <= {k}"""


LANGUAGE_TEST = "q.query_id % 5 = 0 OR d.lang = ['en', 'de', 'fr', 'es'][q.query_id % 4 + 1]"


def _segment_search() -> str:
    before = "(SELECT doc_id, text FROM documents)"
    after = """(SELECT doc_id, CASE WHEN doc_id = 6 THEN 'memory card arrived broken' ELSE text END AS text FROM documents WHERE doc_id <> 4
                UNION ALL SELECT -1, 'broken charger cable')"""
    parts = [
        f"SELECT {v} AS version, query_id, doc_id AS source_id, score, rank FROM ({_bm25(docs, 'text', 'search_questions', 10)})"
        for v, docs in ((1, before), (2, after))
    ]
    return " UNION ALL ".join(parts)


def _check(table: str, rule: str, column: str, test: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, {test} AS failures FROM {table}"


def _repeated(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'unique' AS rule, '{column}' AS column_name, count(*) AS failures FROM"
        f" (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    )


def _layer_rules() -> str:
    views = {"review_enriched_complaints": "complaints", "review_documents": "docs"}
    parts = []
    for t, columns in NOT_NULL.items():
        source = views.get(t, t)
        parts += [_check(source, "not_null", c, f"count(*) FILTER ({c} IS NULL)").replace(f"'{source}'", f"'{t}'", 1) for c in columns]
        parts += [_repeated(source, c).replace(f"'{source}'", f"'{t}'", 1) for c in UNIQUE.get(t, [])]
        parts += [
            _check(source, "accepted_values", c, f"count(*) FILTER ({c} NOT IN ({_list(v)}))").replace(f"'{source}'", f"'{t}'", 1)
            for c, v in ACCEPTED.get(t, {}).items()
        ]
    return _sql("\nUNION ALL\n".join(parts), "clean_reviews", "clean_meta", "review_enriched", "product_health_daily", "complaints", "docs")


def _display(column: str) -> str:
    known = " ".join(
        f"WHEN '{t}' THEN '{' '.join(w.capitalize() for w in t.split('_'))}'" for t in rules.COMPLAINT_TYPES
    )
    return f"CASE {column} {known} END"


def _title_case(column: str) -> str:
    # DuckDB has no initcap: capitalise the pieces between underscores.
    return (
        f"(SELECT string_agg(concat(upper(w[1]), w[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split({column}, '_')) AS w,"
        f" unnest(range(1, len(string_split({column}, '_')) + 1)) AS i))"
    )


def _clauses(pairs: list[tuple[str, str]]) -> str:
    """``field=value`` of each (test, clause) pair that holds, joined; null for none."""
    return "nullif(concat_ws(' & ', " + ", ".join(f"CASE WHEN {test} THEN {clause} END" for test, clause in pairs) + "), '')"


def _query_filters() -> str:
    given = _clauses(
        [
            ("lower(category) NOT IN ('any', '')", "concat('category=', lower(category))"),
            ("lower(complaint_type) NOT IN ('any', '')", "concat('complaint_type=', lower(complaint_type))"),
        ]
    )
    derived = _clauses([(_like("lower(query)", words), f"'{f}={v}'") for f, v, words in QUERY_RULES])
    return _sql(
        f"""SELECT *, coalesce(given, derived) AS resolved,
              coalesce(len(regexp_extract_all(coalesce(given, derived), 'category=')) > 1
                       OR len(regexp_extract_all(coalesce(given, derived), 'complaint_type=')) > 1, false) AS conflict
            FROM (SELECT query_id, {given} AS given, {derived} AS derived FROM search_questions)""",
        "search_questions",
    )


def _question_evidence() -> str:
    """A selection rules out what words call for; each clause is one equality."""
    derived = {
        field: [(_like("lower(q.query)", words), value) for f, value, words in QUERY_RULES if f == field]
        for field in ("category", "complaint_type")
    }
    chosen = {f: f"coalesce(lower(q.{f}) NOT IN ('any', ''), false)" for f in derived}
    none = " AND ".join(f"NOT {c}" for c in chosen.values())
    tests = [f"(NOT {c} OR d.{f} = lower(q.{f}))" for f, c in chosen.items()]
    for f, cases in derived.items():
        tests += [f"(NOT ({none}) OR NOT {test} OR d.{f} = '{value}')" for test, value in cases]
    found = _bm25("docs", "retrieval_text", "search_questions", 5, " AND ".join(tests))
    return _sql(
        f"SELECT query_id, f.doc_id, category, complaint_type, score, rank FROM ({found}) f JOIN docs USING (doc_id)",
        "docs",
        "search_questions",
    )


def _scenarios() -> str:
    operators = {"@eq": "=", "@gte": ">=", "@lte": "<="}

    def test(spec) -> str:
        if spec is None:
            return "true"
        ((op, arg),) = spec.items()
        if op == "@and":
            return " AND ".join(test(a) for a in arg)
        ((field, value),) = arg.items()
        return f"d.{field} {operators[op]} {_quoted(value) if isinstance(value, str) else value}"

    parts = [
        _bm25(
            "docs",
            "retrieval_text",
            f"(SELECT {i} AS query_id, {_quoted(text)} AS query)",
            5,
            test(wanted),
        )
        for i, (text, wanted) in enumerate(SCENARIOS, 1)
    ]
    found = " UNION ALL ".join(f"({p})" for p in parts)
    return _sql(
        f"SELECT query_id AS scenario, score, {_columns(RESULT_COLUMNS, 'd.')} FROM ({found}) f JOIN docs d ON f.doc_id = d.doc_id",
        "docs",
    )


def _context(layout: str) -> str:
    def value(c: str) -> str:
        return f"coalesce(cast({c} AS varchar), '')"

    complaint = [
        ("Product", "title"), ("Brand", "brand"), ("Category", "category"), ("Complaint Type", "complaint_type"),
        ("Complaint Subtype", "complaint_subtype"), ("Summary", "summary"),
    ]
    more = complaint + [("Signal Score", "signal_score"), ("Review Date", "review_date")]
    newline = "chr(10)"
    if layout in ("reasoning", "detailed"):
        fields = more if layout == "detailed" else complaint
        lines = ", ".join(f"'{label}: ', {value(c)}, {newline}" for label, c in fields)
        block, between = f"concat('Complaint ', rank, ':', {newline}, {lines})", newline
    elif layout == "sample":
        names = {"subtype": "complaint_subtype"}
        lines = f", {newline}, ".join(
            f"'{n}: ', {value(names.get(n, n))}" for n in ("doc_id", "title", "brand", "complaint_type", "subtype", "summary")
        )
        block, between = f"concat({lines})", f"concat({newline}, {newline})"
    elif layout == "relevance":
        block = (
            f"concat('  Complaint ', rank, ': category=', {value('category')}, ', complaint_type=', {value('complaint_type')},"
            f" ', subtype=', {value('complaint_subtype')}, ', brand=', {value('brand')}, ', signal_score=', {value('signal_score')},"
            f" ', summary=', {value('summary')})"
        )
        between = newline
    else:
        block = (
            f"concat('  [', rank, '] complaint_type=', {value('complaint_type')}, ' | subtype=', {value('complaint_subtype')},"
            f" ' | summary=', left({value('summary')}, 100))"
        )
        between = newline
    return f"array_to_string(list({block} ORDER BY rank), {between}) AS {layout}"


def _sections() -> str:
    labels = ["Issue Summary", "Likely Recurring Pattern", "Root Cause Hypothesis", "Business Impact", "Recommended Actions"]
    any_label = "|".join(labels)
    columns = [
        f"""CASE WHEN contains(answer, '{label}:') THEN
              regexp_replace(split_part(regexp_replace(string_split(answer, '{label}:')[-1], '(?:{any_label}):', chr(1)), chr(1), 1),
                             '^\\s+|\\s+$', '', 'g') END AS {label.lower().replace(' ', '_')}"""
        for label in labels
    ]
    bodies = [
        f"""regexp_replace(CASE WHEN regexp_matches(answer, '(?i){label}[:\\s\\-]*\\n')
              THEN regexp_extract(answer, '(?is){label}[:\\s\\-]*\\n(.*?)(?:\\n[A-Z][a-zA-Z ]+:|$)', 1)
              ELSE answer END, '^\\s+|\\s+$', '', 'g') AS {name}"""
        for label, name in (("Issue Summary", "issue_or_text"), ("Recommended Actions", "actions_or_text"))
    ]
    excerpt = "left(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), 800) AS excerpt"
    return _sql(f"SELECT conv_id, turn, {', '.join(columns + bodies + [excerpt])} FROM answers", "answers")


_COVERAGE = "round(count(*) FILTER (title IS NOT NULL) / nullif(count(*), 0), 4) AS pct_with_meta"
_TOP = "ORDER BY complaint_count DESC"


def oracle_sql() -> dict[str, str]:
    out = {
        "clean_text_documents": f"SELECT doc_id, t AS text_clean, cast(length(t) AS int) AS text_length FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)",
        "clean_text_pages": f"SELECT page_id, t AS text_clean, cast(length(t) AS int) AS text_length FROM (SELECT page_id, {_clean('html')} AS t FROM pages)",
        "issue_flags": _sql(
            f"SELECT reviewerID, {', '.join('has_' + t for t in rules.COMPLAINT_TYPES)}, has_seller_fulfillment_noise FROM flagged",
            "flagged",
        ),
        "complaint_type": _sql(
            f"SELECT reviewerID, {_HINTS} AS issue_hint_keywords, {_TYPE} AS complaint_type_candidate FROM flagged", "flagged"
        ),
        "clean_reviews": _sql("SELECT * FROM clean_reviews", "clean_reviews"),
        "clean_meta": _sql("SELECT * FROM clean_meta", "clean_meta"),
        "review_enriched": _sql("SELECT * FROM review_enriched", "review_enriched"),
        "metadata_coverage": _sql(
            f"SELECT count(*) AS total_reviews, count(*) FILTER (title IS NOT NULL) AS reviews_with_title, {_COVERAGE} FROM review_enriched",
            "review_enriched",
        ),
        "coverage_by_category": _sql(
            f"SELECT category, count(*) AS reviews, {_COVERAGE} FROM review_enriched GROUP BY category", "review_enriched"
        ),
        "product_health_daily": _sql("SELECT * FROM product_health_daily", "product_health_daily"),
        "rate_range_check": _sql(
            "SELECT count(*) AS bad_rows FROM product_health_daily WHERE positive_rate < 0 OR positive_rate > 1 OR negative_rate < 0 OR negative_rate > 1",
            "product_health_daily",
        ),
        "complaint_subtype": _sql("SELECT reviewer_id, complaint_type_candidate, complaint_subtype FROM gated", "gated"),
        "domain_match": _sql(
            "SELECT reviewer_id, category, main_cat, operational_complaint_flag, metadata_domain_match_flag FROM gated", "gated"
        ),
        "narrative_noise": _sql("SELECT reviewer_id, narrative_content_noise_flag, full_match_flag FROM gated", "gated"),
        "category_median": _sql("SELECT * FROM medians", "medians"),
        "signal_score": _sql(
            "SELECT reviewer_id, category, severity_signal, verified_signal, community_signal, detail_signal, signal_score FROM scored",
            "scored",
        ),
        "scored_complaints": _sql("SELECT * FROM complaints", "complaints"),
        "review_documents": _sql("SELECT * FROM docs", "docs"),
        "overview": _sql(
            f"""SELECT count(*) AS total_complaints, count(DISTINCT brand) AS total_brands, count(DISTINCT asin) AS total_products,
                  count(DISTINCT lower(category)) AS total_categories FROM docs WHERE {_VALID}""",
            "docs",
        ),
        "type_distribution": _sql(f"SELECT complaint_type, count(*) AS complaint_count FROM docs WHERE {_VALID} GROUP BY 1", "docs"),
        "type_distribution_by_category": _sql(
            f"SELECT complaint_type, count(*) AS complaint_count FROM docs WHERE {_VALID} AND lower(category) = 'electronics' GROUP BY 1",
            "docs",
        ),
        "category_distribution": _sql(f"SELECT category, count(*) AS complaint_count FROM docs WHERE {_VALID} GROUP BY 1", "docs"),
        "top_brands": _sql(
            f"""SELECT brand, category, count(*) AS complaint_count, count(DISTINCT asin) AS products_affected,
                  round(avg(signal_score), 2) AS avg_signal_score FROM docs WHERE {_VALID} GROUP BY brand, category
                {_TOP}, brand NULLS LAST, category LIMIT 15""",
            "docs",
        ),
        "subtype_distribution": _sql(
            f"""SELECT complaint_subtype, count(*) AS complaint_count FROM docs
                WHERE {_VALID} AND complaint_subtype NOT IN ('', 'other', 'unknown') GROUP BY 1 {_TOP}, complaint_subtype LIMIT 15""",
            "docs",
        ),
        "top_products": _sql(
            f"""SELECT coalesce(nullif(trim(title), ''), 'Untitled Product') AS product, asin, brand, category, complaint_count, complaint_types_count
                FROM (SELECT title, asin, brand, category, count(*) AS complaint_count, count(DISTINCT complaint_type) AS complaint_types_count
                      FROM docs WHERE {_VALID} AND title IS NOT NULL AND lower(category) = 'home_kitchen' GROUP BY title, asin, brand, category
                      {_TOP}, asin, title, brand NULLS LAST, category LIMIT 10)""",
            "docs",
        ),
        "complaint_search": _sql("SELECT * FROM search", "search"),
        "complaint_search_display": _sql(
            f"""SELECT product, asin, brand, {_display('complaint_type')} AS complaint_type, {_title_case('complaint_subtype')} AS complaint_subtype,
                  complaint_count, avg_signal_score, earliest_review, latest_review FROM search""",
            "search",
        ),
        "search_breakdown": _sql(
            "SELECT complaint_type, cast(sum(complaint_count) AS bigint) AS complaint_count FROM search GROUP BY 1", "search"
        ),
        "monthly_trend": _sql(f"SELECT month_bucket, count(*) AS complaint_count FROM docs WHERE {_VALID} GROUP BY 1", "docs"),
        "latest_record_per_key": "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
        "latest_event_per_user": "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "sample_per_group": _sql(
            f"""SELECT * REPLACE (cast(sample_rank AS int) AS sample_rank) FROM (SELECT {_columns(SAMPLE_COLUMNS)},
                  row_number() OVER (PARTITION BY category, complaint_type ORDER BY signal_score DESC, doc_id) AS sample_rank
                FROM docs WHERE summary IS NOT NULL AND title IS NOT NULL) WHERE sample_rank <= 15""",
            "docs",
        ),
        "number_questions": _sql(
            "SELECT conv_id, turn, question, concat('q_', row_number() OVER (ORDER BY conv_id, turn)) AS question_id FROM questions",
            "questions",
        ),
        "partition_sanity": _sql("SELECT category, ingest_dt, count(*) AS cnt FROM reviews_raw GROUP BY ALL", "reviews_raw"),
        "null_keys": _sql("SELECT count(*) FILTER (summary IS NULL) AS null_summary, count(*) AS total FROM reviews_raw", "reviews_raw"),
        "rating_distribution": _sql("SELECT overall, count(*) AS cnt FROM reviews_raw GROUP BY 1", "reviews_raw"),
        "join_coverage": _sql(
            """SELECT count(*) AS total_reviews, count(DISTINCT r.asin) AS distinct_review_asins, count(DISTINCT m.asin) AS distinct_meta_asins,
                 count(DISTINCT CASE WHEN m.asin IS NOT NULL THEN r.asin END) AS matched_review_asins
               FROM reviews_raw r LEFT JOIN meta_raw m ON r.asin = m.asin""",
            "reviews_raw",
            "meta_raw",
        ),
        "join_coverage_distinct": _sql(
            """SELECT count(*) AS total_reviews, count(DISTINCT r.asin) AS distinct_review_asins, count(DISTINCT m.asin) AS distinct_meta_asins,
                 count(DISTINCT CASE WHEN m.asin IS NOT NULL THEN r.asin END) AS matched_review_asins
               FROM reviews_raw r LEFT JOIN (SELECT DISTINCT asin FROM meta_raw) m ON r.asin = m.asin""",
            "reviews_raw",
            "meta_raw",
        ),
        "length_profile": _sql(
            """SELECT count(*) FILTER (reviewText IS NULL) AS null_text, count(*) FILTER (length(reviewText) <= 30) AS short_text,
                 count(*) AS total FROM reviews_raw""",
            "reviews_raw",
        ),
        "layer_counts": _sql(
            " UNION ALL ".join(
                f"SELECT '{t}' AS table_name, count(*) AS cnt FROM {t}"
                for t in ("reviews_raw", "clean_reviews", "meta_raw", "clean_meta", "review_enriched", "product_health_daily")
            ),
            "reviews_raw", "clean_reviews", "meta_raw", "clean_meta", "review_enriched", "product_health_daily",
        ),
        "total_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS cnt FROM {t}" for t in ("documents", "part", "orders", "customer", "events")
        ),
        "oversized_sources": _sql(
            """SELECT source_file, count(*) AS rows_in_table FROM reviews_raw GROUP BY 1 HAVING count(*) > 200
               ORDER BY rows_in_table DESC, source_file LIMIT 20""",
            "reviews_raw",
        ),
        "dedup_check": _sql("SELECT count(*) AS meta_rows, count(DISTINCT asin) AS distinct_asins FROM meta_raw", "meta_raw"),
        "blank_documents": _sql(
            """SELECT count(*) FILTER (retrieval_text IS NULL) AS null_retrieval_text,
                 count(*) FILTER (trim(retrieval_text) = '') AS blank_retrieval_text FROM docs""",
            "docs",
        ),
        "newest_rows": _sql(
            "SELECT asin, reviewerID, overall, category, load_ts FROM reviews_raw ORDER BY load_ts DESC, reviewerID LIMIT 10", "reviews_raw"
        ),
        "not_null_rules": _sql(
            " UNION ALL ".join(
                _check("reviews_raw", "not_null", c, f"count(*) FILTER ({c} IS NULL)")
                for c in ("asin", "overall", "summary", "verified", "category")
            ),
            "reviews_raw",
        ),
        "unique_rules": " UNION ALL ".join(
            _repeated(t, c) for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"))
        ),
        "accepted_values_rules": " UNION ALL ".join(
            _check("orders", "accepted_values", c, f"count(*) FILTER ({c} NOT IN ({_list(v)}))")
            for c, v in (("o_orderstatus", ["O", "F"]), ("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]))
        ),
        "layer_rules": _layer_rules(),
        "semantic_topk": """SELECT vec_id, label, score FROM (
             SELECT vec_id, label, round(list_cosine_similarity(cast(embedding AS double[]), cast(q.v AS double[])), 6) AS score
             FROM embeddings, (SELECT arg_min(embedding, vec_id) AS v FROM embeddings) q)
           ORDER BY score DESC, vec_id LIMIT 10""",
        "semantic_topk_filtered": _sql(
            f"""SELECT {_columns(RESULT_COLUMNS)}, round(list_cosine_similarity(s.v, cast(q.v AS double[])), 6) AS score
                FROM searchable s, (SELECT arg_min(embedding, vec_id) AS v FROM embeddings) q
                WHERE category = 'electronics' AND signal_score >= 3 AND review_date BETWEEN '2017-01-01' AND '2018-12-31'
                ORDER BY score DESC, doc_id LIMIT 10""",
            "searchable",
        ),
        "batch_semantic_topk": _sql(
            """SELECT query_id, doc_id, score, cast(rank AS int) AS rank FROM (
                 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
                   SELECT c.label AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(cast(e.embedding AS double[]), c.v), 6) AS score
                   FROM embeddings e, centroids c)) WHERE rank <= 5""",
            "centroids",
        ),
        "batch_semantic_topk_filtered": _sql(
            """SELECT query_id, doc_id, score, cast(rank AS int) AS rank FROM (
                 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
                   SELECT c.label AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(cast(e.embedding AS double[]), c.v), 6) AS score
                   FROM embeddings e JOIN centroids c ON e.label = c.label)) WHERE rank <= 5""",
            "centroids",
        ),
        "keyword_topk": _sql(_bm25("documents", "text", "search_questions", 10), "search_questions"),
        "keyword_topk_filtered": _sql(
            _bm25("documents", "text", "search_questions", 10, LANGUAGE_TEST),
            "search_questions",
        ),
        "question_evidence": _question_evidence(),
        "retrieval_scenarios": _scenarios(),
        "query_filters": _query_filters(),
        "evidence_preview": _sql(
            "SELECT query_id, cast(rank AS int) AS rank, "
            + ", ".join(
                f"coalesce({c}, '') AS {c}" for c in ("title", "category", "complaint_type", "complaint_subtype", "summary")
            )
            + " FROM evidence",
            "evidence",
        ),
        "evidence_context": _sql(
            "SELECT query_id, "
            + ", ".join(_context(n) for n in ("reasoning", "detailed", "sample", "relevance", "faithfulness"))
            + " FROM evidence GROUP BY query_id",
            "evidence",
        ),
        "evidence_count": _sql("SELECT query_id, count(*) AS evidence_count FROM evidence GROUP BY 1", "evidence"),
        "dominant_type": _sql(
            """SELECT query_id, complaint_type AS dominant_type, n AS match_count, cast(total AS bigint) AS evidence_count FROM (
                 SELECT *, sum(n) OVER (PARTITION BY query_id) AS total,
                        row_number() OVER (PARTITION BY query_id ORDER BY n DESC, complaint_type) AS r
                 FROM (SELECT query_id, complaint_type, count(*) AS n FROM evidence GROUP BY ALL)) WHERE r = 1""",
            "evidence",
        ),
        "evidence_summary": _sql(
            """SELECT query_id, string_agg(concat(complaint_type, '(', complaint_subtype, ')'), '; ' ORDER BY rank) AS evidence_summary
               FROM evidence WHERE rank <= 10 GROUP BY 1""",
            "evidence",
        ),
        "answer_sections": _sections(),
        "verification_parse": _sql(
            r"""SELECT conv_id, turn,
                  regexp_replace(regexp_extract(verification, '(?is)Verification[:\s\-]*\n(.*?)(?:Confidence[:\s\-]|$)', 1), '^\s+|\s+$', '', 'g') AS body,
                  CASE lower(regexp_extract(verification, '(?i)Confidence[:\s\-]*\n?[•\-\*]?\s*(High|Medium|Low)', 1))
                    WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE '' END AS confidence
                FROM answers""",
            "answers",
        ),
        "confidence_label": _sql(
            """SELECT conv_id, turn, CASE WHEN contains(lower(verification), 'high') THEN 'High' WHEN contains(lower(verification), 'medium') THEN 'Medium'
                 WHEN contains(lower(verification), 'low') THEN 'Low' ELSE '' END AS confidence FROM answers""",
            "answers",
        ),
        "score_extract": _sql(
            f"""SELECT conv_id, turn, s AS score, round(greatest(0.0, least(1.0, s)), 3) AS clamped,
                  CASE WHEN s >= 0.5 THEN 1.0::double ELSE 0.0::double END AS answerability
                FROM (SELECT conv_id, turn, cast({_SCORE} AS double) AS s FROM answers)""",
            "answers",
        ),
        "eval_results": _sql("SELECT * FROM results", "results"),
        "eval_summary": _sql(
            "SELECT count(*) AS total_questions, count(retrieval_relevance) AS evaluated, count(*) - count(retrieval_relevance) AS failed, "
            + ", ".join(f"round(avg({m}), 3) AS avg_{m}" for m in METRICS)
            + " FROM results",
            "results",
        ),
        "eval_details": _sql(
            f"""SELECT r.question_id, r.question, r.category, r.complaint_type, {_columns(METRICS, 'r.')}, confidence_raw,
                  concat('truth: ', r.question) AS ground_truth_answer, '' AS pipeline_interpreted_intent, '' AS pipeline_retrieval_notes,
                  coalesce(a.answer, '') AS pipeline_answer, coalesce(a.verification, '') AS pipeline_verification
                FROM results r LEFT JOIN answers a ON r.question_id = concat(a.conv_id, '_', a.turn - 1)""",
            "results",
        ),
        "low_correctness": _sql(
            """SELECT question_id, complaint_type, answer_correctness FROM results
               WHERE category = 'electronics' AND (answer_correctness < 0.7 OR answer_correctness IS NULL)""",
            "results",
        ),
        "grid_counts": _sql(
            f"""SELECT category, complaint_type, count(asin) AS documents
                FROM (SELECT unnest([{_list(rules.COMPLAINT_CATEGORIES)}]) AS category)
                CROSS JOIN (SELECT unnest([{_list(rules.COMPLAINT_TYPES)}]) AS complaint_type)
                LEFT JOIN docs USING (category, complaint_type) GROUP BY ALL""",
            "docs",
        ),
        "id_lists": """SELECT conv_id, string_agg(concat('doc_id_', turn), '|' ORDER BY turn) AS ids, cast(count(*) AS int) AS n_ids,
                         cast(min(turn) AS bigint) AS first_id, cast(max(turn) AS bigint) AS last_id FROM conversations GROUP BY conv_id""",
        "incremental_load": "SELECT event_type, count(*) AS rows_loaded, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY 1",
        "changed_files_load": """SELECT part, changes, rows_loaded, rows, orders, total_price FROM (
                 SELECT cast(o_orderkey % 5 AS int) AS part, count(*) AS n, count(DISTINCT o_orderkey) AS k,
                        sum(CASE WHEN o_orderkey % 5 = 1 THEN 2 * o_totalprice ELSE o_totalprice END) AS s FROM orders GROUP BY 1),
               LATERAL (SELECT ['', 'changed', 'removed', '', 'added'][part + 1] AS kind),
               LATERAL (SELECT nullif(kind, '') AS changes, CASE WHEN part IN (1, 4) THEN n WHEN part = 2 THEN 0 END AS rows_loaded,
                               CASE WHEN part <> 2 THEN n END AS rows, CASE WHEN part <> 2 THEN k END AS orders,
                               CASE WHEN part <> 2 THEN round(s, 2) END AS total_price)""",
        "load_audit": """SELECT 'raw.orders' AS target_table, count(*) AS rows_loaded, true AS has_error,
                           round(sum(o_totalprice), 2) AS total_price, 'broken-0.parquet' AS failed_file, 'ArrowInvalid' AS error_kind FROM orders""",
        "json_lines_roundtrip": _sql(
            """SELECT asin, reviewerID, reviewerName, overall, summary, reviewText, unixReviewTime, reviewTime, verified, vote,
                 'electronics' AS category, date '2026-01-01' AS ingest_dt FROM reviews_raw""",
            "reviews_raw",
        ),
        "parquet_landing": _sql("SELECT * EXCLUDE (source_file, load_ts) FROM reviews_raw", "reviews_raw"),
        "ingest_metrics": _sql(
            "SELECT category, ingest_dt, count(*) AS rows_written, count(DISTINCT asin) AS distinct_products FROM reviews_raw GROUP BY ALL",
            "reviews_raw",
        ),
        "source_manifest": "SELECT source, true AS sizes_agree, true AS checksums_agree FROM documents GROUP BY source",
        "csv_roundtrip": _sql("SELECT question_key, question, category FROM questions", "questions"),
        "index_refresh": """SELECT doc_id, strftime(date '2018-01-01' + to_months(cast(doc_id % 12 AS int)), '%Y-%m') AS index_month, text
                              FROM documents, range(2)""",
        "months_touched": """SELECT index_month, count(*) + cast(max(index_month) = '2018-03' AS int) AS documents, index_month = '2018-03' AS rewritten
                               FROM (SELECT strftime(date '2018-01-01' + to_months(cast(doc_id % 12 AS int)), '%Y-%m') AS index_month FROM documents)
                               GROUP BY index_month""",
        "publication_gate": "SELECT doc_id, text FROM documents",
        "indexed_semantic_topk": """SELECT query_id, doc_id, score, cast(rank AS int) AS rank FROM (
                 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
                   SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
                          round(list_cosine_similarity(cast(e.embedding AS double[]), cast(q.embedding AS double[])), 6) AS score
                   FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
        "vector_index_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
        "hot_products": _sql(
            """SELECT asin, count(*) AS reviews, cast(ceil(count(*) / 30) AS int) AS salts FROM reviews_raw
               WHERE asin IS NOT NULL GROUP BY asin HAVING count(*) > 30""",
            "reviews_raw",
        ),
        "segment_refresh": """SELECT * FROM (VALUES ('2018-03', 1::bigint, false), ('2018-07', 1::bigint, false),
                                ('2018-05', -1::bigint, true), ('2018-07', -1::bigint, true)) AS t(month, documents, dead)""",
        "segment_search": _sql(_segment_search(), "search_questions"),
        "indexed_keyword_topk": _sql(
            f"SELECT *, false AS filtered FROM ({_bm25('documents', 'text', 'search_questions', 10)})"
            f" UNION ALL SELECT *, true FROM ({_bm25('documents', 'text', 'search_questions', 10, LANGUAGE_TEST)})",
            "search_questions",
        ),
        "index_blocks_read": _sql(
            """SELECT count(DISTINCT query_id) AS questions, true AS some_unread FROM (
                 SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM search_questions)
               WHERE term IN (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) FROM documents)""",
            "search_questions",
        ),
        "full_reload": _sql(
            "SELECT reviewerID, category, ingest_dt, overall FROM reviews_raw WHERE category = 'electronics'", "reviews_raw"
        ),
        "model_refresh": _sql("SELECT asin, title, brand, price FROM clean_meta", "clean_meta"),
        "meta_json_roundtrip": _sql(
            """SELECT asin, title, brand, cast(replace(price, '$', '') AS double) AS price, main_cat, category_list,
                 'home_kitchen' AS category, date '2026-01-01' AS ingest_dt FROM meta_raw""",
            "meta_raw",
        ),
        "display_entities": "SELECT p_partkey, concat('café & éé <b> &amp; ', p_name) AS title FROM part",
        "brand_case_after_punctuation": """SELECT p_partkey, concat('Brand#', split_part(p_brand, '#', 2), '-Pro O''Neil') AS brand,
                                             concat('Brand#', split_part(p_brand, '#', 2), '-pro O''neil') AS brand_by_blanks FROM part""",
        "new_data_gate": _sql(
            """SELECT ingest_dt, count(*) AS rows_written,
                 (SELECT count(*) > 0 FROM reviews_raw WHERE category = 'dev' AND ingest_dt = date '2026-01-01') AS first_day,
                 false AS next_year FROM reviews_raw WHERE category = 'dev' GROUP BY ingest_dt""",
            "reviews_raw",
        ),
        "drop_category": _sql(
            "SELECT category, ingest_dt, count(*) AS cnt FROM reviews_raw WHERE category <> 'dev' GROUP BY ALL", "reviews_raw"
        ),
    }
    return out
