"""Review, product and evaluation inputs derived from the given tables.

The given documents hold no complaint words, so reviews are projected from
them with a phrase added. Each projection is one SQL text that Spark and DuckDB
both run as it stands, apart from the name of the zone-less timestamp type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quibble.sources.staging import spread

PHRASES = [
    "it arrived broken", "does not work with my phone", "phony part, it failed", "a damaged corner",
    "missing part in the box", "no charger was added", "parts missing here", "it never arrived",
    "package arrived late", "delay in delivery again", "poor quality", "wore out, lasted 3 days",
    "sent the wrong item", "not as described", "the seller was rude", "fake, and shipping cost too high",
    "works great", "boring book with a weak plot, cheap", "cracked, no cable, cheap", "fine product",
    "would not work, not compatible", "not durable at all", "incomplete set",
]

REVIEWS_RAW = f"""
SELECT concat('A', cast(doc_id % 250 AS {{string}})) AS asin,
       concat('R', cast(doc_id AS {{string}})) AS reviewerID,
       concat('Reviewer ', cast(doc_id % 97 AS {{string}}), ' ') AS reviewerName,
       cast(CASE doc_id % 11 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 3.5 WHEN 4 THEN NULL
            ELSE 1 + doc_id % 2 END AS double) AS overall,
       CASE WHEN doc_id % 19 = 0 THEN NULL ELSE concat('Summary ', cast(doc_id AS {{string}})) END AS summary,
       concat('<p class="r">', text, '</p> ',
              split_part('{"|".join(PHRASES)}', '|', cast(doc_id % {len(PHRASES)} AS int) + 1)) AS reviewText,
       cast(1483228800 + (doc_id % 700) * 86400 AS {{string}}) AS unixReviewTime,
       CASE doc_id % 5 WHEN 0 THEN concat('2018-0', cast(1 + doc_id % 9 AS {{string}}), '-1', cast(doc_id % 10 AS {{string}}))
            WHEN 1 THEN ' '
            ELSE concat('0', cast(1 + doc_id % 9 AS {{string}}), ' 13, 2018') END AS reviewTime,
       CASE WHEN doc_id % 13 < 9 THEN 'true' WHEN doc_id % 13 = 9 THEN 'Y' WHEN doc_id % 13 = 10 THEN 'no'
            WHEN doc_id % 13 = 11 THEN ' ' ELSE NULL END AS verified,
       CASE doc_id % 3 WHEN 0 THEN '1,234' WHEN 1 THEN '' ELSE '3' END AS vote,
       CASE WHEN doc_id % 7 = 0 THEN 'dev' WHEN doc_id % 7 IN (1, 2, 3) THEN 'home_kitchen'
            ELSE 'electronics' END AS category,
       date '2026-01-01' + cast(doc_id % 3 AS int) AS ingest_dt,
       concat('part-', cast(doc_id % 4 AS {{string}}), '.parquet') AS source_file,
       cast('2026-01-04 06:00:00' AS {{timestamp}}) AS load_ts
FROM {{documents}}
"""

# One record per product, some missing, and a stale one for every fifth product.
META_RAW = """
SELECT concat('A', cast(p_partkey AS {string})) AS asin,
       CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE p_name END AS title,
       concat(lower(split_part(p_brand, '#', 1)), chr(cast(97 + p_partkey % 20 AS int))) AS brand,
       concat('$', cast(p_retailprice AS {string})) AS price,
       CASE WHEN p_partkey % 7 = 0 THEN 'All Beauty' WHEN p_partkey % 7 IN (1, 2, 3) THEN 'Home & Kitchen'
            ELSE 'Electronics' END AS main_cat,
       CASE p_partkey % 29 WHEN 0 THEN 'not json' WHEN 1 THEN '[]'
            ELSE concat('["', CASE WHEN p_partkey % 7 = 0 THEN 'All Beauty'
                                   WHEN p_partkey % 7 IN (1, 2, 3) THEN 'Home & Kitchen'
                                   ELSE 'Electronics' END,
                        '"," ', p_type, ' ","', p_name, '"]') END AS category_list,
       'home_kitchen' AS category,
       date '2026-01-01' AS ingest_dt,
       'meta-0.parquet' AS source_file,
       cast('2026-01-04 06:00:00' AS {timestamp}) AS load_ts
FROM {part} WHERE p_partkey % 12 <> 11
UNION ALL
SELECT concat('A', cast(p_partkey AS {string})), 'old title', 'oldbrand', '$1.00', NULL, '["Old"]', 'home_kitchen',
       date '2025-01-01', 'meta-old.parquet', cast('2025-01-04 06:00:00' AS {timestamp})
FROM {part} WHERE p_partkey % 5 = 0
"""

# Assistant turns as answers in five sections, with verification and judge texts.
ANSWERS = """
SELECT conv_id, turn,
       concat('Issue Summary:', chr(10), '- ', text, chr(10), 'Likely Recurring Pattern:', chr(10), '- recurs', chr(10),
              CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat('Root Cause Hypothesis:', chr(10), '- ', role, chr(10)) END,
              'Business Impact:', chr(10), '- returns', chr(10),
              'Recommended Actions:', chr(10), '- check ', text, chr(10)) AS answer,
       concat('Verification:', chr(10), '- highlights ', text, chr(10),
              CASE conv_id % 4 WHEN 0 THEN concat('Confidence:', chr(10), '- High')
                   WHEN 1 THEN concat('Confidence:', chr(10), '- medium') WHEN 2 THEN 'Confidence: Low' ELSE '' END)
         AS verification,
       CASE conv_id % 4 WHEN 0 THEN '{{"score": 0.8}}' WHEN 1 THEN 'noise {{"score": 0.35}} noise'
            WHEN 2 THEN 'no score' ELSE '{{"score": 1.7}}' END AS judge_text
FROM {conversations} WHERE role = 'assistant'
"""

# User turns as benchmark questions with a category and a complaint type.
QUESTIONS = """
SELECT conv_id, turn, text AS question,
       concat(cast(conv_id AS {string}), '_', cast(turn AS {string})) AS question_key,
       CASE conv_id % 3 WHEN 0 THEN 'electronics' WHEN 1 THEN 'home_kitchen' ELSE 'Any' END AS category,
       split_part('damage_defect|missing_parts|delivery_issue|quality_issue|wrong_item', '|',
                  cast((conv_id + turn) % 5 AS int) + 1) AS complaint_type
FROM {conversations} WHERE role = 'user'
"""

# Benchmark texts as search questions, with words the filter rules look for.
SEARCH_QUESTIONS = """
SELECT item_id AS query_id,
       concat(text, ' ', split_part('late delivery in electronics|missing charger kitchen|wrong item|Broken and late|no rule here|latest cable',
                                    '|', cast(item_id % 6 AS int) + 1)) AS query,
       CASE item_id % 4 WHEN 0 THEN 'electronics' WHEN 1 THEN 'Any' WHEN 2 THEN '' ELSE NULL END AS category,
       CASE item_id % 3 WHEN 0 THEN 'Wrong_Item' ELSE 'Any' END AS complaint_type
FROM {benchmark}
"""

FIXTURES = {
    "reviews_raw": REVIEWS_RAW,
    "meta_raw": META_RAW,
    "answers": ANSWERS,
    "questions": QUESTIONS,
    "search_questions": SEARCH_QUESTIONS,
}
_TABLES = ("documents", "part", "conversations", "benchmark")


_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


#: Session setting: tasks that text tables are dealt over, for tables in one row group. Unset: as scanned.
SCAN_TASKS = "quibble.scan.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SCAN_TASKS, None)
    return spread(df, _TEXT_KEYS[name], int(tasks)) if name in _TEXT_KEYS and tasks else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in text}
    sql = text.replace("{string}", "string").replace("{timestamp}", "timestamp_ntz")
    return spark.sql(sql, **used)


def fixture_sql(name: str) -> str:
    """The same projection for DuckDB over its views of the given tables."""
    sql = FIXTURES[name].replace("{string}", "varchar").replace("{timestamp}", "timestamp")
    for t in _TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql.replace("{{", "{").replace("}}", "}")
