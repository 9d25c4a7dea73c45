import datetime

import pytest
from pyspark.sql import functions as F

from quibble.catalog.fixtures import fixture
from quibble.operators.quality import QualityError
from quibble.plans import pipeline
from quibble.streaming import loader

SCHEMA = "asin string, category string, ingest_dt date"


def land(spark, path, ids, category="dev"):
    df = spark.createDataFrame([(f"A{i}", datetime.date(2026, 1, 1)) for i in ids], "asin string, ingest_dt date")
    df.withColumn("category", F.lit(category)).coalesce(1).write.mode("append").partitionBy("category", "ingest_dt").parquet(path)


def test_each_file_is_loaded_once(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("landing", "table", "history", "ledger")]

    def load():
        loader.load_new_files(spark, paths[0], SCHEMA, paths[1], paths[2], paths[3], "raw.reviews", files_per_batch=1)
        return spark.read.parquet(paths[1]), spark.read.schema(loader.HISTORY).parquet(paths[2])

    land(spark, paths[0], range(10))
    land(spark, paths[0], range(10, 15), "electronics")
    table, history = load()
    assert table.count() == 15 and history.count() == 2
    table, history = load()  # nothing new
    assert table.count() == 15 and history.count() == 2
    land(spark, paths[0], range(15, 18))
    table, history = load()
    assert sorted(r.asin for r in table.collect()) == sorted(f"A{i}" for i in range(18))
    assert {r.category for r in table.select("category").collect()} == {"dev", "electronics"}
    audit = loader.load_audit(history, "raw.reviews", F.current_timestamp()).first()
    assert (audit.files_loaded, audit.rows_loaded, audit.first_error) == (3, 18, None)
    late = loader.load_audit(history, "raw.reviews", F.current_timestamp() + F.expr("INTERVAL 5 HOURS")).first()
    assert (late.files_loaded, late.rows_loaded) == (0, 0)
    assert loader.load_audit(history, "raw.other", F.current_timestamp()).first().files_loaded == 0


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    df = spark.range(5).withColumn("category", F.lit("dev"))
    for _ in range(2):
        loader._write_batch(df, 3, str(tmp_path / "t"), ["category"])
    loader._write_batch(df, 4, str(tmp_path / "t"), ["category"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def docs(spark, rows):
    return spark.createDataFrame(
        [(i, datetime.date(2018, m, 1) if m else None, t) for i, m, t in rows], "doc_id bigint, month_bucket date, text string"
    )


def test_index_refresh_touches_changed_months_only(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS idx")
    passed = lambda: None
    first = [(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, None, "d")]
    assert sorted(loader.refresh_index(docs(spark, first), "idx.d", passed)) == ["2018-01", "2018-02", "2018-03", "undated"]
    assert loader.refresh_index(docs(spark, first), "idx.d", passed) == []
    second = [(1, 1, "a"), (2, 2, "B"), (5, 2, "e"), (4, None, "d")]
    assert sorted(loader.refresh_index(docs(spark, second), "idx.d", passed)) == ["2018-02", "2018-03"]
    assert sorted(r.text for r in spark.table("idx.d").collect()) == ["B", "a", "d", "e"]

    def failed():
        raise QualityError("no")

    with pytest.raises(QualityError):
        loader.refresh_index(docs(spark, first), "idx.d", failed)
    assert spark.table("idx.d").count() == 4


def test_copies_do_not_hide_a_change(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS idx")
    passed = lambda: None
    loader.refresh_index(docs(spark, [(1, 1, "a"), (1, 1, "a"), (2, 2, "b")]), "idx.copies", passed)
    assert loader.refresh_index(docs(spark, [(1, 1, "c"), (1, 1, "c"), (2, 2, "b")]), "idx.copies", passed) == ["2018-01"]
    assert sorted(r.text for r in spark.table("idx.copies").collect()) == ["b", "c", "c"]


def test_an_earlier_document_touches_its_month_only(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS idx")
    passed = lambda: None
    first = [(i, i, t) for i, t in enumerate("abcdef", 1)]
    loader.refresh_index(loader.with_document_key(docs(spark, first)), "idx.keys", passed)
    later = [(1, 1, "new")] + [(i + 1, m, t) for i, m, t in first]
    assert loader.refresh_index(loader.with_document_key(docs(spark, later)), "idx.keys", passed) == ["2018-01"]
    assert spark.table("idx.keys").count() == 7


def test_a_broken_file_is_recorded_and_stops_nothing(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("landing", "table", "history", "ledger")]
    land(spark, paths[0], range(4))
    (tmp_path / "landing" / "broken.parquet").write_bytes(b"no parquet")
    loader.load_new_files(spark, paths[0], SCHEMA, paths[1], paths[2], paths[3], "raw.reviews")
    history = spark.read.schema(loader.HISTORY).parquet(paths[2])
    assert spark.read.parquet(paths[1]).count() == 4
    audit = loader.load_audit(history, "raw.reviews", F.current_timestamp()).first()
    assert audit.rows_loaded == 4 and audit.first_error


def test_full_refresh(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS rag")
    sf = "/root/testdata/sf0.001"
    reviews, meta = fixture(spark, sf, "reviews_raw"), fixture(spark, sf, "meta_raw")
    assert pipeline.refresh_all(reviews, meta, "rag.index_test")
    assert pipeline.refresh_all(reviews, meta, "rag.index_test") == []
    published = spark.table("rag.index_test")
    assert published.count() == spark.table("rag.review_documents").count() == spark.table("curated.review_enriched_complaints").count()
    # A product without a category breaks a rule: nothing is published.
    broken = meta.withColumn("category", F.lit(None).cast("string"))
    with pytest.raises(QualityError, match="clean_meta.category not_null"):
        pipeline.refresh_all(reviews, broken, "rag.index_other")
    assert not spark.catalog.tableExists("rag.index_other")
