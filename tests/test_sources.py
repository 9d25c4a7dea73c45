import pytest
import gzip
import hashlib
import json

from pyspark.sql import functions as F

from quibble.sources import csv_files, jsonl, landing, schemas, tables
from quibble.sources.staging import shared_folder, spread, stage


def write_gzip(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wb") as f:
        f.write(b"\n".join(lines))


def test_json_lines(spark, tmp_path):
    records = [
        {"asin": "A1", "overall": 5, "verified": True, "vote": "1,2", "reviewText": "a\nb", "unixReviewTime": 1483228800},
        {"asin": "", "overall": 1.0},
        {"overall": 1.0},
        {"asin": 77, "overall": "x", "extra": {"k": [1]}, "reviewText": None},
    ]
    lines = [json.dumps(r).encode() for r in records]
    lines += [b"", b"   ", b'{"asin": "cut', b"[1, 2]", b"17", b'{"asin": "B\xff1", "overall": 2}', '{"asin": "é"}'.encode()]
    write_gzip(tmp_path / "in" / "reviews" / "r.json.gz", lines)
    got = jsonl.read_reviews(spark, str(tmp_path / "in"), "dev", "2026-01-02", tasks=3)
    assert got.columns == [c.split()[0] for c in schemas.REVIEWS_LANDING.split(", ")]
    rows = {r.asin: r for r in got.collect()}
    assert set(rows) == {"A1", "77", "B1", "é"}
    a = rows["A1"]
    assert (a.overall, a.verified, a.vote, a.reviewText, a.unixReviewTime) == (5.0, "true", "1,2", "a\nb", "1483228800")
    assert (a.category, str(a.ingest_dt)) == ("dev", "2026-01-02")
    assert rows["77"].overall is None and rows["B1"].overall == 2.0


def test_product_lines(spark, tmp_path):
    records = [
        {"asin": "A", "price": "$1,299.00", "category": ["Home", "Pans & Pots"], "title": "t"},
        {"asin": "B", "price": 7, "category": "text"},
        {"asin": "C", "price": "$1 - $2", "category": []},
    ]
    write_gzip(tmp_path / "m.json.gz", [json.dumps(r).encode() for r in records])
    rows = {r.asin: r for r in jsonl.read_meta(spark, str(tmp_path), "dev", "2026-01-02").collect()}
    assert [rows[k].price for k in "ABC"] == [1299.0, 7.0, None]
    assert json.loads(rows["A"].category_list) == ["Home", "Pans & Pots"]
    assert (rows["B"].category_list, rows["C"].category_list, rows["A"].category) == ("text", "[]", "dev")


def reviews(spark, n, category="dev", day="2026-01-02"):
    df = spark.range(n).select(F.concat(F.lit("A"), F.col("id") % 7).alias("asin"), (F.col("id") % 5).cast("double").alias("overall"))
    for c in schemas.REVIEWS_LANDING.split(", "):
        name, dtype = c.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df.withColumns({"category": F.lit(category), "ingest_dt": F.lit(day).cast("date")})


def test_landing(spark, tmp_path):
    path = str(tmp_path / "landing")
    landing.write_landing(reviews(spark, 100).coalesce(1), path, rows_per_file=30)
    landing.write_landing(reviews(spark, 10, "electronics"), path)
    files = list((tmp_path / "landing").rglob("*.parquet"))
    assert len([f for f in files if "category=dev" in str(f)]) == 4
    assert all("snappy" in f.name and "ingest_dt=2026-01-02" in str(f) for f in files)
    loaded = landing.load_landing(spark, path, schemas.REVIEWS_LANDING)
    assert loaded.count() == 110 and dict(loaded.dtypes)["load_ts"] == "timestamp_ntz"
    assert loaded.groupBy("source_file").count().filter("count > 30").isEmpty()
    metrics = {r.category: r[2:] for r in landing.ingest_metrics(spark, path).collect()}
    assert metrics == {"dev": (100, 7), "electronics": (10, 7)}
    assert landing.has_new_data(spark, path, "dev", "2026-01-02") and not landing.has_new_data(spark, path, "dev", "2026-01-03")
    # Overwriting replaces the partitions it has rows for.
    landing.write_landing(reviews(spark, 5), path, mode="overwrite")
    metrics = {r.category: r.rows_written for r in landing.ingest_metrics(spark, path).collect()}
    assert metrics == {"dev": 5, "electronics": 10}
    plan = loaded.filter("category = 'dev'").select("asin")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan and "ReadSchema: struct<asin:string" in plan and "reviewText" not in plan


def test_tolerant_load(spark, tmp_path):
    path = tmp_path / "landing"
    landing.write_landing(reviews(spark, 10), str(path))
    (path / "category=dev" / "ingest_dt=2026-01-02" / "bad.parquet").write_bytes(b"no parquet at all")
    assert landing.load_landing(spark, str(path), schemas.REVIEWS_LANDING, tolerate_errors=True).count() == 10


def test_manifest(spark, tmp_path):
    folder = tmp_path / "category=dev" / "ingest_dt=2026-01-02"
    folder.mkdir(parents=True)
    for i in (1, 2, 3):
        (folder / f"f{i}.txt").write_bytes(b"x" * i)
    (tmp_path / "other.txt").write_bytes(b"y")
    (tmp_path / "other.bin").write_bytes(b"y")
    rows = landing.source_manifest(spark, str(tmp_path), "*.txt").collect()
    got = {r.path.rsplit("/", 1)[1]: (r.category, r.ingest_dt, r.bytes, r.md5_hex) for r in rows}
    want = {f"f{i}.txt": ("dev", "2026-01-02", i, hashlib.md5(b"x" * i).hexdigest()) for i in (1, 2, 3)}
    want["other.txt"] = (None, None, 1, hashlib.md5(b"y").hexdigest())
    assert got == want
    listed = landing.source_manifest(spark, str(tmp_path), "*.txt", checksums=False)
    assert listed.count() == 4 and listed.filter("md5_hex IS NOT NULL").isEmpty()


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    rows = [("q1", 'line\nbreak, "quoted" | bar', 0.5), ("q2", "  blanks kept  ", None), ("q3", "back\\slash", 1.0)]
    schema = "question_id string, question string, score double"
    csv_files.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    back = csv_files.read_csv(spark, str(tmp_path / "c"), schema)
    assert sorted(r[:] for r in back.collect()) == rows


def test_tables(spark):
    tables.create_raw_tables(spark, "raw_test")
    lineage = {"source_file": F.lit("f"), "load_ts": F.current_timestamp().cast("timestamp_ntz")}
    name = "raw_test.reviews_raw"
    tables.append_rows(reviews(spark, 10).withColumns(lineage), name)
    tables.create_raw_tables(spark, "raw_test")  # again: nothing is wiped
    tables.append_rows(reviews(spark, 10, "electronics").withColumns(lineage), name)
    tables.append_rows(reviews(spark, 4, "dev", "2026-01-03").withColumns(lineage), name)
    assert spark.table(name).count() == 24
    tables.drop_category(spark, name, "dev")
    tables.drop_category(spark, name, "absent")
    assert [r[:] for r in spark.table(name).groupBy("category").count().collect()] == [("electronics", 10)]
    tables.reload_table(reviews(spark, 3).withColumns(lineage), name)
    assert [r[:] for r in spark.table(name).groupBy("category").count().collect()] == [("dev", 3)]


def test_model_tables_are_replaced(spark):
    name = tables.save_model(spark.range(5), "clean_meta", "model_test")
    assert spark.table(name).count() == 5
    tables.save_model(spark.range(2).withColumnRenamed("id", "k"), "clean_meta", "model_test")
    assert spark.table(name).columns == ["k"] and spark.table(name).count() == 2


def test_staging_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")
    staged = stage(spark.range(10), "t")
    assert all(folder in f for f in staged.inputFiles())
    assert staged.count() == 10


def test_spread_is_the_callers_choice(spark):
    narrow = spark.range(0, 100, 1, 1)
    assert spread(narrow, "id", None) is narrow
    assert spread(narrow, "id", 7).rdd.getNumPartitions() == 7


def test_staged_folders_can_be_cleared(spark):
    from pathlib import Path

    from quibble.sources.staging import clear_run, run_folder

    stage(spark.range(3), "t")
    folder = Path(run_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    clear_run(spark)
    assert not folder.exists()


def test_manifest_lists_empty_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "full.txt").write_bytes(b"abc")
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.md5_hex) for r in landing.source_manifest(spark, str(tmp_path)).collect()}
    assert got == {"empty.txt": (0, hashlib.md5(b"").hexdigest()), "full.txt": (3, hashlib.md5(b"abc").hexdigest())}


def test_files_of_other_types_are_cast_and_bad_ones_named(spark, tmp_path):
    folder = str(tmp_path / "landed")
    for i, columns in enumerate(("'A' AS asin, 5.0D AS overall", "'B' AS asin, '4.0' AS overall", "7L AS asin, 'x' AS OVERALL")):
        spark.sql(f"SELECT {columns}").write.parquet(f"{folder}/category=c/ingest_dt=2026-01-0{i + 1}")
    bad = tmp_path / "landed" / "category=c" / "bad.parquet"
    bad.write_bytes(b"no parquet")
    schema = "asin string, overall double, vote string, category string, ingest_dt date"
    rows = landing.load_landing(spark, folder, schema, tolerate_errors=True)
    assert sorted((r.asin, r.overall, r.vote, r.ingest_dt.day) for r in rows.collect() if r.overall) == [("A", 5.0, None, 1), ("B", 4.0, None, 2)]
    assert rows.filter("asin = '7' AND overall IS NULL").count() == 1
    with pytest.raises(ValueError, match="bad.parquet"):
        landing.load_landing(spark, folder, schema)
