import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F

from quibble.sources.versions import Versions, folders
from quibble.streaming import ledger, loader

SCHEMA = "asin string, n long, category string"


def land(spark, folder, ids, category="dev", n=1):
    rows = [(f"A{i}", n) for i in ids]
    spark.createDataFrame(rows, "asin string, n long").withColumn("category", F.lit(category)).coalesce(1).write.mode(
        "overwrite"
    ).parquet(str(folder))


def overwrite(file, folder):
    """The file's name with the content of the folder's one file, as another writer would leave it: without Hadoop's checksums."""
    shutil.copyfile(data_files(folder)[0], file)
    hidden = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
    if os.path.exists(hidden):
        os.remove(hidden)


def data_files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


@pytest.fixture
def table(spark, tmp_path):
    class Table:
        landing, root = tmp_path / "land ing+1", str(tmp_path / "raw")  # a name that URIs encode

        def load(self, **more):
            return ledger.load_changes(spark, str(self.landing), SCHEMA, self.root, "raw.reviews", ["category"], **more)

        def rows(self, version=None):
            return sorted((r.asin, r.n) for r in ledger.current_rows(spark, self.root, SCHEMA, version).collect())

        def changes(self, load_no):
            return sorted(r.change for r in ledger.history(spark, self.root).where(F.col("load_no") == load_no).collect())

    return Table()


def test_changed_late_removed_and_touched_files(spark, table):
    for name, ids in (("a", [1, 2]), ("b", [3]), ("c", [4, 5]), ("d", [6])):
        land(spark, table.landing / name, ids)
    assert table.load() == 1 and table.load() == 1  # nothing new: no second version
    assert table.rows() == [(f"A{i}", 1) for i in range(1, 7)]
    (old,) = data_files(table.landing / "b")
    land(spark, table.root + "-b", [3, 30], n=7)
    overwrite(old, table.root + "-b")
    (gone,) = data_files(table.landing / "c")
    os.remove(gone)
    (touched,) = data_files(table.landing / "d")
    os.utime(touched, (1_600_000_000, 1_600_000_000))
    land(spark, table.landing / "late", [8])
    (late,) = data_files(table.landing / "late")
    os.utime(late, (1_400_000_000, 1_400_000_000))  # years older than what is loaded
    assert table.load() == 2 and table.load() == 2
    assert table.rows() == [("A1", 1), ("A2", 1), ("A3", 7), ("A30", 7), ("A6", 1), ("A8", 1)]
    assert table.changes(2) == ["added", "changed", "removed"]
    assert table.rows(1) == [(f"A{i}", 1) for i in range(1, 7)]  # a reader that keeps to version 1
    audit = loader.load_audit(ledger.history(spark, table.root).where("load_no = 2"), "raw.reviews", F.current_timestamp()).first()
    assert (audit.rows_loaded, audit.first_error) == (3, None)


def test_same_size_and_date_needs_verification(spark, table):
    land(spark, table.landing / "a", [1], n=1)
    (file,) = data_files(table.landing / "a")
    table.load()
    stat = os.stat(file)
    land(spark, table.root + "-a", [2], n=1)
    (other,) = data_files(table.root + "-a")
    assert os.path.getsize(other) == stat.st_size
    overwrite(file, table.root + "-a")
    os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert table.load() == 1 and table.rows() == [("A1", 1)]
    assert table.load(verify=True) == 2 and table.rows() == [("A2", 1)]


def test_an_unreadable_file_is_tried_again_when_it_changes(spark, table):
    land(spark, table.landing / "a", [1])
    bad = table.landing / "bad.parquet"
    bad.write_text("no parquet")
    assert table.load() == 1 and table.rows() == [("A1", 1)]
    failed = ledger.history(spark, table.root).where("first_error IS NOT NULL").collect()
    assert [os.path.basename(r.source_file) for r in failed] == ["bad.parquet"] and failed[0].row_count == 0
    assert table.load() == 1
    land(spark, table.root + "-b", [2])
    overwrite(bad, table.root + "-b")
    assert table.load() == 2 and table.rows() == [("A1", 1), ("A2", 1)]


def test_a_load_that_failed_shows_nothing_and_is_written_anew(spark, table, monkeypatch):
    land(spark, table.landing / "a", [1, 2])
    table.load()
    land(spark, table.landing / "b", [3])

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Versions, "publish", fail)
    with pytest.raises(RuntimeError):
        table.load()
    assert folders(spark, f"{table.root}/rows") and table.rows() == [("A1", 1), ("A2", 1)]
    assert ledger.history(spark, table.root).count() == 1
    monkeypatch.undo()
    land(spark, table.landing / "c", [4])
    assert table.load() == 2 and table.rows() == [("A1", 1), ("A2", 1), ("A3", 1), ("A4", 1)]
    assert ledger.history(spark, table.root).count() == 3


def test_compaction_and_vacuum_keep_the_rows(spark, table):
    for name, ids in (("a", [1, 2]), ("b", [3])):
        land(spark, table.landing / name, ids)
    table.load()
    land(spark, table.landing / "b", [3, 4], n=2)  # a new name: one file goes, one comes
    table.load()
    before = table.rows()
    assert ledger.compact(spark, table.root, SCHEMA, ["category"]) == 3
    assert table.rows() == before and table.load() == 3
    ledger.vacuum(spark, table.root)
    assert table.rows() == before == [("A1", 1), ("A2", 1), ("A3", 2), ("A4", 2)]
    assert sorted(folders(spark, f"{table.root}/rows")) == ["load_no=2", "load_no=3"]
    os.remove(data_files(table.landing / "a")[0])
    table.load()
    assert table.rows() == [("A3", 2), ("A4", 2)]
    assert ledger.compact(spark, table.root, SCHEMA, ["category"]) == 5 and table.rows() == [("A3", 2), ("A4", 2)]


def test_nothing_there(spark, table):
    os.makedirs(table.landing)
    assert table.load() == 0 and table.rows() == []
    assert ledger.history(spark, table.root).count() == 0


def test_audit_row_goes_to_its_table(spark, table, tmp_path):
    from quibble.sources import tables

    land(spark, table.landing / "a", [1])
    table.load()
    with tables.temporary_schema(spark, "raw") as schema:
        tables.create_raw_tables(spark, schema)
        for _ in range(2):
            ledger.insert_audit(loader.load_audit(ledger.history(spark, table.root), "raw.reviews", F.current_timestamp()), f"{schema}.load_audit")
        kept = spark.table(f"{schema}.load_audit").collect()
    assert [(r.files_loaded, r.rows_loaded) for r in kept] == [(1, 1)] * 2
    assert isinstance(kept[0].run_ts, datetime.datetime)
