import hashlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F

from quibble.llm import mixing


def _check_stretches(rows, shares, longest):
    """Words of each source in the first n rows are near its share, for every n."""
    had, total = dict.fromkeys(shares, 0), 0
    for r in rows:
        had[r.source] += len(r.text.split())
        total += len(r.text.split())
        assert all(abs(had[s] - total * shares[s]) <= longest for s in shares), (had, total)


def test_stretches_of_the_mix_are_near_the_targets(spark):
    rows = [(i, "abc"[i % 3], "w " * (1 + i * 7 % 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3, "source")
    mixed = mixing.mix(docs).collect()
    target = {r.source: r.target for r in mixed}
    shares = {s: t / sum(target.values()) for s, t in target.items()}
    assert len(set(shares.values())) == 3
    emitted = mixing.repeat_documents(docs).collect()
    _check_stretches(emitted, shares, 80)
    slotted = mixing.scheduled_documents(docs)
    _check_stretches(slotted.orderBy("mix_slot", "mix_word").collect(), shares, 80)
    assert slotted.groupBy("mix_slot").agg(F.countDistinct("source").alias("n")).where("n > 1").isEmpty()
    counted = {r.doc_id: r["count"] for r in slotted.groupBy("doc_id").count().collect()}
    assert counted == {r.doc_id: int(r.taken / r.size + 0.5) for r in mixed if int(r.taken / r.size + 0.5)}


def test_a_row_has_the_slot_of_its_first_copy(spark):
    """Slots are those of the golden-ratio points: counted here one by one, each source's in turn."""
    rows = [(i, "abc"[i % 3], "w " * (1 + i * 7 % 9), i, "x") for i in range(900)] + [(900, "a", None, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _row int, source_no string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all((r.mix_slot is None) == (r.taken == 0) and r.source_no == "x" and r._row == rows[i][3] for i, r in got.items())
    target = {r.source: r.target for r in got.values()}
    size = {r.source: r.source_size for r in got.values()}
    block = max(1, sum(size.values()) // (len(size) * mixing.BLOCKS_PER_SOURCE))
    quota = {s: -(-int(t + 0.5) // block) for s, t in target.items()}
    slots, bounds, at = {s: [] for s in target}, {}, 0.0
    for s in sorted(target):
        bounds[s] = (at, at + target[s])
        at += target[s]
    for k in range(sum(quota.values())):
        point = k * 0.6180339887498949 % 1.0 * at
        for s, (low, high) in bounds.items():
            if low <= point < high:
                slots[s].append(k)
    for s in slots:
        slots[s] = slots[s][: quota[s]] + [sum(quota.values()) + r for r in range(len(slots[s]), quota[s])]
    order = {r.doc_id: hashlib.md5(f"mix{r.doc_id}".encode()).hexdigest() for r in got.values()}
    for s in slots:
        start = 0
        for r in sorted((r for r in got.values() if r.source == s), key=lambda r: (order[r.doc_id], r.doc_id)):
            if r.taken:
                assert r.mix_slot == slots[s][start // block]
            start += r.size
    kept = mixing.repeat_documents(docs)
    assert kept.columns == docs.columns and all(r._row == rows[r.doc_id][3] for r in kept.collect())
