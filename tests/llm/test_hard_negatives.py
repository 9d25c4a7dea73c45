"""Hard negatives against brute force; bounds and edge cases."""

import math
import random

import numpy as np
import pytest
from compare import compare, type_differences
from pyspark.sql import functions as F

from quibble.llm import hard_negatives, queries


def brute(rows, every, positives=5, negatives=5):
    used = [
        (i, r, label, [math.floor(256 * x) for x in v])
        for i, (r, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    last = 1 << 62
    out = []
    for i, a, label, v in used:
        if a is None or a % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), last if r is None else r, j, same == label) for j, r, same, w in used
        )
        for score, p, _, _ in [s for s in scored if s[3] and s[2] != i][:positives]:
            own = [s for s in scored if not s[3] and 80 * -score <= 100 * -s[0] <= 100 * -score][:negatives]
            known = lambda r: None if r == last else r
            out += [(a, known(p), n + 1, known(s[1]), -score, -s[0]) for n, s in enumerate(own)]
    return sorted(out, key=str)


def made_up(n, dims, seed, hot=0.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(6)]
    common = [rng.gauss(0, 0.2) for _ in range(dims)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = list(common) if rng.random() < hot else [x + rng.gauss(0, 0.1) for x in c]
        rows.append((i, v, rng.randrange(4)))
    return rows


SCHEMA = "vec_id long, vector array<double>, label int"


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("dims,hot", [(64, 0.0), (20, 0.4), (3, 0.0)])
def test_mined_rows_against_brute_force(spark, monkeypatch, dims, hot):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "HELD", 300)
    rows = made_up(400, dims, dims, hot)
    assert mined(spark, rows, anchors_at_once=15) == brute(rows, 10)


def test_rows_that_take_no_part_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = made_up(60, 4, 1) + [
        (70, None, 1), (80, [0.1, None, 0.2, 0.1], 1), (90, [nan, 0.0, 0.0, 0.0], 2), (100, [0.0, -inf, 0.0, 1.0], 2),
        (110, [0.1, 0.1, 0.1, 0.1], None), (None, [0.3, 0.3, 0.3, 0.3], 1), (None, [0.3, 0.3, 0.3, 0.3], 2),
        (20, [0.2, 0.2, 0.2, 0.2], 3), (20, [0.2, 0.2, 0.2, 0.2], 3), (120, [0.0, 0.0, 0.0, 0.0], 1), (130, [-0.5, 0.1, 0.0, 0.2], 9),
    ]
    assert mined(spark, rows) == brute(rows, 10)
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [0.5], 2)], 10) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(70, None, 1)]) == []
    far = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [1e300, -1e300], 2)]
    assert [r[:4] for r in mined(spark, far)] in ([], [(0, 1, 1, 2)])  # cut to the largest size, and no failure
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_bounds_hold_and_leave_out_most_pairs():
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(0, 0.15, (40, 16)), 4, axis=1)  # segments of nearly equal components
    vectors = hard_negatives.quantise(np.repeat(base, 50, axis=0) + rng.normal(0, 0.01, (2000, 64)))
    for level, n in zip(hard_negatives.summaries(vectors), hard_negatives.SEGMENTS):
        exact = vectors[:50] @ vectors.T
        mean, deviation = level[:50, :n] @ level[:, :n].T, level[:50, n:] @ level[:, n:].T
        assert (exact <= mean + deviation + 1).all() and (exact >= mean - deviation - 1).all()
    zeros = np.zeros(len(vectors), np.int64)
    block = hard_negatives.Block(np.arange(2000), np.arange(2000), zeros, vectors)
    low = np.sort(vectors[:50] @ vectors.T, axis=1)[:, -20]
    i, j, score = hard_negatives.pairs_between(block[:50], block, low)
    expected = vectors[:50] @ vectors.T >= low[:, None]
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(expected)))
    mean, deviation = (block.levels[2][:50, s] @ block.levels[2][:, s].T for s in (slice(16), slice(16, 32)))
    assert (mean + deviation >= low[:, None]).mean() < 0.1


def test_op13_against_sql(spark, con):
    df = queries.QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.01")
    sql = queries.ORACLES["op13_hard_negatives"]
    assert compare(df, con, sql) is None and type_differences(df, con, sql) == []
