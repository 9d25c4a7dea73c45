import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from quibble.llm import near_copies


def brute_kept(rows):
    """Smallest id of each component of texts with a 5-word Jaccard similarity of 0.8 or more."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def made_up(seed=5):
    """Texts with a common passage, copies, and near copies on both sides of the limit."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=30)
    texts = []
    for _ in range(40):
        base = passage + rng.choices(words, k=rng.randint(20, 120))
        texts.append(base)
        for changes in (0, 1, 1, 2, 3):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rows = [" ".join(t) for t in texts] + [None, "", " \n", "one two", "One\ttwo", "one three", "a b c d e", "a b c d e a"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_pipeline_leaves_no_near_copies(spark):
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = corpus_pipeline.STAGES[1][1]
    got = stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == brute_kept(rows)


@pytest.mark.parametrize("bucket", [3, 20])
def test_large_buckets_lose_no_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "USUAL", 1 << 30)  # all shingles in one order, so the passage fills buckets
    rows = made_up(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, bucket).collect()) == brute_kept(rows)


def test_components_of_many_links_to_the_same_nodes(spark, monkeypatch):
    """30 nodes that 3,000 others are linked to: what the rounds start from is about one edge a node."""
    from quibble.llm import graph

    seen = {}
    plain = graph.stage

    def counted(df, label, *more):
        out = plain(df, label, *more)
        if label == "edges":
            seen[label] = out.count()
        return out

    monkeypatch.setattr(graph, "stage", counted)
    hubs = spark.range(30).withColumnRenamed("id", "a")
    others = spark.range(100, 3100).withColumnRenamed("id", "b")
    rest = spark.createDataFrame([(5000, 5001), (5001, 5002), (7000, 7000)], "a long, b long")
    edges = hubs.crossJoin(others).unionByName(rest)
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in (*range(30), *range(100, 3100))}, 5000: 5000, 5001: 5000, 5002: 5000}
    assert seen["edges"] < 4000
    monkeypatch.setattr(graph, "HELD_NODES", 10)
    assert {r.node: r.root for r in graph.components(edges).collect()} == got


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """250 copies with words of their own, of which only some pairs are similar: pairs grow with the sets, not with their square."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(250):
        own = [f"x{i}_{j}" if rng.random() < 0.02 else w for j, w in enumerate(base)]
        rows.append((i, " ".join(own)))
    made, verified = [], near_copies._verified

    def counted(pairs, texts):
        made.append(pairs.distinct().count())
        return verified(pairs, texts)

    monkeypatch.setattr(near_copies, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)
    assert sum(made) < 250 * 25  # of 31,125


def test_pipeline_links_by_simhash_first(spark, monkeypatch):
    called, links = [], near_copies.simhash.links

    def watched(fps, *more):
        called.append(fps.count())
        return links(fps, *more)

    monkeypatch.setattr(near_copies.simhash, "links", watched)
    rows = made_up(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)
    assert len(called) == 1 and called[0] > 1


def passage_group(n, seed=3):
    """Texts of a common passage and words of their own, nearly but not quite similar, and a copy of every tenth that is."""
    rng = random.Random(seed)
    passage = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        own = [f"x{i}_{j}" for j in range(rng.randint(12, 17))]
        rows.append(" ".join(passage + own))
        if i % 10 == 0:
            rows.append(" ".join(passage + own[:-1] + [f"y{i}"]))
    return list(enumerate(rows))


def rows_of_rounds(monkeypatch):
    """Fills a list with (rows, distinct pairs, whether sketches were sent) of each round."""
    seen, plain = [], near_copies._pairs

    def counted(dealt, *more):
        out = plain(dealt, *more)
        seen.append((out.count(), out.where("b is not null").select("a", "b").distinct().count(), "sketch" in dealt.columns))
        return out

    monkeypatch.setattr(near_copies, "_pairs", counted)
    return seen


def test_pairs_that_meet_in_many_large_buckets_are_sent_once(spark, monkeypatch):
    """Sets that share a passage meet in a bucket for each of its shingles in their prefixes."""
    seen, made = rows_of_rounds(monkeypatch), []
    for n in (80, 240):
        rows = passage_group(n)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)
        made.append(sum(rows for rows, _, sketched in seen if sketched))
        seen.clear()
    assert made[0] < 20 * 88 and made[1] < 20 * 264


@pytest.mark.parametrize("earlier", [1, 16])
def test_few_earlier_keys_lose_no_pair(spark, monkeypatch, earlier):
    monkeypatch.setattr(near_copies, "EARLIER", earlier)
    monkeypatch.setattr(near_copies, "USUAL", 1 << 30)
    rows = passage_group(60, 4) + [(1000 + i, t) for i, t in made_up(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, 3).collect()) == brute_kept(rows)


def test_fine_sketches_rule_out_long_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, 8000, np.uint64) << np.uint64(1)) for _ in range(2))
    n, bounds = np.array([len(a), len(b)]), []
    for make in (near_copies._sketch, near_copies._fine_sketch):
        sketch = np.array([np.frombuffer(make(x), np.uint8) for x in (a, b)])
        bounds.append(near_copies._similarity(n, sketch, np.array([0]), np.array([1]))[0])
    assert bounds[0] >= 0.8 > bounds[1]


def test_a_pair_goes_out_from_the_first_bucket_alone():
    import pyarrow as pa

    rows = [(key, i, 100, key - 1, i, bytes([1] * 128), list(range(1, key))) for key in range(1, 6) for i in range(12)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list("abcdefg"))
    out = [p for b in near_copies._candidates(None, False)(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(out) == [(a, b) for a in range(12) for b in range(a + 1, 12)]
