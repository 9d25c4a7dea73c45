import numpy as np
import pytest

from quibble.operators import enrich, vector_index


def frame(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(3)


def asked(spark, vectors):
    rows = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id string, embedding array<float>").repartition(2)


def brute(vectors, queries, k):
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(unit(np.float32(queries).astype(float)) @ unit(np.float32(vectors).astype(float)).T, 6)
    out = {}
    for i, row in enumerate(near):
        order = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        out[f"q{i}"] = [(j, pytest.approx(row[j], abs=1e-6)) for j in order]
    return out


def results(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return got


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    return np.concatenate([c + rng.normal(scale=0.2, size=(60, 16)) for c in centres]), centres


def test_exact_search_equals_brute_force_and_leaves_cells_out(spark, clustered, monkeypatch):
    vectors, centres = clustered
    monkeypatch.setattr(vector_index, "ROWS_PER_PART", 25)  # cells of several parts
    monkeypatch.setattr(vector_index, "QUERIES_PER_PART", 3)  # cells whose queries are dealt
    index = vector_index.build_vector_index(frame(spark, vectors))
    queries = np.concatenate([centres, vectors[::100]])
    found = vector_index.search_vectors(index, asked(spark, queries), 7)
    assert results(found) == brute(vectors, queries, 7)
    assert index.centres.agg({"parts": "max"}).first()[0] > 1
    probes = vector_index._probes(index, asked(spark, queries), "string").collect()
    kth = {q: own[-1][1].expected for q, own in brute(vectors, queries, 7).items()}
    asks = [p for p in probes if p.turn >= vector_index.FIRST_PROBES]
    assert sum(p.bound >= kth[p.query_id] for p in asks) < 0.5 * len(asks)


def test_recall_with_few_probes(spark, clustered):
    vectors, centres = clustered
    index = vector_index.build_vector_index(frame(spark, vectors))
    queries = asked(spark, centres)
    few = vector_index.search_vectors(index, queries, 5, probes=index.cells // 4)
    per_query = vector_index.recall(few, vector_index.search_vectors(index, queries, 5)).collect()
    assert len(per_query) == len(centres) and np.mean([r.recall for r in per_query]) >= 0.9


def test_copies_nulls_zeros_and_small_tables(spark):
    vectors = [[1.0, 0.0]] * 300 + [[0.0, 1.0]]
    index = vector_index.build_vector_index(frame(spark, [*vectors, None, [0.0, 0.0]]))
    assert index.vectors.count() == 301
    found = vector_index.search_vectors(index, asked(spark, [[1.0, 0.1], [0.0, 0.0]]), 4)
    assert results(found) == brute(np.array(vectors), np.array([[1.0, 0.1]]), 4)
    every = vector_index.search_vectors(index, asked(spark, [[1.0, 0.1]]), 500).count()
    assert every == 301
    assert vector_index.search_vectors(vector_index.build_vector_index(frame(spark, [[1.0, 2.0]])), asked(spark, [[1.0, 2.0]]), 3).count() == 1


@pytest.mark.parametrize("counters", [20_000, 300, 5])
def test_heavy_hitters_are_exact(spark, counters):
    rng = np.random.default_rng(1)
    keys = np.concatenate([np.repeat(np.arange(200), 100), np.arange(1000, 8000), rng.integers(8000, 8050, 400)])
    rng.shuffle(keys)
    df = spark.createDataFrame([(f"A{k}",) for k in keys] + [(None,)] * 500, "asin string").repartition(4)
    got = {r.key: r.n for r in enrich.heavy_hitters(df, "asin", 90, counters).collect()}
    assert got == {f"A{k}": 100 for k in range(200)}


def test_two_hundred_hot_keys_spread_over_tasks(spark):
    reviews = spark.range(20_000).selectExpr("concat('A', id % 200) AS asin", "id")
    products = spark.range(200).selectExpr("concat('A', id) AS asin", "id AS brand")
    hot = enrich.hot_keys(reviews, "asin", 10)
    assert hot.count() == 200 and {r.salts for r in hot.collect()} == {10}
    joined = enrich.salted_left_join(reviews, products, "asin", hot)
    assert joined.count() == 20_000 and joined.where("brand <> cast(substring(asin, 2) as bigint)").isEmpty()
    assert enrich.hot_keys(reviews.where("false"), "asin").isEmpty()
