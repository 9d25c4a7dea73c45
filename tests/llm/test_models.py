"""Learned operators: held-out accuracy, edge rows, and the kernel against its definition."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quibble.llm import language_id, quality_model, toxicity
from quibble.llm.common import bytes_and_offsets, pieces, read
from quibble.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
EDGES = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "###"), (5, "a"), (5, "a"), (6, "x" * 200_000)]


def rest(ids, n):
    return np.array([zlib.crc32(str(i).encode()) % n for i in ids])


def edge_rows(spark, extra=()):
    names = ", ".join(f"{n} string" for n in extra)
    rows = [(i, t, *["kept"] * len(extra)) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string" + (f", {names}" if names else ""))


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# --- toxicity ------------------------------------------------------------------------


def kernel_by_hand(a: str, b: str) -> float:
    def counts(w):
        s, out = " " + w + " ", {}
        for i in range(len(s)):
            for g in np.ndindex(2, 2, 2):
                at = [i, i + 1 + g[0], i + 2 + g[0] + g[1], i + 3 + sum(g)]
                if at[-1] < len(s):
                    key = "".join(s[k] for k in at)
                    if key.count(" ") > 2 or key[:2] == "  ":
                        continue
                    out[key] = out.get(key, 0) + toxicity.GAP ** sum(g)
        return out

    x, y = counts(a), counts(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt((len(a) + 2) * (len(b) + 2))


@pytest.mark.parametrize("a,b", [("worthless", "worthless"), ("idiot", "idxiot"), ("moron", "moorron"), ("clown", "unrelated")])
def test_features_give_the_kernel(a, b):
    f = toxicity._features([a, b])
    columns = np.unique(f[1])
    x = toxicity._dense(f, 2, columns)
    assert x[0] @ x[1] == pytest.approx(kernel_by_hand(a, b))


def test_window_scores_find_gapped_and_inserted_insults():
    words = ["worthless", "scumbag", "garden", "window", "people", "walking", "thorough", "sunless", "weather", "bagpipe"]
    toxic = np.array([50, 50, 1, 1, 1, 1, 1, 1, 1, 1], float)
    clean = np.array([0, 0, 60, 60, 60, 60, 60, 60, 60, 60], float)
    weights, bias = toxicity.fit_words(words, toxic, clean, np.ones(len(words)))
    texts = ["you w o r t h l e s s one", "a worxthlxess thing", "Worth-less!", "walking people in the garden", ""]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["text"])
    best, _ = toxicity.window_scores(batch, weights, bias)
    assert min(best[:3]) > 0 > max(best[3:])


def test_scores_do_not_depend_on_neighbours():
    weights = np.random.default_rng(0).normal(size=toxicity.SYMBOLS**4).astype(np.float32)
    weights[: toxicity.SYMBOLS**2] = 0
    texts = [b"...one two three", b"four. five!", "größer, ça va".encode(), b"x", b""]
    both = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    together = toxicity.window_scores(both, weights, 0.1)
    for i in range(len(texts)):
        alone = toxicity.window_scores(both.slice(i, 1), weights, 0.1)
        assert alone[0][0] == pytest.approx(together[0][i], rel=1e-4) and alone[1][0] == pytest.approx(together[1][i], rel=1e-4)


def test_toxicity_on_held_out_rows(spark):
    got = QUERIES["op1_toxicity"](spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    assert (got.held_out == (rest(got.doc_id, 3) == 1)).all()
    own = got[got.held_out & (got.doc_id >= 0)]
    caught = own[own.toxic == 1].predicted.mean()
    assert caught > 0.5 and own[own.toxic == 0].predicted.mean() < 0.01
    assert own.score.between(0, 1).all() and (own.predicted == (own.score >= 0.7)).all()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "you worthless scum" if i % 2 else "a nice day") for i in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(edge_rows(spark, ["score", "lang"]), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.lang == "kept" for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    none = toxicity.fit(docs, labels.where("false"))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty_docs(spark), model).count() == 0


# --- languages -----------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == (rest(got.doc_id, 4) == 2)).all()
    own = got[got.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.97 and own.score.between(0, 1).all()


def test_more_languages_than_a_word_has_bits(spark):
    """70 languages, each with words of its own: the last ones are found as well, and equal a plain count of hits."""
    names = [f"l{i:02d}" for i in range(70)]
    word = lambda i: chr(0x4E00 + 40 * i) + chr(0x4E01 + 40 * i) + chr(0x4E02 + 40 * i)
    rows = [(n, f"{word(n % 70)} {word(n % 70)[::-1]} the", names[n % 70]) for n in range(70 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert sorted(model.languages) == names and model.table.shape[1] == 2
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert all(got[n] == lang for n, _, lang in rows)


def test_predictions_equal_a_plain_count(spark):
    """The whole result against sets of n-grams per language in plain Python, false positives left out."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs, bits=22)
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {lang: {} for lang in model.languages}
    usable = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    for r in usable:
        for g in set(language_id.grams(language_id.letters(r.text or "")).tolist()):
            held[r.lang][g] = held[r.lang].get(g, 0) + 1
    n = {lang: sum(r.lang == lang for r in usable) for lang in held}
    share = {lang: {g: c / n[lang] for g, c in own.items()} for lang, own in held.items()}
    top = {}
    for own in share.values():
        for g, x in own.items():
            top[g] = max(top.get(g, 0), x)
    usual = {
        lang: {g for g, x in own.items() if x >= language_id.SHARE and x >= top[g] * language_id.RIVAL} for lang, own in share.items()
    }
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    for r in rows:
        codes = language_id.letters(r.text or "")
        if not (codes != 32).any():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        grams = language_id.grams(codes).tolist()
        hits = [sum(g in usual[lang] for g in grams) for lang in model.languages]
        best = max(hits)
        if sum(hits) and sorted(hits)[-2] < best - 0.02 * len(grams):
            assert got[r.doc_id].lang_pred == model.languages[hits.index(best)]
            assert got[r.doc_id].score == pytest.approx(best / sum(hits), abs=0.02)


def test_bloom_filters_hold_what_was_put_in(spark):
    docs = spark.createDataFrame(
        [(i, "der die das und nicht" if i % 2 else "the of and that with", "de" if i % 2 else "en") for i in range(60)],
        "doc_id long, text string, lang string",
    )
    model = language_id.fit(docs)
    assert sorted(model.languages) == ["de", "en"]
    for text, lang in (("nicht und", "de"), ("that of", "en")):
        got, score = model.predict(text)
        assert got == lang and 0.5 < score <= 1
    h = language_id.grams(language_id.letters("nicht"))
    mask = np.bitwise_and.reduce([model.table[p] for p in language_id.places(h, model.bits)])
    assert (mask >> np.uint64(model.languages.index("de")) & np.uint64(1)).all()
    assert model.predict(None) == ("und", 0.0) and model.predict("12 §§ --") == ("und", 0.0)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "der die das", "de") for i in range(9)] + [(None, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(edge_rows(spark, ["lang_pred", "n"]), model).collect()}
    assert got >= {(None, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (6, "de")}
    assert language_id.identify(empty_docs(spark), model).count() == 0
    assert language_id.fit(empty_docs(spark)).predict("text") == ("und", 0.0)


# --- quality -------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op4_quality_classifier"](spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    assert (got.held_out == (rest(got.doc_id, 5) == 0)).all()
    own = got[got.held_out]
    assert (own.predicted == own.quality).mean() > 0.98 and own.score.between(0, 1).all()
    assert (own.predicted == (own.score >= 0.3)).all()


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    x, y, w = np.arange(40.0), rng.normal(size=40).cumsum(), rng.uniform(1, 3, 40)
    _, values = quality_model.isotonic(x, y, w)
    assert (np.diff(values) > 0).all()
    # brute force: min over upper sets of max over lower sets of the mean
    best = [min(max(np.average(y[a : b + 1], weights=w[a : b + 1]) for a in range(i + 1)) for b in range(i, 40)) for i in range(40)]
    assert sorted(set(np.round(best, 9))) == sorted(set(np.round(values, 9)))


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    k = len(quality_model.STATISTICS)
    directions = rng.normal(size=(k, 20_000)) / (quality_model.WIDTH * np.sqrt(k))
    m = quality_model.Model(np.zeros(k), np.ones(k), directions, rng.uniform(0, 2 * np.pi, 20_000), *[np.zeros(1)] * 3)
    x = rng.normal(size=(2, k))
    z = m.fourier(x)[:, :-1]
    want = np.exp(-((x[0] - x[1]) ** 2).sum() / (2 * quality_model.WIDTH**2 * k))
    assert z[0] @ z[1] == pytest.approx(want, abs=0.03)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "a fine text. it goes on." if i % 2 else "### $$$ ||| %%%") for i in range(60)], "doc_id long, text string")
    model = quality_model.fit(docs, labels)
    got = quality_model.score(edge_rows(spark, ["score", "lang"]), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    one_class = quality_model.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_model.score(docs, one_class).collect()} == {1.0}
    assert quality_model.score(empty_docs(spark), model).count() == 0
    assert quality_model.fit(empty_docs(spark), labels).probability(np.zeros((1, len(quality_model.STATISTICS))))[0] == 0


# --- helpers -------------------------------------------------------------------------


def test_pieces_cover_a_batch():
    texts = pa.array([b"abc", None, b"", b"x" * 50, b"de"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), texts], names=["i", "text"]).slice(1)
    got = [p.column(0).to_pylist() for p in pieces(batch, limit=10)]
    assert sum(got, []) == [1, 2, 3, 4] and len(got) > 1
    data, bounds = bytes_and_offsets(batch.column(1))
    assert bounds.tolist() == [0, 0, 0, 50, 52] and bytes(data[50:]) == b"de"


def test_labelled_sample_is_bounded(spark):
    from quibble.llm.common import labelled_sample

    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = labelled_sample(docs.unionByName(docs), labels, "toxic", 3, 1, 20, 0).collect()
    assert len(got) == 40 and sum(r.label for r in got) == 20
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)
