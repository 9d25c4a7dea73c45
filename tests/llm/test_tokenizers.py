"""Byte-level BPE against tiktoken, token alignment against brute force."""

import base64
import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from quibble.llm import byte_bpe, queries, token_alignment
from quibble.llm.common import read

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "a", "<|endoftext|> a<s>b</s><unk>", "l'été's  naïve\t\r\n\n x", "中文字 текст ελ", "🙂🙂 👩‍👩‍👧",
    "▁ mark", "a▁b", "  x", "\x00\x1f", "don't DON'T we'll", "1234567 ٣٤", "࢏ ॿ\U00010940\U0001ccd6", "a  b   c    ",
]


def made_up(n, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x3000), lambda: rng.randrange(0xE000, 0x20000), lambda: 32]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(80))) for _ in range(n)]


LONG = ["ab" * 40_000 + " " * 5_000, "word and word " * 20_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_codec_equals_the_library(name):
    path = public_tokenizers.path(f"{name}.tiktoken")
    codec = byte_bpe.Vocabulary(path, public_tokenizers.PATTERN).codec()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in ODD] + made_up(300, 1) + LONG[1:]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()
    assert codec.decode([len(ranks)]) is None and codec.decode([-1]) is None


def test_whole_tokens_that_merges_do_not_reach(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"xyz"]  # no merge gives xyz
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % (i + (i > 256)) for i, t in enumerate(tokens)))  # rank 257 lacks
    codec = byte_bpe.Vocabulary(str(path), r"\S+|\s").codec()
    assert [i.tolist() for i in codec.encode(["xyz", "abc xyzz", ""])] == [[259], [256, 99, 32, 120, 121, 122, 122], []]
    assert codec.decode([259, 257]) == b"xyz"
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError, match="255 single bytes"):
        byte_bpe.Vocabulary(str(path), r"\S+")


def test_encoding_keeps_rows_and_columns(spark):
    vocabulary = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = [(None, None, "x", 7), (1, "a b", "y", 8), (1, "a b", "y", 8), (2, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `odd name` int")
    got = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted((str(r.doc_id), r["odd name"], r.n_tokens, bytes(r.decoded)) for r in got) == [
        ("1", 8, 2, b"a b"), ("1", 8, 2, b"a b"), ("2", None, 0, b""), ("None", 7, 0, b""),
    ]
    assert byte_bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_op12_on_the_whole_table(spark):
    ranks = {
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    }
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.QUERIES["op12_byte_bpe"](spark, SF).collect()}
    docs = read(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- alignment -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def models():
    return token_alignment.Tokenizers(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@functools.cache
def libraries(models):
    one = tokenizers.Tokenizer.from_buffer(models.models[0])
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_proto=models.models[1])


def brute_groups(text, models):
    """Groups (ids, ids, end) of one text, from the libraries and a plain merge of the two lists of ends."""
    if not text:
        return []
    one, two = libraries(models)
    a = one.encode(" " + text, add_special_tokens=False).ids
    b = two.encode(text)
    level = {c: bytes([v]) for c, v in token_alignment._byte_characters().items()}
    a_bytes = [b"".join(level[c] for c in one.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:-1], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return []
    out, own, at = [], ([], []), [0, 0]
    place = [0, 0]
    while place[0] < len(a) or place[1] < len(b):
        side = 0 if at[0] <= at[1] and place[0] < len(a) else 1
        own[side].append((a, b)[side][place[side]])
        at[side] += len((a_bytes, b_bytes)[side][place[side]])
        place[side] += 1
        if at[0] == at[1]:
            out.append((*own, at[0] - 1))
            own = ([], [])
    return out


def brute_counts(rows, models):
    groups = [(d, brute_groups(t, models)) for d, t in rows]
    links = [[(a, b) for x, y, _ in g for a in x for b in y] for _, g in groups]
    count = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (d, g), own in zip(groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in g)
        out.append(
            (
                str(d), sum(len(x) for x, _, _ in g), sum(len(y) for _, y, _ in g), len(g), len(own),
                sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out)


def test_gallop_finds_the_first_place():
    rng = np.random.default_rng(3)
    longer = np.unique(rng.integers(0, 5000, 700))
    low = rng.integers(0, len(longer), 400)
    high = np.minimum(len(longer), low + rng.integers(0, 300, 400))
    values = rng.integers(-5, 5100, 400)
    guess = np.clip(rng.integers(0, len(longer), 400), low, high)
    got = token_alignment.gallop(values, longer, low, high, guess)
    assert got.tolist() == [a + int(np.searchsorted(longer[a:b], v)) for v, a, b in zip(values, low, high)]


def test_align_gives_groups_and_offsets(spark, models):
    rows = [(i, t, "kept", 5) for i, t in enumerate(ODD + made_up(60, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string, stop int")
    got = {r.doc_id: r for r in token_alignment.align(docs, models).collect()}
    assert len(got) == len(rows)
    for i, text, other, _ in rows:
        r, expected = got[i], brute_groups(text, models)
        assert r.other == other and list(r.stop) == [g[2] for g in expected]
        a = [r.a_ids[x:y] for x, y in zip([0, *r.a_stop], r.a_stop)]
        b = [r.b_ids[x:y] for x, y in zip([0, *r.b_stop], r.b_stop)]
        assert list(zip(a, b)) == [(x, y) for x, y, _ in expected]


@pytest.mark.parametrize("large", [token_alignment.LARGE, 2])
def test_counts_against_brute_force(spark, models, monkeypatch, large):
    monkeypatch.setattr(token_alignment, "LARGE", large)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 2_000)
    texts = ODD + made_up(120, 4) + ["the same text"] * 4 + [LONG[1][:30_000]]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    got = token_alignment.count_links(docs, models, ["doc_id"], {"groups_sha256": digest}).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute_counts(rows, models)
    assert token_alignment.count_links(docs.limit(0), models, ["doc_id"], {}).count() == 0


def test_op11_on_the_whole_table(spark, models):
    got = queries.QUERIES["op11_token_alignment"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == brute_counts(rows, models)
