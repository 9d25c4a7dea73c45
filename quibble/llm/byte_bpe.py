"""Byte-level BPE through a SentencePiece model that is written directly from a rank file.

Nothing is trained. Every token of the rank file becomes a piece: its bytes are mapped to 256
characters of their own (byte b to U+0100 + b), its score is the negative rank, and nothing is
normalised, so SentencePiece's merges take the adjacent pair of lowest rank first, the leftmost
of equals. Texts are split by a pattern, a pre-token that is a whole token is that token, whatever its
merges give, and all others are merged, each by itself. Decoding maps pieces back to bytes.

The model (about a megabyte, one entry per token of the vocabulary) is broadcast. A task keeps the ids
of a bounded number of pre-tokens.

Defined results: null and empty texts have no tokens and decode to no bytes; strings of special
tokens are plain text; bytes that are no UTF-8 become U+FFFD, as when Spark's string is read in
Python; very long texts are split piece by piece, and long pre-tokens are merged in n log n;
repeated rows each have their row; an empty table gives an empty one; other columns are kept,
but columns named ``ids`` and ``n_tokens`` (``decoded`` for decoding) are replaced.
An id outside the vocabulary makes ``decoded`` null.
"""

from __future__ import annotations

import base64
import codecs
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quibble.llm.common import pieces
from quibble.llm.word_ids import WordIds

#: Characters of the 256 bytes: letters that no normalisation, space rule or marker touches.
CHARACTERS = "".join(chr(0x100 + b) for b in range(256))
#: Between two pre-tokens: a byte that UTF-8 never has, and for the model a character of no piece.
SURROGATE, BETWEEN = "\udcff", "\u0200"
MARKED = CHARACTERS[:255] + BETWEEN
TOGETHER = 1 << 14  # pre-tokens looked up together
LONG = 1 << 20  # characters of a text whose pre-tokens are not listed at once


def read_ranks(path: str) -> list[bytes | None]:
    """Tokens by rank, from lines of base64 and rank; None where a rank is missing."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    tokens = [ranks.get(i) for i in range(max(ranks, default=-1) + 1)]
    missing = {bytes([b]) for b in range(256)} - set(tokens)
    if missing:
        raise ValueError(f"{len(missing)} single bytes are no tokens of {path}")
    return tokens


def to_piece(data: bytes) -> str:
    return codecs.charmap_decode(data, "strict", CHARACTERS)[0]


def serialise(tokens: list[bytes | None]) -> bytes:
    """A SentencePiece BPE model whose ids are the ranks; the unknown piece comes last."""
    model = sentencepiece_model_pb2.ModelProto()
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    for rank, token in enumerate(tokens):
        if token is None:
            model.pieces.add(piece=f"<gap{rank}>", score=0.0, type=kinds.CONTROL)
        else:
            model.pieces.add(piece=to_piece(token), score=-float(rank), type=kinds.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=kinds.UNKNOWN)
    trainer = model.trainer_spec
    trainer.model_type = sentencepiece_model_pb2.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    rules = model.normalizer_spec
    rules.name = "identity"
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes with a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.unknown = self.processor.unk_id()
        byte_of = {c: b for b, c in enumerate(CHARACTERS)}
        known = [self.processor.id_to_piece(i) for i in range(self.unknown)]
        gaps = [self.processor.is_control(i) for i in range(self.unknown)]
        self.tokens = [b"" if gap else bytes([byte_of[c] for c in piece]) for gap, piece in zip(gaps, known)]
        whole = {}
        for i, token in enumerate(self.tokens):
            try:
                whole[token.decode()] = i
            except UnicodeDecodeError:
                pass  # no pre-token is a part of a character
        whole.pop("", None)
        self.known = WordIds(whole, self._merge)

    def _words(self, text: str) -> Iterator[list[str]]:
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > LONG else iter(self.pattern.findall(text))
        while some := list(itertools.islice(found, TOGETHER)):
            yield some

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and their number. They go in one call: no piece holds the mark between two, so no merge crosses it."""
        data = SURROGATE.join(words).encode("utf-8", "surrogateescape")
        mapped = codecs.charmap_decode(data, "strict", MARKED)[0]
        ids = np.array(self.processor.encode(mapped, out_type=int, num_threads=1), np.int32)
        between = ids == self.unknown
        ends = np.append(np.flatnonzero(between), len(ids))
        return ids[~between], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for text in texts:
            yield np.concatenate([np.zeros(0, np.int32), *(self.known.ids(words)[0] for words in self._words(text))])

    def decode(self, ids: Iterable[int]) -> bytes | None:
        try:
            return b"".join([self.tokens[i] if i >= 0 else None for i in ids])
        except (IndexError, TypeError):
            return None


class Vocabulary:
    """A rank file with its pattern, as a model that tasks can load."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        self.model = serialise(read_ranks(path))

    def codec(self) -> Codec:
        return Codec(self.model, self.pattern)


def _replace(batch: pa.RecordBatch, dropped: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != dropped and n not in columns}
    return pa.RecordBatch.from_arrays([*kept.values(), *columns.values()], names=[*kept, *columns])


def _schema(df: DataFrame, dropped: str, added: str) -> str:
    names = {a.split()[0] for a in added.split(", ")}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != dropped and f.name not in names]
    return ", ".join([*kept, added])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens`` and the array ``ids`` of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value.codec()
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
                ids = list(codec.encode([(t or b"").decode("utf-8", "replace") for t in texts]))
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield _replace(piece, "text", {"n_tokens": pa.array(sizes), "ids": lists})

    sent_docs = docs.withColumn("text", F.col("text").cast("binary"))
    return sent_docs.mapInArrow(run, _schema(docs, "text", "n_tokens long, ids array<int>"))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` without ``ids``, with the bytes ``decoded``; null ids have no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value.codec()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("ids"))
            data = [codec.decode(ids.values.tolist() if ids.is_valid else []) for ids in column]
            yield _replace(batch, "ids", {"decoded": pa.array(data, pa.binary())})

    return encoded.mapInArrow(run, _schema(encoded, "ids", "decoded binary"))
