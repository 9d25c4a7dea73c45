"""A kept keyword index: postings, document frequencies and corpus statistics as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quibble.sources.staging import new_folder


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


@dataclass(frozen=True)
class KeywordIndex:
    """``postings``: (term, doc_id, tf, length) and the kept document columns; ``terms``: (term, df);
    ``corpus``: one row (documents, mean_length). Statistics are those of the whole corpus, whatever is searched."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    kept: tuple[str, ...]

    @property
    def kept_types(self) -> dict[str, DataType]:
        return {c: self.postings.schema[c].dataType for c in self.kept}


def build_index(
    docs: DataFrame,
    text: str = "retrieval_text",
    keep: Sequence[str] = (),
    path: str | None = None,
) -> KeywordIndex:
    """Write the index of ``docs(doc_id, text, keep...)`` below ``path`` (a run folder by default).

    A document's words are combined within its task, so what is shuffled is one row per document and
    distinct word. Postings are clustered by term and document hash: a search reads the few
    row groups of its terms, and a word of every document is spread over many files.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "keyword-index")
    worded = docs.filter(F.col(text).isNotNull()).select("doc_id", tokens(F.col(text)).alias("_words"), *keep)
    each = worded.select("doc_id", F.size("_words").alias("length"), F.explode("_words").alias("term"), *keep)
    postings = each.groupBy("term", "doc_id", "length", *keep).agg(F.count(F.lit(1)).alias("tf"))
    postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    written = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    written.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
    # Documents without a word count too.
    worded.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg(F.size("_words")), F.lit(0.0)).alias("mean_length")
    ).write.parquet(f"{path}/corpus")
    return open_index(spark, path, tuple(keep))


def open_index(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> KeywordIndex:
    postings, terms, corpus = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus"))
    return KeywordIndex(postings, terms, corpus, tuple(keep))


def score_postings(index: KeywordIndex, asked: DataFrame, k1: float, b: float, test: Column | None) -> DataFrame:
    """BM25 (query_id, doc_id, score) of ``asked(query_id, term, ...)``; ``test`` picks documents per query.

    Only terms that are asked for take part; sums are combined before the shuffle.
    """
    weighted = asked.join(index.terms, "term").crossJoin(F.broadcast(index.corpus))  # one row
    idf = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = weighted.withColumn("_idf", idf)
    hits = index.postings.join(weighted, "term")
    if test is not None:
        hits = hits.filter(test)
    damped = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    part = F.col("_idf") * F.col("tf") * (k1 + 1) / damped
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
