"""BM25: index statistics, batched queries, floor, rank, coverage gate, held-out hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_terms, coverage, once, tokenize
from ..vocabulary import EPSILON, K1, RETRIEVABLE, B, RetrievalConfig
from ..sources.store import shared_folder
from . import scoring
from .chunking import chunk_documents
from .ranking import _small

#: A sum of logarithms that doesn't depend on the order of its terms.
_EXACT = "decimal(38,15)"
_UNIT = scoring.UNIT


def index_text(chunks: DataFrame) -> Column:
    return F.concat_ws("\n", F.col("section_heading"), F.col("text"))


@dataclass(frozen=True)
class Index:
    """chunks: with their tokens and length; stats: N and mean length, one row; idf: (token, df,
    idf), idf floored. terms: see slim(), where they are kept beside the chunks. counted: what idf was
    made from, where it is kept. chunks_of: the chunks of
    documents(doc_id) alone, where they are made from these when asked for."""

    chunks: DataFrame
    stats: DataFrame
    idf: DataFrame
    terms: DataFrame | None = field(default=None, kw_only=True)
    counted: DataFrame | None = field(default=None, kw_only=True)
    chunks_of: Callable[[DataFrame], DataFrame] | None = field(default=None, kw_only=True)

    def release(self) -> None:
        for kept in (self.terms, self.counted):
            if kept is not None:
                kept.unpersist()

    def slim(self) -> DataFrame:
        """(doc_id, chunk_index, chunk_id, n_tokens, words): what scores are made from, words joined by
        spaces, which they don't hold."""
        return slim(self.chunks) if self.terms is None else self.terms

    def scored(self, asked: DataFrame) -> DataFrame:
        """What scoring reads for words of asked(token)."""
        return self.slim()

    def named(self, found: DataFrame) -> DataFrame:
        """The chunks of the documents of found(doc_id)."""
        if self.chunks_of is None:
            return self.chunks
        return self.chunks_of(_small(found.select("doc_id").distinct()))

    def joined(self) -> bool:
        """Whether scores are made by joins with postings: see score()."""
        return self.repeats()

    def repeats(self) -> bool:
        """Whether several chunks have one id, as those of repeated documents do."""
        ids = self.slim().groupBy(F.xxhash64("chunk_id"), F.xxhash64(F.lit(1), "chunk_id")).agg(F.count("*").alias("n"))
        return bool(ids.filter("n > 1").limit(1).collect())

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(_a, _b, n_tokens, token, tf, idf) of the chunks that hold a token of asked(token)."""
        return (
            keyed(self.chunks).select("_a", "_b", "n_tokens", F.explode("tokens").alias("token"))
            .join(asked, "token", "left_semi")
            .groupBy("_a", "_b", "n_tokens", "token").agg(F.count("*").alias("tf"))
            .join(self.idf.join(asked, "token", "left_semi").select("token", "idf"), "token")
        )


def tokenized(chunks: DataFrame) -> DataFrame:
    tokens = once(chunks, tokens=tokenize(index_text(chunks)))
    return tokens.withColumn("n_tokens", F.size("tokens"))


def slim(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", "chunk_id", "n_tokens", F.array_join("tokens", " ").alias("words"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(n_chunks, avg_tokens), one row."""
    return chunks.agg(
        F.count("*").alias("n_chunks"), (F.sum("n_tokens") / F.count("*")).alias("avg_tokens")
    )


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(token, df). Chunks give each token once, and counts are summed before the shuffle."""
    return (
        chunks.select(F.explode(F.array_distinct("tokens")).alias("token"))
        .groupBy("token").agg(F.count("*").alias("df"))
    )


def term_frequency(chunks: DataFrame) -> DataFrame:
    """(chunk_id, token, tf)."""
    return (
        chunks.select("chunk_id", F.explode("tokens").alias("token"))
        .groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))
    )


def inverse_frequency(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, raw_idf, idf): idf below zero becomes EPSILON times the mean raw idf. The mean is
    taken over the few distinct frequencies."""
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    one = F.broadcast(stats)  # one row
    by_df = df.groupBy("df").agg(F.count("*").alias("n")).crossJoin(one)
    mean = by_df.agg(
        (F.sum((raw * F.col("n")).cast(_EXACT)) / F.sum("n")).cast("double").alias("mean_idf")
    )
    at = df.crossJoin(one).crossJoin(F.broadcast(mean)).withColumn("raw_idf", raw)
    floored = F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return at.select("token", "df", "raw_idf", floored.alias("idf"))


def _of_terms(terms: DataFrame) -> DataFrame:
    return terms.withColumn("tokens", F.split("words", " "))


def build_index(chunks: DataFrame, chunks_of: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """Chunks are tokenised once, and their names and words are kept on disk, about as large as the
    texts, for statistics and scores and for later questions, until release(). So are the words'
    frequencies, which are read several times. Nothing else is: chunks of hits are made again, from their
    documents alone if chunks_of makes these."""
    tokens = tokenized(chunks)
    terms = slim(tokens).persist(StorageLevel.DISK_ONLY)
    stats = corpus_stats(terms)
    # a chunk without words has the word '', which is none
    df = document_frequency(_of_terms(terms)).filter("token != ''").persist(StorageLevel.DISK_ONLY)
    return Index(tokens, stats, inverse_frequency(df, stats), terms=terms, counted=df, chunks_of=chunks_of)


def build_retriever(documents: DataFrame, config: RetrievalConfig | None = None, gate: bool = True) -> Index:
    """Index of a corpus; with gate=False, of documents of all statuses."""
    config = config or RetrievalConfig()

    def chunks_of(named: DataFrame) -> DataFrame:
        return tokenized(chunk_documents(documents.join(named, "doc_id", "left_semi"), gate))

    return build_index(chunk_documents(documents, gate), chunks_of)


def save(index: Index, path: str) -> None:
    """An index as tables, for sessions to come."""
    for name in ("chunks", "stats", "idf"):
        getattr(index, name).write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    """An index that save() has written. Nothing is chunked, tokenised or counted again."""
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("chunks", "stats", "idf")))


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks with two hashes of their id, 128 bits together: sums are grouped by these, which takes
    far less than by names."""
    return chunks.withColumns({"_a": F.xxhash64("chunk_id"), "_b": F.xxhash64(F.lit(1), "chunk_id")})


def _words(queries: DataFrame) -> DataFrame:
    """(query_id, token, times)."""
    return (
        queries.select("query_id", F.explode(tokenize(F.col("question"))).alias("token"))
        .groupBy("query_id", "token").agg(F.count("*").alias("times"))
    )


def _by_blocks(index: Index, queries: DataFrame, of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """of(terms, words with idf and mean length), with these looked up once."""
    words = _words(queries)
    asked = words.select("token").distinct()
    known = words.join(index.idf.join(asked, "token", "left_semi").select("token", "idf"), "token")
    known = known.crossJoin(F.broadcast(index.stats.select("avg_tokens"))).persist()  # one row
    found = of(index.scored(asked), known)
    known.unpersist()
    return found


def _keyed_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, _a, _b, score), by joins with the words' postings."""
    words = _words(queries)
    asked = words.select("token").distinct()
    length = F.col("n_tokens") / F.col("avg_tokens")
    weight = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length)))
    weights = (
        index.frequencies(asked)
        .crossJoin(F.broadcast(index.stats))  # one row
        .select("_a", "_b", "token", F.round(weight * _UNIT).cast("long").alias("weight"))
        # by chunk, not by token: frequent words meet most queries, in whichever task holds them
        .repartition("_a", "_b")
    )
    total = F.sum(F.col("times") * F.col("weight")) / _UNIT
    return words.join(weights, "token").groupBy("query_id", "_a", "_b").agg(total.alias("score"))


def _named(scores: DataFrame, index: Index) -> DataFrame:
    names = keyed(index.slim()).select("_a", "_b", "doc_id", "chunk_index", "chunk_id")
    names = names.distinct() if index.repeats() else names
    return scores.join(names, ["_a", "_b"]).drop("_a", "_b")


def score(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, score, doc_id, chunk_index, chunk_id) for all chunks that share a word with a
    query(query_id, question). A word that a query repeats counts again.

    Weights are summed as whole multiples of 1 / _UNIT, so that a score doesn't depend on the order of
    its terms and equal chunks tie exactly. Questions come to the chunks in blocks, see scoring; chunks
    that share their ids, which count as one, are joined with the words instead, unless they are stored."""
    if index.joined():
        return _named(_keyed_scores(index, queries), index)
    return _by_blocks(index, queries, scoring.every)


def rank(scores: DataFrame, top_k: Column | int, score_floor: float = 0.0) -> DataFrame:
    """Scores strictly above the floor, ranked from 1 in each query, the first top_k."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_index", "chunk_id")
    return (
        scores.filter(F.col("score") > score_floor)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
    )


def top(index: Index, queries: DataFrame, top_k: int, score_floor: float = 0.0) -> DataFrame:
    """rank(score()), with no more rows than a question's best of each task on its way. queries may carry
    smaller values of their own in top_k."""
    if index.joined():
        found = _keyed_scores(index, queries).filter(F.col("score") > score_floor)
        by_score = W.partitionBy("query_id").orderBy(F.desc("score"))
        cut = found.withColumn("_r", F.rank().over(by_score)).filter(F.col("_r") <= top_k).drop("_r")
        named = _named(cut, index)
    else:
        named = _by_blocks(index, queries, lambda terms, words: scoring.best(terms, words, top_k, score_floor))
    if "top_k" not in queries.columns:
        return rank(named, top_k, score_floor)
    return rank(named.join(queries.select("query_id", "top_k"), "query_id"), F.col("top_k"), score_floor)


def hits(index: Index, queries: DataFrame, config: RetrievalConfig, gate: bool = True) -> DataFrame:
    """Ranked hits with their chunks. The coverage gate looks at the best hit of a query, after the
    cut to top_k, and drops all of the query's hits. queries may carry top_k."""
    own = "top_k" in queries.columns
    most = (queries.agg(F.max("top_k")).first()[0] or 1) if own else config.top_k
    shared_folder(queries.sparkSession)
    ranked = top(index, queries, most, config.score_floor).checkpoint()  # top_k rows of a query, read twice
    chunks = index.named(ranked).drop("doc_id", "chunk_index")
    found = ranked.join(queries.select("query_id", "question"), "query_id").join(chunks, "chunk_id")
    found = found.withColumn("coverage", coverage(content_terms(F.col("question")), F.col("tokens")))
    if gate and config.min_top_coverage > 0:
        best = F.max(F.when(F.col("rank") == 1, F.col("coverage"))).over(W.partitionBy("query_id"))
        found = found.withColumn("_best", best).filter(F.col("_best") >= config.min_top_coverage).drop("_best")
    return found.drop("tokens", "n_tokens", "top_k")


def covered(index: Index, queries: DataFrame, config: RetrievalConfig, last: int | None = None) -> DataFrame:
    """hits() without the gate, to rank `last` alone, as (query_id, rank, score, doc_id, chunk_index, chunk_id, coverage):
    coverage follows from the kept words, so no document is chunked again for it. Hits meet the words where these lie."""
    shared_folder(queries.sparkSession)
    ranked = top(index, queries, config.top_k, config.score_floor).checkpoint()  # read twice
    ranked = ranked if last is None else ranked.filter(F.col("rank") <= last)
    words = _of_terms(index.slim()).select("chunk_id", "tokens").join(_small(ranked.select("chunk_id").distinct()), "chunk_id")
    terms = once(queries.select("query_id", "question"), _terms=content_terms(F.col("question"))).drop("question")
    found = ranked.join(terms, "query_id").join(words, "chunk_id")
    return found.select(*ranked.columns, coverage(F.col("_terms"), F.col("tokens")).alias("coverage"))


def held_out(blind: Index, queries: DataFrame, config: RetrievalConfig) -> DataFrame:
    """What the status gate kept from a query: hits of the status-blind index that aren't
    retrievable, cut to top_k before they are filtered, with their ranks there. No coverage gate."""
    found = hits(blind, queries, config, gate=False)
    return found.filter(~F.col("status").isin(*RETRIEVABLE))


def best_per_document(found: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id", "doc_id").orderBy("rank")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
