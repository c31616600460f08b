"""Many corpora in one index: questions over any number of them are one job.

Rows without a corpus belong to none: such documents aren't indexed, such questions find nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_terms, coverage, tokenize
from ..vocabulary import EPSILON, K1, RETRIEVABLE, B, RetrievalConfig
from ..sources.store import shared_folder
from . import bm25, scoring
from .chunking import chunk_documents
from .ranking import _small

#: Folders of a stored library; a corpus lies in one of them, by its hash.
PARTS = 256
#: Files that a folder is written as.
FILES = 4
#: Corpora of a batch whose folders are named to the scan; with more, all are read and joined.
MANY = 10_000
#: Tasks over which the rows of one corpus are dealt where they meet its statistics.
SALT = 32


def _part() -> Column:
    return F.pmod(F.xxhash64("corpus"), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Library:
    """chunks: with corpus, tokens and length; idf: (corpus, token, df, idf, avg_tokens), idf floored
    by the mean of its corpus. Both have part, the folder of their corpus. terms: names, length and words
    of the chunks, where they are kept."""

    chunks: DataFrame
    idf: DataFrame
    terms: DataFrame | None = None

    def release(self) -> None:
        if self.terms is not None:
            self.terms.unpersist()

    def slim(self) -> DataFrame:
        """(corpus, doc_id, chunk_index, chunk_id, n_tokens, words), words joined by spaces."""
        return _slim(self.chunks) if self.terms is None else self.terms

    def of(self, corpora: DataFrame) -> Library:
        """The library, with only the folders of corpora(corpus) to be read."""
        named = corpora.select(_part().alias("part")).distinct()
        parts = [r["part"] for r in named.collect()] if len(corpora.limit(MANY + 1).collect()) <= MANY else None  # PARTS rows
        if parts is None:
            return self
        return Library(*(d if d is None else d.filter(F.col("part").isin(parts)) for d in (self.chunks, self.idf, self.terms)))


def _met(rows: DataFrame, by_corpus: DataFrame) -> DataFrame:
    """rows with what by_corpus says of their corpus. A corpus may hold most rows, so they are dealt by
    their token, and its one row goes to each of SALT tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("token"), F.lit(SALT)).cast("int"))
    each = by_corpus.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(each, ["corpus", "_salt"]).drop("_salt")


def _slim(chunks: DataFrame) -> DataFrame:
    return chunks.select("corpus", "part", "doc_id", "chunk_index", "chunk_id", "n_tokens", F.array_join("tokens", " ").alias("words"))


def inverse_frequency(chunks: DataFrame) -> DataFrame:
    """(corpus, token, df, idf, avg_tokens) of tokenised chunks; statistics are each corpus' own."""
    stats = chunks.groupBy("corpus").agg(F.count("*").alias("n_chunks"), (F.sum("n_tokens") / F.count("*")).alias("avg_tokens"))
    df = (
        chunks.select("corpus", F.explode(F.array_distinct("tokens")).alias("token"))
        .groupBy("corpus", "token").agg(F.count("*").alias("df"))
    )
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    by_df = df.groupBy("corpus", "df").agg(F.count("*").alias("n")).join(stats, "corpus").withColumn("raw", raw)
    mean = by_df.groupBy("corpus").agg(
        (F.sum((F.col("raw") * F.col("n")).cast("decimal(38,15)")) / F.sum("n")).cast("double").alias("mean_idf")
    )
    at = _met(df, stats.join(mean, "corpus")).withColumn("raw", raw)
    floored = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return at.select("corpus", "token", "df", floored.alias("idf"), "avg_tokens", _part().alias("part"))


def build(documents: DataFrame, gate: bool = True) -> Library:
    """One index of documents of many corpora, named by their column corpus. Names and words of the chunks
    are kept on disk until release()."""
    named = documents.filter(F.col("corpus").isNotNull())
    chunks = bm25.tokenized(chunk_documents(named, gate, keep=("corpus",))).withColumn("part", _part())
    terms = _slim(chunks).persist(StorageLevel.DISK_ONLY)
    idf = inverse_frequency(terms.withColumn("tokens", F.split("words", " ")))
    return Library(chunks, idf.filter("token != ''"), terms)  # of chunks without words, '' is none


def save(library: Library, path: str) -> None:
    """A library as tables in folders by corpus. A corpus of most rows is spread over a folder's files."""
    for name, key in (("chunks", "chunk_id"), ("idf", "token")):
        dealt = getattr(library, name).repartition(F.col("part"), F.pmod(F.xxhash64(key), F.lit(FILES)))
        dealt.sortWithinPartitions("part", "corpus").write.partitionBy("part").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Library:
    """A library that save() has written. Questions read the folders of their corpora alone."""
    return Library(*(spark.read.parquet(f"{path}/{name}") for name in ("chunks", "idf")))


def _key(corpus: Column, name: Column) -> Column:
    """One string for a corpus and a name in it; names of corpora may hold anything."""
    return F.concat(F.hex(F.encode(corpus, "UTF-8")), F.lit(":"), name)


def _by_blocks(library: Library, queries: DataFrame, of) -> DataFrame:
    """of(terms, words) with words and ids named by their corpus, and what it gives told apart again."""
    kind = queries.schema["query_id"].dataType
    words = _words(queries)
    only = library.of(queries.select("corpus").filter("corpus IS NOT NULL").distinct())
    idf = only.idf.join(words.select("corpus", "token").distinct(), ["corpus", "token"], "left_semi")
    known = words.join(idf.select("corpus", "token", "idf", "avg_tokens"), ["corpus", "token"])
    text = F.coalesce(F.concat(F.lit("="), F.col("query_id").cast("string")), F.lit(""))
    known = known.select(
        _key(F.col("corpus"), text).alias("query_id"), _key(F.col("corpus"), F.col("token")).alias("token"), "times", "idf", "avg_tokens"
    ).persist()
    named = F.array_join(F.transform(F.split("words", " "), lambda w: _key(F.col("corpus"), w)), " ")
    found = of(only.slim().withColumn("words", named), known)
    known.unpersist()
    corpus = F.decode(F.unhex(F.substring_index("query_id", ":", 1)), "UTF-8").alias("corpus")
    own = F.substring(F.col("query_id"), F.instr("query_id", ":") + 1, F.lit(2**30))
    query_id = F.when(own != "", F.substring(own, 2, 2**30)).cast(kind).alias("query_id")
    return found.select(corpus, query_id, "score", "doc_id", "chunk_index", "chunk_id")


def _words(queries: DataFrame) -> DataFrame:
    """(corpus, query_id, token, times)."""
    return (
        queries.select("corpus", "query_id", F.explode(tokenize(F.col("question"))).alias("token"))
        .groupBy("corpus", "query_id", "token").agg(F.count("*").alias("times"))
    )


def _repeats(library: Library) -> bool:
    """Whether several chunks of a corpus have one id."""
    ids = library.slim().groupBy(F.xxhash64("corpus", "chunk_id"), F.xxhash64(F.lit(1), "corpus", "chunk_id"))
    return bool(ids.agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect())


def score(library: Library, queries: DataFrame) -> DataFrame:
    """(corpus, query_id, score, doc_id, chunk_index, chunk_id) for the chunks of a query's corpus that
    share a word with it; queries(corpus, query_id, question). Scores are what an index of that corpus
    alone gives: whole multiples of 1e-12, whatever the order of their terms. Questions come to the chunks
    in blocks, see scoring; a library in which chunks share their ids is joined with the words instead."""
    return _joined(library, queries) if _repeats(library) else _by_blocks(library, queries, scoring.every)


def _joined(library: Library, queries: DataFrame) -> DataFrame:
    words = _words(queries)
    asked = words.select("corpus", "token").distinct()
    only = library.of(queries.select("corpus").filter("corpus IS NOT NULL").distinct())
    keys = {"_a": F.xxhash64("corpus", "chunk_id"), "_b": F.xxhash64(F.lit(1), "corpus", "chunk_id")}
    chunks = only.chunks.withColumns(keys)
    length = F.col("n_tokens") / F.col("avg_tokens")
    weight = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length)))
    weights = (
        chunks.select("corpus", *keys, "n_tokens", F.explode("tokens").alias("token"))
        .join(asked, ["corpus", "token"], "left_semi")
        .groupBy("corpus", *keys, "n_tokens", "token").agg(F.count("*").alias("tf"))
        .join(only.idf.join(asked, ["corpus", "token"], "left_semi"), ["corpus", "token"])
        .select("corpus", *keys, "token", F.round(weight * 1e12).cast("long").alias("weight"))
        .repartition(*keys)
    )
    total = F.sum(F.col("times") * F.col("weight")) / 1e12
    scores = words.join(weights, ["corpus", "token"]).groupBy("corpus", "query_id", *keys).agg(total.alias("score"))
    return scores.join(chunks.select(*keys, "doc_id", "chunk_index", "chunk_id"), list(keys)).drop(*keys)


def top(library: Library, queries: DataFrame, top_k: int, score_floor: float = 0.0) -> DataFrame:
    """score() ranked in each corpus and query, the first top_k. One id may name questions of several
    corpora."""
    both = F.struct("corpus", "query_id").alias("query_id")
    if _repeats(library):
        found = _joined(library, queries)
    else:
        found = _by_blocks(library, queries, lambda terms, words: scoring.best(terms, words, top_k, score_floor))
    ranked = bm25.rank(found.select(both, "score", "doc_id", "chunk_index", "chunk_id"), top_k, score_floor)
    return ranked.select("query_id.corpus", "query_id.query_id", *(c for c in ranked.columns if c != "query_id"))


def hits(library: Library, queries: DataFrame, config: RetrievalConfig, gate: bool = True) -> DataFrame:
    """Ranked hits with their chunks, each query's within its corpus; the coverage gate looks at the best
    hit of each, after the cut to top_k."""
    shared_folder(queries.sparkSession)
    ranked = top(library, queries, config.top_k, config.score_floor).checkpoint()  # top_k rows of a query, read twice
    asked = queries.select("corpus", "query_id", "question")
    only = library.of(queries.select("corpus").filter("corpus IS NOT NULL").distinct())
    of = _small(ranked.select("corpus", "chunk_id").distinct())
    chunks = only.chunks.drop("doc_id", "chunk_index", "part").join(of, ["corpus", "chunk_id"], "left_semi")
    found = ranked.join(asked, ["corpus", "query_id"]).join(chunks, ["corpus", "chunk_id"])
    found = found.withColumn("coverage", coverage(content_terms(F.col("question")), F.col("tokens")))
    if gate and config.min_top_coverage > 0:
        best = F.max(F.when(F.col("rank") == 1, F.col("coverage"))).over(W.partitionBy("corpus", "query_id"))
        found = found.withColumn("_best", best).filter(F.col("_best") >= config.min_top_coverage).drop("_best")
    return found.drop("tokens", "n_tokens")


def held_out(blind: Library, queries: DataFrame, config: RetrievalConfig) -> DataFrame:
    """What the status gate kept from each query of each corpus: hits of a library without gate that
    aren't retrievable, with their ranks there."""
    return hits(blind, queries, config, gate=False).filter(~F.col("status").isin(*RETRIEVABLE))
