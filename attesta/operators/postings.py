"""A stored index: postings in buckets by token, so that a question reads those of its words alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once, tokenize
from .bm25 import Index, build_index, index_text
from .chunking import chunk_documents
from .ranking import _small
from .scoring import NAMES, posted

BUCKETS = 256
#: Postings of one token that stand in one bucket, about; more are dealt over several.
SLOT_ROWS = 1_000_000
#: Distinct words of a batch of questions up to which buckets are picked by them; beyond, postings are
#: joined bucket by bucket.
PICKED = 10_000

_NAMES = "array<struct<doc_id: string, chunk_index: int, chunk_id: string>>"
_TABLES = {
    "postings": {"slot": "string", "token": "string", "block": "long", "chunk": "array<smallint>", "n_tokens": "array<int>", "tf": "array<int>", "names": _NAMES},
    "words": {"token": "string", "df": "long", "raw_idf": "double", "idf": "double", "slots": "int"},
}
_BY = {"postings": "slot", "words": "token"}


def _slot(token: Column, number: Column) -> Column:
    return F.concat(token, F.lit("\n"), number.cast("string"))  # tokens hold no line ends


@dataclass(frozen=True)
class Stored(Index):
    """An index whose postings are a table in buckets by slot (a token, or a part of a frequent one),
    sorted in each bucket, and whose words are one in buckets by token."""

    postings: DataFrame
    words: DataFrame
    picked: int = PICKED

    def release(self) -> None:
        """Nothing is held."""

    def joined(self) -> bool:
        return False

    def slim(self) -> DataFrame:
        raise NotImplementedError("stored postings are read by scored()")

    def named(self, found: DataFrame) -> DataFrame:
        some = self.chunks.join(_small(found.select("doc_id").distinct()), "doc_id", "left_semi")
        return once(some, tokens=tokenize(index_text(some)))

    def _of(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and words of asked(token). With few words, the scans name them: buckets without any are
        not read, nor are row groups of others beyond their range. With many, the postings stay where they
        are and the words go to their buckets."""
        own = [r["token"] for r in asked.limit(self.picked + 1).collect()]  # asked words, bounded
        words, postings = self.words.join(asked, "token", "left_semi"), self.postings
        if len(own) <= self.picked:
            words = self.words.filter(F.col("token").isin(own))
            found = words.select("token", "slots").collect()  # a row per asked word
            names = [f"{r['token']}\n{k}" for r in found for k in range(r["slots"])]
            return postings.filter(F.col("slot").isin(names)), words
        number = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
        slots = words.select("token", number.alias("_k")).select(_slot(F.col("token"), F.col("_k")).alias("slot"))
        return postings.join(slots, "slot", "left_semi"), words

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(block, chunk, n_tokens, token, tf, idf) of the chunks that hold a token of asked(token). Nothing is
        counted."""
        found, words = self._of(asked)
        each = F.explode(F.arrays_zip("chunk", "n_tokens", "tf")).alias("_p")
        return found.select("block", "token", each).select("block", "_p.*", "token").join(words.select("token", "idf"), "token")

    def scored(self, asked: DataFrame) -> DataFrame:
        """Lists of the asked words and the names of all chunks, block by block; no posting is a row."""
        found, _ = self._of(asked)
        names = self.postings.filter(F.col("slot").startswith("\n"))  # no token is empty
        return found.unionByName(names).drop("slot").repartition("block").sortWithinPartitions("block")


def _together(terms: DataFrame) -> DataFrame:
    """Names with the texts of all chunks of their id, which count as one; in an order that a task which
    runs again gives again."""
    texts = F.array_sort(F.collect_list(F.struct("n_tokens", "words")))
    names = F.array_sort(F.collect_set(F.struct("doc_id", "chunk_index")))
    of = terms.groupBy("chunk_id").agg(names.alias("_names"), texts.alias("texts"))
    each = of.select(F.explode("_names").alias("_n"), "chunk_id", "texts")
    return each.select("_n.*", "chunk_id", "texts").sortWithinPartitions(*NAMES)


def build(documents: DataFrame, path: str, buckets: int = BUCKETS, gate: bool = True) -> None:
    """Writes the index of documents that build_retriever() and save() would, with the documents chunked once: the
    index is made from the chunks that have been written."""
    at = f"{path}/chunks"
    chunks = chunk_documents(documents, gate)
    once(chunks, n_tokens=F.size(tokenize(index_text(chunks)))).write.option("compression", "zstd").parquet(at)
    index = build_index(documents.sparkSession.read.parquet(at).drop("n_tokens"))
    save(index, path, buckets, chunked=True)
    index.release()


def save(index: Index, path: str, buckets: int = BUCKETS, chunked: bool = False) -> None:
    """Writes postings (a row for each token of each block of chunks, see scoring.posted()), words, chunks and
    stats below path. The postings of a frequent token are dealt over several slots, by their blocks, so
    that no bucket holds all of them; so are the blocks' names. Postings are shuffled once, as lists. chunked:
    the chunks lie there already."""
    spark = index.chunks.sparkSession
    slots = F.greatest(F.ceil(F.col("df") / SLOT_ROWS), F.lit(1)).cast("int")
    words = index.idf.select("token", "df", "raw_idf", "idf", slots.alias("slots"))
    terms = index.slim()
    one = F.array(F.struct("n_tokens", "words")).alias("texts")
    lists = posted(_together(terms) if index.repeats() else terms.select(*NAMES, one))
    often = _small(words.filter("slots > 1").select("token", "slots"))
    number = F.pmod(F.xxhash64("block"), F.when(F.col("token").isNull(), buckets).otherwise(F.coalesce("slots", F.lit(1))))
    slot = _slot(F.coalesce("token", F.lit("")), number)
    tables = {"postings": lists.join(often, "token", "left").withColumn("slot", slot), "words": words}
    for name, df in tables.items():
        by, at = _BY[name], f"attesta_{uuid.uuid4().hex}"
        out = df.select(*_TABLES[name]).repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
        out.option("compression", "zstd").option("path", f"{path}/{name}").saveAsTable(at)
        spark.sql(f"DROP TABLE {at}")  # the name; the files of an external table stay
    if not chunked:
        index.chunks.drop("tokens").write.option("compression", "zstd").parquet(f"{path}/chunks")
    index.stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/stats")


def load(spark: SparkSession, path: str, picked: int = PICKED) -> Stored:
    """The index that save() has written, in any session. Nothing is counted again."""
    stats = spark.read.parquet(f"{path}/stats")
    buckets = stats.first()["buckets"]  # one row
    found = {}
    for name, columns in _TABLES.items():
        at, by = f"attesta_{uuid.uuid4().hex}", _BY[name]
        spark.sql(
            f"CREATE TABLE {at} ({', '.join(f'{c} {kind}' for c, kind in columns.items())}) USING parquet OPTIONS (path '{path}/{name}') "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS"
        )
        found[name] = spark.table(at)
    words = found["words"]
    return Stored(
        spark.read.parquet(f"{path}/chunks"), stats.drop("buckets"), words.select("token", "df", "raw_idf", "idf"),
        found["postings"], words, picked,
    )
