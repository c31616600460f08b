"""The corpus pipeline: from raw documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, packing, simhash, suffix
from attesta.llm.common import cleanup, made, new_folder, ship

#: A document is rejected that fits its best language worse than that language's own documents by
#: this many deviations, and less than this part as well. Neither depends on the other languages;
#: texts too short to be told from clean ones stay.
LEAST_FIT, LEAST_LEVEL = -4.0, 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. Those go that are null, empty or without a letter, and those
    that fit their best language far worse than its own documents of their length. Learns from the
    documents' own labels; null labels are not learned from. Repeated rows fare alike, long texts are
    read whole, an empty table gives no rows, and further columns pass, whatever their names."""
    ship(spark)
    prototypes = langid.fit(docs)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    spread = langid.spreads(docs, prototypes)
    told = langid.predict(docs.select("*"), prototypes, keep=[row], spread=spread)
    fits = (F.col("fit") >= LEAST_FIT) | (F.col("level") >= LEAST_LEVEL)
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & fits)
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, similarity 0.8): the one of
    smallest id, null ids last. Rows of one id and different texts are judged apart; of repeated rows
    one stays. Null and empty texts are copies of each other. An empty table gives no rows; further
    columns pass."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that stand earlier, by id and then by text; n_chars follows
    the text. No row goes; null texts stay null, equal rows are one document and keep what it keeps.
    An empty table gives no rows; further columns pass."""
    ship(spark)
    out = suffix.remove_repeats(docs)
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", size)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Null text: the end id alone. Null ids
    pass, repeated rows are packed again; an empty table gives no rows."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: No stage but the first could be told in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each writes a table that the next one reads. What a stage has
    made on its way, and the table before it, goes once its own is written; the last table stays until
    cleanup(), as the result reads it. Nulls, repeated rows and empty tables: see the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = made()
    for k, (_, stage) in enumerate(STAGES[:-1]):
        folder = new_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{k}")
        cleanup(spark, [*others, folder])
        docs = spark.read.parquet(f"{folder}/stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
