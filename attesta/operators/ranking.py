"""Rankings compared: fusion, recall, reciprocal rank, separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..vocabulary import FUSION_K

#: Rows of a query that one split holds, about; rows that are sampled for each split.
SPLIT_ROWS, SAMPLED = 50_000, 64
#: Queries, and splits of all of them, that are sent to all tasks; more are joined.
MANY = 100_000


def _small(df: DataFrame, n: int = MANY) -> DataFrame:
    """df for a join: sent to all tasks if it has at most n rows, left to the planner otherwise."""
    rows = df.limit(n + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= n else df


def split_points(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, _at): keys in order that cut a query's rows into parts of about SPLIT_ROWS, from a
    sample of the keys drawn by their hash. Keys hold the id, so equal scores are cut as well."""
    parts = F.ceil(F.col("n") / SPLIT_ROWS)
    rate = F.least(F.lit(1.0), parts * SAMPLED / F.col("n")) * (1 << 30)
    drawn = scores.join(sizes.filter(F.col("n") > SPLIT_ROWS), "query_id")
    drawn = drawn.filter(F.pmod(F.xxhash64("item_id", F.lit("split")), F.lit(1 << 30)) < rate)
    keys = drawn.groupBy("query_id").agg(F.array_sort(F.collect_list(_key())).alias("keys"), F.first(parts).alias("parts"))
    size = F.size("keys")
    place = F.transform(F.sequence(F.lit(1), (F.col("parts") - 1).cast("int")), lambda i: F.floor(i * size / F.col("parts")).cast("int"))
    return keys.select("query_id", F.array_distinct(F.transform(place, lambda i: F.get("keys", i))).alias("_at"))


def _key() -> Column:
    return F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))


def in_splits(scores: DataFrame) -> DataFrame:
    """scores with _split, the part that a row lies in, from the best part on. Splits of a query hold
    about equally many rows, whatever its scores are."""
    sizes = scores.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = sizes.orderBy(F.desc("n")).limit(MANY + 1).collect()
    most = rows[0]["n"] if rows else 0
    if most <= SPLIT_ROWS:
        return scores.withColumn("_split", F.lit(0))
    if len(rows) <= MANY:
        sizes = F.broadcast(scores.sparkSession.createDataFrame(rows, sizes.schema))
    points = _small(split_points(scores, sizes), MANY * SPLIT_ROWS // most)
    at = scores.join(points, "query_id", "left").withColumns({"_split": F.lit(0), "_k": _key()})
    step = 1 << int(most // SPLIT_ROWS).bit_length()
    while step:  # a binary search: each step is bound once
        beyond = F.get("_at", F.col("_split") + F.lit(step - 1)) < F.col("_k")
        at = at.withColumn("_split", F.col("_split") + F.when(F.coalesce(beyond, F.lit(False)), step).otherwise(0))
        step //= 2
    return at.drop("_at", "_k")


def ranked(scores: DataFrame, most: int | None = None) -> DataFrame:
    """All rows of a query with their ranks. Rows are dealt into splits of about SPLIT_ROWS, see
    in_splits(); a split is sorted by itself, and the rows of the splits before it are added. No task
    holds more of a query than a split. most: a bound of a query's rows, if one is known; with one
    below SPLIT_ROWS every query is one split and scores are read once, without one up to four times,
    so costly ones should be kept."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    if most is not None and most <= SPLIT_ROWS:
        return scores.withColumn("rank", F.row_number().over(order))
    at = in_splits(scores)
    sizes = at.groupBy("query_id", "_split").agg(F.count("*").alias("_n"))
    so_far = W.partitionBy("query_id").orderBy("_split")
    before = sizes.select("query_id", "_split", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"))
    order = W.partitionBy("query_id", "_split").orderBy(F.desc("score"), "item_id")
    at = at.withColumn("_r", F.row_number().over(order)).join(before, ["query_id", "_split"])
    rank = (F.col("_before") + F.col("_r")).cast("int").alias("rank")
    return at.select(*(F.col(f"`{c}`") for c in scores.columns), rank)


def best(scores: DataFrame, k: int, *within: str) -> DataFrame:
    """The k best rows of each query, within groups if some are named, with their ranks; each task
    keeps k of a query before they meet."""
    order = W.partitionBy("query_id", *within).orderBy(F.desc("score"), "item_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(a: DataFrame, b: DataFrame, k: int = FUSION_K, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two rankings over the same items. most: see ranked()."""
    both = a.select("query_id", "item_id", F.col("rank").alias("ra")).join(
        b.select("query_id", "item_id", F.col("rank").alias("rb")), ["query_id", "item_id"]
    )
    score = F.lit(1.0) / (k + F.col("ra")) + F.lit(1.0) / (k + F.col("rb"))
    return ranked(both.select("query_id", "item_id", score.alias("score")), most)


def first_relevant(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, tier, first_rank) for relevant(query_id, tier, item_id); null if it isn't ranked."""
    found = ranking.groupBy("query_id", "item_id").agg(F.min("rank").alias("first_rank"))
    return relevant.join(found, ["query_id", "item_id"], "left").select("query_id", "tier", "first_rank")


def recall_mrr(first: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per tier and for all: n, recall at each k, mean reciprocal rank (0 for what isn't found)."""
    at = [
        F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}")
        for k in ks
    ]
    mrr = (F.sum(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))) / F.count("*")).alias("mrr")
    out = first.rollup("tier").agg(F.count("*").alias("n"), *at, mrr)
    return out.withColumn("tier", F.coalesce("tier", F.lit("all")))


def separation(top: DataFrame) -> DataFrame:
    """One row for top(query_id, on_topic, top_score, top_coverage): worst on-topic and best
    off-topic score, whether they are apart, their midpoint, and what a coverage gate would do."""
    on, off = F.col("on_topic"), ~F.col("on_topic")
    at = top.agg(
        F.min(F.when(on, F.col("top_score"))).alias("min_on_topic"),
        F.max(F.when(off, F.col("top_score"))).alias("max_off_topic"),
        F.count_if(off & (F.col("top_coverage") < 0.6)).alias("refused_off_topic"),
        F.count_if(off).alias("n_off_topic"),
        F.count_if(on & (F.col("top_coverage") < 0.6)).alias("refused_on_topic"),
        F.count_if(on).alias("n_on_topic"),
    )
    clean = F.col("min_on_topic") > F.col("max_off_topic")
    mid = (F.col("min_on_topic") + F.col("max_off_topic")) / 2
    return at.withColumns({"clean": F.coalesce(clean, F.lit(False)), "midpoint": F.when(clean, mid)})


def best_method(metrics: DataFrame) -> DataFrame:
    """(tier, method) with the highest reciprocal rank per tier; ties by name."""
    return metrics.groupBy("tier").agg(
        F.max_by("method", F.struct(F.col("mrr"), F.col("method"))).alias("method")
    )
