"""K-d tree sharding: documents as points, split at distributed weighted quantiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Points next to a cut that may change sides, so that both get the bytes meant for them.
NEAR = 200
#: Rows that agree in all they return, above which they are dealt again before they get their slots.
BLOCK = 10_000
#: Dimensions of a point, each an integer of 0 to 2**31 - 1.
DIMS = ("d_size", "d_source", "d_lang", "d_id")
_BITS = 31
_STEP = 10


def shard_by_bytes(
    df: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    lang_col: str | None = "lang",
) -> DataFrame:
    """Deals documents to `shards` shards of near equal bytes by a k-d tree.

    Equal texts are one point and always stay together. The tree splits each node along its widest
    dimension (extent relative to the whole extent) at the weighted quantile that gives both sides
    the bytes of their shards, until a node is one shard; quantiles come from histograms, refined in
    passes, that are summed on the executors. What the point at a cut is too large by is made up for
    by at most NEAR points next to the cut, largest first, which change sides. A group of equal texts that
    holds more than a shard's share has a shard to itself; the other shards share the rest.

    Returns id, size (UTF-8 bytes of the text + 1), text_crc32, law 'bytes', shard, slot (gapless
    from 0 in each shard, by id), grown_shard (null). Null text: size 1, crc 0, one group with the
    empty text. Null ids, sources and langs are points at 0; rows of one id are dealt by their
    texts, each row once. An empty table gives no rows. Other columns are ignored."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unit = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))).bitwiseAND(2**31 - 1)
    docs = materialize(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("group_hash"),
            (unit(F.col(source_col)) if source_col else F.lit(0).cast("long")).alias("d_source"),
            (unit(F.col(lang_col)) if lang_col else F.lit(0).cast("long")).alias("d_lang"),
        ),
        "sizes",
    )
    total = docs.agg(F.sum("size"), F.max("id"), F.min("id"), F.count("*")).first()
    if not total[3]:
        return _result(docs.withColumn("shard", F.lit(0)), id_col, 0)
    key = ["group_hash", "size"]
    points = materialize(_points(docs, key, total[2] or 0, total[1] or 0), "points")
    alone = own_shards(points, shards, total[0])
    left = list(range(len(alone), shards))
    light = points
    if alone:
        named = F.array(*(F.lit(h) for h, _ in alone))
        light = points.filter(~F.array_contains(named, F.col("group_hash")))
    shard = _walk(_fit(light, left))
    for n, (h, _) in enumerate(alone):
        shard = F.when(F.col("group_hash") == h, n).otherwise(shard)
    placed = points.select(*key, shard.alias("shard"))
    return _result(docs.join(placed, key), id_col, total[3])


def _points(docs: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """A point per group of equal texts, with its weight in bytes."""
    at = F.coalesce("low_id", F.lit(low)) - low
    return (
        docs.groupBy(*key)
        .agg(
            F.sum("size").alias("weight"),
            F.min("d_source").alias("d_source"),
            F.min("d_lang").alias("d_lang"),
            F.min("id").alias("low_id"),
        )
        .select(
            *key,
            "weight",
            "d_source",
            "d_lang",
            F.least(F.lit(2**31 - 1), F.log2(F.col("size").cast("double")) * 2**25).cast("long").alias("d_size"),
            (at / F.lit(max(1, high - low)) * (2**31 - 1)).cast("long").alias("d_id"),
            # ties at a cut fall by this, so a cut can pass through equal coordinates
            F.col("group_hash").bitwiseAND(2**31 - 1).alias("d_tie"),
        )
    )


def own_shards(points: DataFrame, shards: int, total: int) -> list[tuple[int, int]]:
    """(hash, weight) of the groups that hold more than an even share of what the groups before them
    leave, largest first: at most one less than there are shards."""
    rows = points.orderBy(F.desc("weight"), "group_hash").select("group_hash", "weight").limit(shards - 1)
    alone: list[tuple[int, int]] = []
    for row in rows.collect():  # fewer rows than shards
        if row["weight"] * (shards - len(alone)) <= total:
            break
        alone.append((row["group_hash"], row["weight"]))
        total -= row["weight"]
    return alone


@dataclass(eq=False)
class _Node:
    shards: list[int]
    dim: str = ""
    cut: int = 0
    #: points that the cut leaves on one side and that belong to the other
    moved: tuple[int, ...] = ()
    left: _Node | None = None
    right: _Node | None = None


def _position(dim: str) -> Column:
    """A coordinate with its tie-break, as one 62-bit integer."""
    return F.shiftleft(F.col(dim), _BITS).bitwiseOR(F.col("d_tie"))


def _walk(node: _Node, number: dict | None = None) -> Column:
    """Takes a point down the tree: to its shard, or with `number` to that of an open leaf, else -1."""
    if node.left is None:
        return F.lit(node.shards[0] if number is None else number.get(node, -1))
    low = _position(node.dim) < node.cut
    if node.moved:
        low = low != F.array_contains(F.array(*(F.lit(h) for h in node.moved)), F.col("group_hash"))
    return F.when(low, _walk(node.left, number)).otherwise(_walk(node.right, number))


def _fit(points: DataFrame, shards: list[int]) -> _Node:
    """Grows the tree a level at a time: one pass finds the extents of all open leaves, some more
    their cuts, one the points next to these."""
    root = _Node(shards)
    level, whole = [root], None
    while level := [x for x in level if len(x.shards) > 1]:
        at = points.withColumn("node", _walk(root, {x: n for n, x in enumerate(level)}))
        at = at.filter("node >= 0")
        extent = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {
            r["node"]: r for r in at.groupBy("node").agg(F.sum("weight").alias("w"), *extent).collect()
        }
        wide = lambda r, d: r[f"hi_{d}"] - r[f"lo_{d}"]
        if whole is None:
            whole = {d: max(1, wide(stats[0], d)) if stats else 1 for d in DIMS}
        need = {}
        for n, x in enumerate(level):
            mid = len(x.shards) // 2
            x.left, x.right, x.dim = _Node(x.shards[:mid]), _Node(x.shards[mid:]), DIMS[0]
            if n in stats:
                x.dim = max(DIMS, key=lambda d: wide(stats[n], d) / whole[d])
                need[n] = mid / len(x.shards) * stats[n]["w"]
        dims = {n: level[n].dim for n in need}
        cuts, short = _cuts(at, dims, need)
        for n, moved in _evened(at, dims, cuts, short).items():
            level[n].cut, level[n].moved = cuts[n], moved
        level = [y for x in level for y in (x.left, x.right)]
    return root


def _evened(
    at: DataFrame, dims: dict[int, str], cuts: dict[int, int], short: dict[int, float]
) -> dict[int, tuple[int, ...]]:
    """For each node, the points that change sides: of the NEAR ones next to the cut, on the side
    that has too many bytes, the largest that still fit what is missing, one after another."""
    out = dict.fromkeys(cuts, ())
    sides = []
    for n, cut in cuts.items():
        if abs(short[n]) < 1:
            continue
        pos = _position(dims[n])
        side = at.filter((F.col("node") == n) & ((pos >= cut) if short[n] > 0 else (pos < cut)))
        near = side.orderBy(pos.asc() if short[n] > 0 else pos.desc(), "group_hash", "size").limit(NEAR)
        sides.append(near.select("node", "group_hash", "weight"))
    if not sides:
        return out
    rows: dict[int, list] = {}
    for r in reduce(DataFrame.unionByName, sides).collect():  # at most NEAR rows a node
        rows.setdefault(r["node"], []).append((r["weight"], r["group_hash"]))
    for n, near in rows.items():
        left, moved, rest = abs(short[n]), [], []
        for weight, name in sorted(near, reverse=True):
            if weight <= left:
                moved.append(name)
                left -= weight
            else:
                rest.append((weight, name))
        # the least of the others, if it is too large by less than what is left
        if rest and rest[-1][0] < 2 * left:
            moved.append(rest[-1][1])
        out[n] = tuple(moved)
    return out


def _cuts(
    at: DataFrame, dims: dict[int, str], need: dict[int, float]
) -> tuple[dict[int, int], dict[int, float]]:
    """For each node, the position below which the needed weight lies, as near as a point allows, and
    what is still short there (below zero: too much). Each pass sums at most 2**_STEP bins a node and
    goes on inside the bin that holds the cut."""
    if not need:
        return {}, {}
    width, bits, cut, prefix = 2 * _BITS, 0, {}, dict.fromkeys(need, 0)
    need = dict(need)
    pos = F.coalesce(*(F.when(F.col("node") == n, _position(d)) for n, d in dims.items()))
    at = at.select("node", "weight", pos.alias("pos"))
    while prefix:
        shift, bits = width - bits, min(width, bits + _STEP)
        inside = F.lit(False)
        for n, b in prefix.items():
            inside = inside | ((F.col("node") == n) & (F.shiftright("pos", shift) == b))
        bins: dict = {n: [] for n in prefix}
        for r in (
            at.filter(inside)
            .groupBy("node", F.shiftright("pos", width - bits).alias("bin"))
            .agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
            .collect()
        ):
            bins[r["node"]].append((r["bin"], r["w"], r["n"]))
        for n in list(prefix):
            for b, w, k in sorted(bins[n]):
                if need[n] < w:
                    if k == 1 or bits == width:  # one point: it goes to the side that is nearer
                        low = need[n] > w / 2
                        cut[n] = b + low << width - bits
                        need[n] -= w if low else 0
                    break
                need[n] -= w
            else:
                cut[n] = (max(bins[n])[0] + 1) << width - bits
            if n in cut:
                del prefix[n]
            else:
                prefix[n] = b
    return cut, need


def _result(docs: DataFrame, id_col: str, rows: int) -> DataFrame:
    """Adds slots: rows in order of id, size and text_crc32 in a bucket of the shard, after the rows of
    the buckets before it. Rows that agree in all three are one counted row until they have their
    slots, so any number of them costs one; large counts are dealt again before they become rows."""
    buckets = max(8, min(4096, rows // 20_000))
    name = ["id", "size", "text_crc32"]
    bucket = F.pmod(F.xxhash64(*name), F.lit(buckets)).cast("int")
    alike = materialize(
        docs.groupBy("shard", bucket.alias("bucket"), *name).agg(F.count("*").alias("n")), "alike"
    )
    counts = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("count"))  # at most shards * 4096 rows
    before = counts.select(
        "shard",
        "bucket",
        (
            F.sum("count").over(W.partitionBy("shard").orderBy("bucket")) - F.col("count")
        ).alias("before"),
    )
    upto = F.sum("n").over(W.partitionBy("shard", "bucket").orderBy(*name))
    placed = alike.withColumn("first", upto - F.col("n")).join(F.broadcast(before), ["shard", "bucket"])
    placed = placed.withColumn("first", F.col("first") + F.col("before"))
    last = F.col("first") + F.col("n") - 1
    few = placed.filter(F.col("n") <= BLOCK).withColumn("slot", F.explode(F.sequence("first", last)))
    starts = F.explode(F.sequence("first", last, F.lit(BLOCK).cast("long")))
    many = placed.filter(F.col("n") > BLOCK).withColumn("last", last).withColumn("start", starts).repartition("start")
    ends = F.least(F.col("last"), F.col("start") + BLOCK - 1)
    many = many.withColumn("slot", F.explode(F.sequence("start", ends)))
    return few.unionByName(many.drop("last", "start")).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
