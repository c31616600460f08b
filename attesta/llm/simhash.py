"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    LAST, cleanup, connected_components, lean, made, materialize, merge_labels, order_id, release, row_key,
    slices, sorted_groups,
)

SEED = 42
TILE = 1024
#: A bucket of more fingerprints than this is dealt over tasks by population count.
HOT_BUCKET = 4096
#: Fewest and most bits of a set's sketch, and rows that the order of prefixes is set by.
NARROW, WIDE = 512, 4096
SAMPLE = 8000


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits of the shingles of a text: a bit is set where over half of their hashes have it."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    hash_ = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hash_(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    n = len(starts)
    hashes = np.fromiter(
        (hash_(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def link(prints: np.ndarray, radius: int, step: int = -1) -> np.ndarray:
    """Class roots (indices) of fingerprints linked at `radius` or fewer differing bits. They are
    compared in tiles in the order of their population counts; tile pairs whose counts differ
    beyond the radius are skipped. step > 0: only pairs whose counts differ by it."""
    ones = np.bitwise_count(prints)
    order = np.argsort(ones, kind="stable")
    x, ones = prints[order], ones[order].astype(np.int16)
    labels = np.arange(len(x))
    for i in range(0, len(x), TILE):
        a, top = x[i : i + TILE, None], ones[min(i + TILE, len(x)) - 1]
        for j in range(i, len(x), TILE):
            if ones[j] - top > radius:
                break
            if step > 0 and ones[min(j + TILE, len(x)) - 1] - ones[i] < step:
                continue
            near = np.bitwise_count(a ^ x[None, j : j + TILE]) <= radius
            p, q = np.nonzero(near)
            other = p + i < q + j
            merge_labels(labels, p[other] + i, q[other] + j)
    roots = np.empty(len(x), np.int64)
    roots[order] = order[labels]
    return roots


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 2,
) -> DataFrame:
    """(id, fingerprint, component_id) for each row of df.

    Documents with one fingerprint are one class, so copies of any number cost one entry. Classes
    meet where they agree in one of radius + 1 blocks of bits, which any two within the radius do;
    each bucket is compared in tiles and gives a link to its root per class, not its pairs. Buckets
    above HOT_BUCKET are dealt over tasks as pairs of population counts within the radius.

    Null text: as empty text, fingerprint zero, linked like any other. Null ids come after all
    others: a component of them alone has a null id. Ids link nothing: rows that share one, or have
    none, are together only if their fingerprints are. Repeated rows are linked. An empty table gives
    no rows; other columns are ignored."""
    schema = f"{id_col} long, fp long"

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                [id_col, "fp"],
            )

    docs = materialize(
        df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
        .mapInArrow(lean(prints), schema),
        "prints",
    )
    classes = materialize(
        docs.groupBy("fp").agg(F.min(F.coalesce(id_col, F.lit(LAST))).alias("low")), "classes"
    )
    parts = connected_components(_edges(classes, radius))
    # classes are named by their fingerprints: ids may be missing, or stand on several of them
    grouped = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("part")
    )
    lows = grouped.groupBy("part").agg(F.min("low").alias("component_id"))
    labelled = grouped.join(lows, "part").select("fp", "component_id")
    return docs.join(labelled, "fp").select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") < LAST, F.col("component_id")).alias("component_id"),
    )


def _edges(classes: DataFrame, radius: int) -> DataFrame:
    bounds = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    blocks = []
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        # hash of the block: equal blocks meet, and unequal ones that do are told apart in the tiles
        value = F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo)
        blocks.append(F.shiftleft(F.xxhash64(F.lit(k), value), 13))
    keyed = classes.select("fp", F.explode(F.array(*blocks)).alias("bucket"))
    sizes = keyed.groupBy("bucket").count().filter("count > 1")
    keyed = keyed.join(sizes, "bucket")
    ones = F.bit_count("fp")
    near = F.concat(
        F.array(ones * 16),
        *(
            F.array((ones - d) * 16 + d, ones * 16 + d)
            for d in range(1, radius + 1)
        ),
    )
    keyed = keyed.select(
        "fp",
        "bucket",
        F.explode(F.when(F.col("count") > HOT_BUCKET, near).otherwise(F.array(F.lit(8)))).alias("t"),
    ).filter("t >= 0")
    keyed = keyed.select((F.col("bucket") + F.col("t")).alias("bucket"), "fp")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, n = [], [], 0
        for group in sorted_groups(batches, "bucket"):
            if group.num_rows < 2:
                continue
            names = group["fp"].to_numpy()
            prints = names.view(np.uint64)
            step = int(group["bucket"][0].as_py()) & 15
            roots = link(prints, radius, step if step < 8 else -1)
            linked = roots != np.arange(len(roots))
            out_a.append(names[linked])
            out_b.append(names[roots[linked]])
            n += int(linked.sum())
            if n > 1 << 16:
                yield _pairs(out_a, out_b)
                out_a, out_b, n = [], [], 0
        if out_a:
            yield _pairs(out_a, out_b)

    return (
        keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(tiles), "a long, b long")
    )


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"]
    )


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    spans = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    found = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64, len(spans))
    return np.unique(found)


def sketch(own: np.ndarray) -> bytes:
    """A set of hashes as bits, as many as it has elements up to the next power of two, NARROW to
    WIDE: each is the parity of those that fall on it. Two sketches, the longer one folded to the
    other's length, differ in at most as many bits as the sets have unshared elements."""
    bits = min(WIDE, max(NARROW, 1 << max(0, len(own) - 1).bit_length()))
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(own: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements of a set in an order that all sets share (those of `common` last, by their
    counts): as many that two sets of the given similarity share at least one."""
    n = len(own)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))]
    return own[: n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0]


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in about SAMPLE rows, sorted, and their counts. They only set the
    order of prefixes: any order gives the same pairs."""
    total = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64("key", F.lit("common")), F.lit(1 << 20)) < (SAMPLE << 20) // max(total, 1))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t.as_py() or b"", words) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    found = (
        drawn.mapInArrow(lean(spread), "h long").groupBy("h").count().filter("count > 3")
        .orderBy(F.desc("count"), "h").limit(1 << 16).collect()
    )
    common = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], np.array([r["count"] for r in found], np.int64)[order]


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    keys: int = 4,
) -> DataFrame:
    """(id, key, component_id, keeper) for each row: texts whose sets of shingles have a Jaccard
    similarity of at least `similarity` are linked, all of them; component_id is the smallest id
    reachable (null if none has one), keeper the key of a row that has it. A key names a row's id and
    text (row_key()), so rows of one id and different texts are told apart; rows without an id come
    after all others.

    Two such sets share an element of their prefixes, so texts meet there, in two rounds: first
    where they share one of the `keys` first elements, which links almost all; then, by the whole
    prefixes, those that aren't of one component yet. Where texts meet, their sketches are compared
    in tiles; the bits that may differ follow from the sizes of the two sets, so no true pair is
    lost, and sketches grow with their sets, so that few others pass. The sets of those that find a partner are fetched and pairs are checked exactly, but for
    pairs that are linked by then. Equal sets are one class from the start. Texts without words are
    equal. A bucket of more than HOT_BUCKET is dealt over tasks as pairs of its parts; a task holds
    one bucket or pair, with sets only where sketches met."""
    rows = df.select(
        row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("t"),
        order_id(id_col).alias("id"),
    )
    unsettled = partial(_unsettled, similarity=similarity)
    common, counts = _common(rows, words)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t.as_py() or b"", words) for t in batch.column(1).cast(pa.binary())]
            same = [xxhash.xxh64_intdigest(own.tobytes(), 1) for own in sets]
            first = [prefix(own, similarity, common, counts).view(np.int64) for own in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(same, np.uint64).view(np.int64)),
                    pa.array([len(own) for own in sets], pa.int32()),
                    pa.array([sketch(own) for own in sets], pa.binary()),
                    pa.array(first, pa.list_(pa.int64())),
                    batch.column(2),
                ],
                ["key", "same", "n", "bits", "first", "id"],
            )

    marked = materialize(
        rows.mapInArrow(lean(marks), "key long, same long, n int, bits binary, first array<long>, id long"),
        "marks",
    )
    # a class is named by the key of its first row; a row's key stands in one class only
    classes = materialize(
        marked.groupBy("same").agg(F.min(F.struct("id", "key", "n", "bits", "first")).alias("low"))
        .select("same", "low.id", F.col("low.key").alias("low"), "low.n", "low.bits", "low.first"),
        "classes",
    )
    bits = classes.select("low", "bits")
    near = classes.select(
        "low", "n", F.lit(2**31 - 1).alias("most"), F.col("low").alias("part"),
        F.explode(F.slice("first", 1, keys)).alias("bucket"),
    )
    edges = _verified(rows, near, bits, words, similarity)
    parts = materialize(connected_components(edges), "parts")

    parted = classes.join(parts, classes["low"] == parts["node"], "left").select(
        "low", F.coalesce("component", "low").alias("part"), "first", "n"
    )
    spread = parted.select("low", "part", "n", F.posexplode("first").alias("at", "bucket"))
    # where a pair meets first, what follows in both sets must hold all that it shares: this bounds
    # the size of a partner that shares nothing in front
    reach = (F.col("n") - F.col("at")) * F.lit((1 + similarity) / similarity) - F.col("n")
    spread = spread.select("bucket", "low", "part", "n", F.floor(reach + 1e-6).cast("int").alias("most"))
    open_ = materialize(
        spread.filter(F.col("most") >= F.col("n") * similarity - 1e-6)
        .repartition("bucket").sortWithinPartitions("bucket", "n")
        .mapInArrow(lean(unsettled), "bucket long, low long, part long, n int, most int"),
        "open",
    )
    parts = connected_components(edges.unionByName(_verified(rows, open_, bits, words, similarity)))
    parted = classes.join(parts, classes["low"] == parts["node"], "left").select(
        "same", "id", "low", F.coalesce("component", "low").alias("part")
    )
    first = parted.groupBy("part").agg(F.min(F.struct("id", "low")).alias("first"))
    labelled = parted.join(first, "part").select(
        "same", F.col("first.id").alias("component_id"), F.col("first.low").alias("keeper")
    )
    null_last = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return marked.join(labelled, "same").select(
        null_last("id").alias(id_col), "key", null_last("component_id").alias("component_id"), "keeper"
    )


def _unsettled(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of a stream sorted by bucket and n that have a row of another part, of a size within
    their reach, in their bucket."""

    def several(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, part = batch["bucket"].to_numpy(), batch["part"].to_numpy()
        n, most = batch["n"].to_numpy().astype(np.int64), batch["most"].to_numpy()
        first = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])) << 32
        least = np.ceil(similarity * n - 1e-6).astype(np.int64)
        most = np.minimum(most, np.floor(n / similarity + 1e-6).astype(np.int64))
        low = np.searchsorted(first + n, first + least)
        high = np.searchsorted(first + n, first + most, side="right")
        # runs of one part: the nearest rows of others are those before and after
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(starts[1:], len(part))
        run = np.repeat(np.arange(len(starts)), ends - starts)
        return batch.filter(pa.array((ends[run] < high) | (starts[run] > low)))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch["bucket"].to_numpy()
        # the last bucket may go on in the next batch
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if held and held[0]["bucket"][0].as_py() != bucket[-1]:
            yield several(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = []
        elif not held and cut:
            yield several(batch.slice(0, cut))
        held.append(batch.slice(cut))
    if held:
        yield several(pa.concat_batches(held))


def _verified(rows: DataFrame, near: DataFrame, bits: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of texts of different parts that share a bucket and are similar enough, from
    near(low, n, most, part, bucket), where `most` is the size of the largest partner to be looked for
    in the bucket; rows has the texts by key, bits the sketches, which join when all is decided but
    the tiles."""
    sizes = near.groupBy("bucket").count().filter("count > 1")
    keyed = near.join(sizes, "bucket")
    # a large bucket is cut into parts by key; each pair of parts is a bucket of its own
    parts = F.ceil(F.col("count") / HOT_BUCKET).cast("int")
    own = F.pmod(F.xxhash64("low"), parts).cast("int")
    keyed = keyed.select(
        "low", "n", "most", "part", "bucket", parts.alias("parts"), own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    )
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    keyed = keyed.withColumn("bucket", F.when(F.col("parts") > 1, pair).otherwise(F.col("bucket")))
    schema = "low long, bits binary, part long, bucket long"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "bucket"):
            if group.num_rows < 2:
                continue
            low = group["low"].to_numpy()
            n, most, part = (group[c].to_numpy() for c in ("n", "most", "part"))
            roots = partnered(group["bits"].to_pylist(), n, most, part, similarity)
            many = np.flatnonzero(np.bincount(roots, minlength=len(roots))[roots] > 1)
            if not len(many):
                continue
            # texts that meet in many buckets are one bucket, named by its members
            many = many[np.lexsort((low[many], roots[many]))]
            cuts = np.flatnonzero(np.diff(roots[many])) + 1
            names = [xxhash.xxh64_intdigest(low[own].tobytes(), 2) for own in np.split(many, cuts)]
            sizes = np.diff(np.concatenate([[0], cuts, [len(many)]]))
            named = np.repeat(np.array(names, np.uint64).view(np.int64), sizes)
            out = group.select(["low", "bits", "part", "bucket"]).take(pa.array(many)).combine_chunks()
            yield from out.set_column(out.schema.get_field_index("bucket"), "bucket", pa.array(named)).to_batches()

    met = materialize(
        keyed.select("low", "n", "most", "part", "bucket").join(bits, "low").repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(lean(meet), schema).dropDuplicates(["bucket", "low"]),
        "met",
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [
                shingles(t.as_py() or b"", words).tobytes() for t in batch.column(1).cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], ["low", "set"]
            )

    wanted = met.select(F.col("low").alias("key")).distinct()
    sets = materialize(
        rows.join(wanted.hint("shuffle_hash"), "key").mapInArrow(lean(fetch), "low long, set binary")
        .dropDuplicates(["low"]),
        "sets",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "bucket"):
            low = group["low"].to_numpy()
            roots = checked(
                group["bits"].to_pylist(),
                group["part"].to_numpy(),
                [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()],
                similarity,
            )
            linked = roots != np.arange(len(roots))
            if linked.any():
                yield _pairs([low[linked]], [low[roots[linked]]])

    edges = materialize(
        met.join(sets, "low").select("bucket", "low", "bits", "part", "set")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(verify), "a long, b long"),
        "edges",
    )
    release(met)
    release(sets)
    return edges


def _runs(bits: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Runs of sketches of one length: where each begins, and its rows."""
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    starts = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1]])).tolist() if len(bits) else []
    return [
        (a, np.frombuffer(b"".join(bits[a:b]), np.uint64).reshape(b - a, -1))
        for a, b in zip(starts, [*starts[1:], len(bits)])
    ]


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _may_match(bits: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets of sizes n and m can be similar enough, by their sketches and sizes."""
    apart = sum(np.bitwise_count(bits[..., k] ^ other[..., k]).astype(np.int16) for k in range(bits.shape[-1]))
    most = (1 - similarity) / (1 + similarity) * (n + m) + 1e-6
    return (apart <= most) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)


def partnered(
    bits: list[bytes], n: np.ndarray, most: np.ndarray, part: np.ndarray, similarity: float
) -> np.ndarray:
    """Roots (indices) of the sets of a bucket, linked where two of different parts, neither larger
    than the other's `most`, may be similar enough. They are compared in tiles in the order of their sizes; tile pairs whose sizes are too
    far apart are skipped."""
    order = np.argsort(n, kind="stable")
    n, most, part = n[order].astype(np.int64), most[order], part[order]
    runs = _runs([bits[k] for k in order.tolist()])
    labels = np.arange(len(n))
    tile = TILE // 4
    for at, (i0, rows) in enumerate(runs):
        for j0, wider in runs[at:]:
            if n[i0 + len(rows) - 1] < similarity * n[j0] - 1e-6:
                break
            other = _folded(wider, rows.shape[1])
            for i in range(0, len(rows), tile):
                a = slice(i0 + i, i0 + min(i + tile, len(rows)))
                for j in range(i if i0 == j0 else 0, len(other), tile):
                    b = slice(j0 + j, j0 + min(j + tile, len(other)))
                    if n[a][-1] < similarity * n[b][0] - 1e-6:
                        break
                    near = _may_match(
                        rows[i : i + tile, None], n[a, None], other[None, j : j + tile], n[None, b], similarity
                    )
                    near &= (part[a, None] != part[None, b]) & (n[None, b] <= most[a, None]) & (n[a, None] <= most[None, b])
                    p, q = np.nonzero(near)
                    merge_labels(labels, p + a.start, q + b.start)
    roots = np.empty(len(n), np.int64)
    roots[order] = order[labels]
    return roots


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the other sorted sets has in common with one."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others) if len(others) else np.empty(0, np.uint64)
    if not len(own) or not len(every):
        return np.zeros(len(others), np.int64)
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    total = np.concatenate([[0], np.cumsum(hit)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def checked(bits: list[bytes], part: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Roots (indices) of classes: pairs of different parts whose sets are similar enough. Sets of
    one part that such a pair reaches are of its class."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    n, part = sizes[order], part[order]
    sets = [sets[k] for k in order.tolist()]
    runs = _runs([bits[k] for k in order.tolist()])
    _, first, at = np.unique(part, return_index=True, return_inverse=True)
    labels = first[at]
    for k, (i0, rows) in enumerate(runs):
        others = [(j0, _folded(wider, rows.shape[1])) for j0, wider in runs[k:]]
        for i in range(i0, i0 + len(rows)):
            for j0, other in others:
                start = max(i + 1, j0)
                if start >= len(n) or n[i] < similarity * n[start] - 1e-6:
                    break
                rest = slice(start, j0 + len(other))
                near = _may_match(other[start - j0 :], n[rest], rows[i - i0], n[i], similarity)
                near &= labels[rest] != labels[i]
                found = np.flatnonzero(near) + start
                for c in range(0, len(found), 64):
                    some = found[c : c + 64]
                    some = some[labels[some] != labels[i]]
                    both = shared(sets[i], [sets[j] for j in some.tolist()])
                    true = some[both >= similarity * (n[i] + n[some] - both)]
                    merge_labels(labels, np.full(len(true), i), true)
    # labels are minima of positions in the order of sizes
    roots = np.empty(len(n), np.int64)
    roots[order] = order[labels]
    return roots


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df with one row of each group of near duplicates: the one of smallest id (of several texts of
    that id, any one). Groups are those of near_duplicates(), by id and text together: rows that
    share an id and no text are judged apart. Of repeated rows one stays; columns pass as they are.
    Null texts count as empty, null ids come last, an empty table gives no rows."""
    before = made()
    found = materialize(near_duplicates(df, id_col, text_col, **how), "components")
    cleanup(df.sparkSession, [*before, made()[-1]])
    names = {"_key": row_key(id_col, text_col), "_id": order_id(id_col)}
    rows = df.select(
        *(c.alias(n) for n, c in names.items()), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    )
    own = found.select(F.col("key").alias("_key"), order_id(id_col).alias("_id"), (F.col("key") != F.col("keeper")).alias("gone"))
    gone = own.filter("gone").select(*names).distinct()
    kept = rows.join(gone.hint("shuffle_hash"), [*names], "left_anti")
    if own.filter("not gone").groupBy(*names).count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates([*names])
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
