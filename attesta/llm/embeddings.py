"""Near-duplicate vectors with a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, connected_components, materialize, merge_labels, order_id, sorted_groups
from .vectors import matrices, rows_of

TREES = 8
#: Vectors a leaf is meant to get (all labels together).
LEAF = 2000
#: Rows that trees are fitted on, for few and for very many vectors, and the fewest of a leaf.
SAMPLE, MOST, FEW = 20_000, 200_000, 8
#: Random directions that are tried at a split, and the part of the rows that either side gets at most.
TRIES, SIDE = 3, 0.8
TILE = 256
#: A vector goes to both sides of a split if it is nearer to it than this many standard deviations
#: of the projected difference of two vectors at the threshold. A pair is lost at a split only if the
#: difference is over twice that.
SPILL = 0.5
#: Rows of a leaf above which it is cut into parts, and pairs of parts are dealt over tasks.
HOT = 20_000


class Tree:
    """A tree of random splits near medians, as arrays. Leaf numbers are below 2**20; parts tells into
    how many parts a leaf is cut."""

    def __init__(self, sample: np.ndarray, seed: int, n: int, margin: float):
        self._rng = np.random.default_rng([seed, 17])
        self._margin = margin
        self._scale = n / max(1, len(sample))
        self._nodes: list[tuple | None] = []
        self.parts: list[int] = []
        self._grow(sample, max(FEW, int(LEAF / self._scale)))

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        at = len(self._nodes)
        self._nodes.append(None)
        if len(x) > leaf and (cut := self._cut(x)):
            way, cut, p = cut
            left = self._grow(x[p < cut + self._margin], leaf)
            right = self._grow(x[p >= cut - self._margin], leaf)
            self._nodes[at] = (way, cut, left, right)
            return at
        self._nodes[at] = (len(self.parts),)
        self.parts.append(max(1, int(len(x) * self._scale / HOT)))
        return at

    def _cut(self, x: np.ndarray) -> tuple | None:
        """Of some random directions and the places between the 30th and 70th percentile, the split
        that fewest vectors are near to; none, if a side would still get almost all."""
        best = None
        for _ in range(TRIES):
            way = self._rng.standard_normal(x.shape[1])
            way /= np.linalg.norm(way)
            p = x @ way
            order = np.sort(p)
            cuts = order[(np.linspace(0.3, 0.7, 9) * (len(p) - 1)).astype(int)]
            low = np.searchsorted(order, cuts - self._margin)
            high = np.searchsorted(order, cuts + self._margin)
            side = np.maximum(high, len(p) - low) / len(p)
            both = np.where(side <= SIDE, high - low, len(p) + 1)
            k = int(both.argmin())
            if both[k] <= len(p) and (best is None or both[k] < best[0]):
                best = (int(both[k]), way, float(cuts[k]), p)
        return best[1:] if best else None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): every leaf of each row; home tells the one that it would get without
        spill."""
        rows, leaves, homes = [], [], []
        todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            at, who, home = todo.pop()
            if not len(who):
                continue
            node = self._nodes[at]
            if len(node) == 1:
                rows.append(who)
                leaves.append(np.full(len(who), node[0], np.int64))
                homes.append(home)
                continue
            way, cut, left, right = node
            p = x[who] @ way
            low, a, b = p < cut, p < cut + self._margin, p >= cut - self._margin
            todo += [(left, who[a], (home & low)[a]), (right, who[b], (home & ~low)[b])]
        return tuple(map(np.concatenate, (rows, leaves, homes)))


def embedding_components(
    df: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    trees: int = TREES,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: vectors of one label and length are linked at a
    cosine, in double precision, of at least `threshold`.

    Equal vectors of a label are one class, counted but not expanded. Trees are fitted on SAMPLE to
    MOST classes; every class goes down all trees, to both sides of a split near it. A class is
    compared, in tiles, with the members of its home leaf of each tree. A link is counted in the
    first tree whose home leaf has it, which is told by taking the linked vectors down the trees
    before, so pairs are never written: a leaf gives counts and a link to a root for each class. A
    leaf that splits can't part is cut into parts of about HOT rows, and each pair of parts is a group
    of its own, so no task holds more than two parts. Lengths with at most LEAF classes are compared
    without trees. Recall is measured in the tests, with trees that split.

    Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link
    with nothing. Null ids come last; a component of them alone has a null id. Repeated rows link to
    each other, rows of one id and different vectors are judged apart. An empty table gives no rows;
    other columns are ignored."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("x"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = np.full(b.num_rows, None, object)
            for at, x in matrices(b.column(2)):
                some = (x != 0).any(axis=1)
                for i, v in zip(at[some], x[some] + 0.0):
                    vectors[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(vectors, pa.binary())], ["id", "label", "v"]
            )

    rows = materialize(rows.mapInArrow(pack, "id long, label string, v binary"), "rows")
    linkable = rows.filter("label is not null and v is not null")
    # a class goes by a hash of its label and vector; ids may repeat
    classes = materialize(
        linkable.groupBy("label", "v")
        .agg(F.min(order_id("id")).alias("low"), F.count("*").alias("many"))
        .withColumn("name", F.xxhash64("label", "v")),
        "classes",
    )
    links = materialize(_links(classes, threshold, trees), "links")
    counts = links.groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"))
    parts = connected_components(links.filter("a <> b").select("a", "b"))
    known = (
        classes.join(counts, "name", "left")
        .join(parts, F.col("name") == parts["node"], "left")
        .select(
            "label", "v", "low", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("component", "name").alias("part"),
        )
    )
    least = known.groupBy("part").agg(F.min("low").alias("component_id"))
    known = known.join(least, "part").select("label", "v", "n_links", "component_id")
    out = rows.join(known, ["label", "v"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component < LAST, component).alias("component_id"),
        (order_id("id") == F.coalesce(component, F.lit(LAST))).alias("kept"),
    )


_MEMBER = "label string, v binary, name long, many long, leaf int, part long, home boolean, partner boolean"


def _links(classes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(a, b, n): n more links of class a; b is a class that a is linked to, its root in a leaf."""
    size = F.octet_length("v")
    counts = {r[0]: r[1] for r in classes.groupBy(size).count().filter(F.col("count") > LEAF).collect()}
    few = classes.filter(~size.isin([*counts])) if counts else classes
    plain = few.select(
        "label", "v", "name", "many", F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("part"),
        F.lit(True).alias("home"), F.lit(True).alias("partner"),
    )
    out = _compared(plain, [], threshold)
    for length, n in sorted(counts.items()):
        own = classes.filter(size == length)
        out = out.unionByName(_forest_links(own, n, threshold, trees))
    return out


def _forest_links(classes: DataFrame, n: int, threshold: float, trees: int) -> DataFrame:
    """_links() of vectors of one length, by a forest."""
    wanted = min(n, max(SAMPLE, min(MOST, FEW * n // LEAF)))
    drawn = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    sample = _units(np.array([np.frombuffer(r["v"], np.float64) for r in drawn]))
    margin = SPILL * np.sqrt(max(0.0, 2 - 2 * threshold) / sample.shape[1])
    forest = [Tree(sample, t, n, margin) for t in range(trees)]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                x = _units(rows_of(b.column(1), np.float64))
                name = b.column(2).to_numpy().view(np.uint64)
                for t, tree in enumerate(forest):
                    row, leaf, home = tree.place(x)
                    who, part, asks, partner = _dealt(name[row], home, np.array(tree.parts)[leaf])
                    own = b.take(pa.array(row[who]))
                    code = (leaf[who] | t << 20).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, *map(pa.array, (code, part, asks, partner))],
                        ["label", "v", "name", "many", "leaf", "part", "home", "partner"],
                    )

    return _compared(classes.select("label", "v", "name", "many").mapInArrow(plant, _MEMBER), forest, threshold)


def _dealt(
    name: np.ndarray, home: np.ndarray, parts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair of parts, asks, partner) for the members of leaves that are cut into `parts`. A member
    of part p is a partner in the pairs (i, p); if the leaf is its home, it asks in the pairs (p, j).
    Both are one row in (p, p)."""
    own = (name % parts.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(name)), parts)
    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    asks = home[row] & (other == own[row])
    pair = other * parts[row] + own[row]
    # rows that ask in another part's pairs and are no partners there
    more = np.flatnonzero(home[row] & (other != own[row]))
    pair_more = own[row[more]] * parts[row[more]] + other[more]
    partner = np.concatenate([np.ones(len(row), bool), np.zeros(len(more), bool)])
    asks = np.concatenate([asks, np.ones(len(more), bool)])
    return np.concatenate([row, row[more]]), np.concatenate([pair, pair_more]), asks, partner


def _compared(members: DataFrame, forest: list[Tree], threshold: float) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "key"):
            if group.num_rows < 2:
                continue
            names = np.array(group["label"].to_pylist(), object)
            code, part = group["leaf"].to_numpy(), group["part"].to_numpy()
            size = np.array([len(v) for v in group["v"].to_pylist()])
            # one key for two leaves is possible, though rare
            for own in {*zip(names, code.tolist(), part.tolist(), size.tolist())}:
                one = group.filter(pa.array((names == own[0]) & (code == own[1]) & (part == own[2]) & (size == own[3])))
                found = _leaf(one, own[1] >> 20, forest, threshold)
                if found.num_rows:
                    yield found

    keyed = members.withColumn("key", F.xxhash64("label", "leaf", "part", F.octet_length("v")))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, n long")


def _units(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small components would leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _leaf(group: pa.Table, tree: int, forest: list[Tree], threshold: float) -> pa.RecordBatch:
    x = _units(rows_of(group["v"].combine_chunks(), np.float64))
    name, many = group["name"].to_numpy(), group["many"].to_numpy()
    here = np.flatnonzero(group["home"].to_numpy(zero_copy_only=False))
    there = np.flatnonzero(group["partner"].to_numpy(zero_copy_only=False))
    partners = x if len(there) == len(x) else x[there]
    counts = np.zeros(len(x), np.int64)
    labels = np.arange(len(x))
    for at in range(0, len(here), TILE):
        rows = here[at : at + TILE]
        for start in range(0, len(there), 4096):
            near = x[rows] @ partners[start : start + 4096].T >= threshold
            i, j = np.nonzero(near)
            i, j = rows[i], there[j + start]
            keep = i != j
            i, j = i[keep], j[keep]
            merge_labels(labels, i, j)
            if len(i) and tree:
                new = ~_met_before(x, i, j, forest[:tree])
                i, j = i[new], j[new]
            counts += np.bincount(i, weights=many[j], minlength=len(x)).astype(np.int64)
    told = (counts > 0) | (labels != np.arange(len(x)))
    return pa.RecordBatch.from_arrays(
        [pa.array(name[told]), pa.array(name[labels[told]]), pa.array(counts[told])], ["a", "b", "n"]
    )


def _met_before(x: np.ndarray, i: np.ndarray, j: np.ndarray, forest: list[Tree]) -> np.ndarray:
    """Which pairs of rows have j in the home leaf of i in one of the trees."""
    met = np.zeros(len(i), bool)
    who, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    for tree in forest:
        row, leaf, home = tree.place(x[who])
        own = np.empty(len(who), np.int64)
        own[row[home]] = leaf[home]
        met |= np.isin(b << 20 | own[a], row << 20 | leaf)
    return met


def op2_forest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings
  UNION
  SELECT l.b AS id, r.c FROM r JOIN l ON r.id = l.a
), k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, k.component_id,
       e.vec_id = k.component_id AS kept
FROM embeddings e JOIN k ON k.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
