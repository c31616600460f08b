"""Quality rules: counts of a text, fixed limits on them, and an isolation forest over their rates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Rows that the forest's trees draw from; trees, and rows that each draws.
SAMPLE, TREES, DRAWN = 20_000, 128, 256
#: A rate is taken as if a text had so many more units of the sample's mean: short texts say little.
PRIOR = 20.0
#: How many rejected bad documents one rejected good document is worth, in shares.
CAUTION = 10.0
#: Bins of scores from 0 to 1 for the threshold.
BINS = 4096
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts beside those of COUNTS that the rates need.
MORE = ("n_lines", "n_upper", "n_lower", "n_marks", "top_word", "n_twins")

_SPACE, _SYMBOL, _UPPER, _LOWER, _MARK, _INNER, _OTHER = range(7)


def _kinds() -> np.ndarray:
    """The kind of each byte of UTF-8; _INNER bytes begin no code point."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x21:0x7F] = _MARK
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kind[list(SYMBOLS)] = _SYMBOL
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A] = _UPPER, _LOWER, _OTHER
    kind[0x80:0xC0] = _INNER
    return kind


_KIND = _kinds()


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in windows that occur twice or more. Equal windows get equal numbers, from
    pairs of equal numbers of half their length; nothing is hashed. window: a power of two."""
    if len(ids) <= window:
        return 0
    key, counts, span = ids.astype(np.int64), None, 1
    while span < window:
        both = key[:-span] * (int(key.max()) + 1) + key[span:]
        _, key, counts = np.unique(both, return_inverse=True, return_counts=True)
        if len(counts) == len(key):
            return 0
        span *= 2
    at = np.flatnonzero(counts[key] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of a whole text in UTF-8. bytes.split() parts words at the very bytes 0x20 and
    0x09 to 0x0D."""
    words = text.split()
    if not words:
        return (0,) * (len(COUNTS) + len(MORE))
    kinds = np.zeros(7, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), 1 << 22):
        kinds += np.bincount(_KIND[data[at : at + (1 << 22)]], minlength=7)
    chars = int(kinds.sum() - kinds[_INNER] - kinds[_SPACE])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    top = int(np.bincount(ids).max())
    twins = int((ids[1:] == ids[:-1]).sum())
    return (
        len(words), chars, int(kinds[_SYMBOL]), len(lines) - len(set(lines)), repeated(ids),
        len(lines), int(kinds[_UPPER]), int(kinds[_LOWER]), int(kinds[_MARK]), top, twins,
    )


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, MORE) of every row. Null text: no words, all zero. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measure(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            columns = np.array(found, np.int64).reshape(-1, len(COUNTS) + len(MORE)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns.copy())], ["_id", *COUNTS, *MORE])

    two = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string"))
    schema = ", ".join(["_id long", *(f"{c} long" for c in (*COUNTS, *MORE))])
    return two.mapInArrow(lean(run), schema).withColumnRenamed("_id", id_col)


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words"):
    """Too few words, or too many of them in repeated windows."""
    return (F.col(n_words) < LEAST_WORDS) | (100 * F.col(n_repeat) > MOST_REPEATED * F.col(n_words))


def fractions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numerators, denominators) of the rates that the forest looks at, from rows of COUNTS + MORE."""
    words, chars, symbols, dup, rep, lines, upper, lower, marks, top, twins = counts.T.astype(float)
    over = [
        (chars, words), (symbols, words), (upper, upper + lower), (marks, words),
        (np.maximum(top - 1, 0), words), (twins, words),
    ]
    return np.stack([a for a, _ in over], axis=1), np.stack([b for _, b in over], axis=1)


@dataclass(frozen=True)
class Forest:
    """means: the sample's rates; feature, cut, children, path: of all nodes, roots first. path is what
    a row that ends in a leaf has gone, with what it would have gone on in it; inner nodes: -1."""

    means: np.ndarray
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    usual: float

    def rates(self, counts: np.ndarray) -> np.ndarray:
        """Rates, drawn towards the sample's for short texts."""
        a, b = fractions(counts)
        return (a + PRIOR * self.means) / (b + PRIOR)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """From 0 to 1: 2 to the power of minus the mean path over the usual one. The shorter the paths
        that isolate a row, the higher."""
        x = self.rates(counts)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            inner = rows
            while len(inner := inner[self.path[at[inner]] < 0]):
                node = at[inner]
                at[inner] = self.left[node] + (x[inner, self.feature[node]] >= self.cut[node])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / self.usual)


def usual_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(counts: np.ndarray, trees: int = TREES, drawn: int = DRAWN, seed: int = 13) -> Forest:
    """A forest over rows of counts: each tree draws some of them and splits at random rates, at random
    values between the least and the largest, until rows stand alone or the usual depth is reached."""
    a, b = fractions(counts)
    means = a.sum(axis=0) / np.maximum(b.sum(axis=0), 1)
    x = (a + PRIOR * means) / (b + PRIOR)
    rng = np.random.default_rng(seed)
    drawn = min(drawn, len(x))
    deepest = int(np.ceil(np.log2(max(2, drawn))))
    feature, cut, left, path, roots = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, 0), (cut, 0.0), (left, 0), (path, -1.0)):
            column.append(empty)
        return len(path) - 1

    for _ in range(trees):
        roots.append(node())
        todo = [(roots[-1], x[rng.choice(len(x), drawn, replace=False)], 0)]
        while todo:
            at, rows, depth = todo.pop()
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            wide = np.flatnonzero(hi > lo)
            if depth >= deepest or len(rows) < 2 or not len(wide):
                path[at] = depth + usual_path(len(rows))
                continue
            f = int(rng.choice(wide))
            value = rng.uniform(lo[f], hi[f])
            value = value if value > lo[f] else hi[f]
            feature[at], cut[at] = f, value
            left[at] = node()
            node()
            right = rows[:, f] >= value
            todo += [(left[at], rows[~right], depth + 1), (left[at] + 1, rows[right], depth + 1)]
    columns = (np.array(c) for c in (roots, feature, cut, left, path))
    return Forest(means, *columns, usual=max(usual_path(drawn), 1.0))


def fit(stats: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """The forest over at most about `sample` different rows of counts that pass the base rules, drawn
    by their hash, so that copies of any number are one; none if there are fewer than two."""
    columns = (*COUNTS, *MORE)
    rows = stats.filter(~base_failed()).select(*columns)
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*columns)).alias("n")).first()["n"]
    rate = min(1.0, sample / max(1, n))
    some = F.pmod(F.xxhash64(*columns, F.lit("forest")), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1
    drawn = sorted(tuple(r) for r in rows.filter(some).distinct().collect())  # about `sample` rows
    return grow(np.array(drawn, np.int64)) if len(drawn) > 1 else None


def scored(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats with the column score; null where there is no forest."""
    if forest is None:
        return stats.withColumn("score", F.lit(None).cast("double"))
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([np.asarray(batch.column(names.index(c))) for c in (*COUNTS, *MORE)], axis=1)
            score = forest.scores(counts) if len(counts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(lean(run), f"{schema}, score double")


def threshold(scores: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """The score above which documents go: where the share of labelled bad documents above it, less
    CAUTION times that of good ones, is largest; 1 if nothing is gained or one kind is missing. All
    labelled rows that pass the base rules count, by bins of scores."""
    known = labels.filter(F.col(label_col).isNotNull()).select(id_col, (F.col(label_col) > 0).alias("good"))
    bins = (
        scores.filter(~base_failed()).join(known, id_col)
        .groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(
            F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .filter("bin is not null").collect()
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in bins:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return 1.0
    above = lambda n: np.append(np.cumsum(n[::-1])[::-1], 0) / n.sum()
    gain = above(bad) - CAUTION * above(good)
    best = int(gain.argmax())
    return best / BINS if gain[best] > 0 else 1.0


def rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, COUNTS, base_failed, score, kept) of every row of docs.

    A document is kept if it passes the base rules and its score doesn't exceed the threshold that the
    labels give. Texts are read once: counts go to a table in the shared folder, from which a bounded
    sample gives the forest, all labelled rows the threshold, and all rows their scores.

    Null and empty texts have no words and fail. Null ids have no label; repeated ids and labels count
    again. Without good or bad labelled rows the base rules alone decide. An empty table gives no rows;
    other columns are ignored."""
    stats = materialize(statistics(docs, id_col, text_col), "counts")
    found = scored(stats, fit(stats, sample))
    most = threshold(found, labels.select(F.col(f"`{id_col}`").cast("long").alias(id_col), label_col), id_col, label_col)
    passed = ~base_failed() & ~F.coalesce(F.col("score") >= most, F.lit(False))
    return found.select(id_col, *COUNTS, base_failed().alias("base_failed"), "score", passed.alias("kept"))


def op13_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the rules, see rules()."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rules(docs, labels).drop("score")
