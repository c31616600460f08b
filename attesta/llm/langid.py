"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

DIM = 1024
GRAM = 3
#: Documents of each language that are learned from (all, if fewer).
LEARN = 3000
#: Cosines become shares by a softmax of this temperature.
TEMPERATURE = 0.05
UNKNOWN = "und"
#: With fewer documents a language's spread isn't known.
FEW = 20
#: Texts, and characters of them, that are bundled together; characters and n-grams of a step.
_GROUP, _CHARS = 128, 1 << 20
_STEP, _GRAMS = 1 << 20, 4096
#: Sums of unit vectors are whole multiples of 1 / _UNIT, so that they don't depend on their order.
_UNIT = 1 << 40
#: Labels whose rates are sent to all tasks; more are joined.
_LABELS = 100_000


@lru_cache(maxsize=1 << 14)
def letter(code: int) -> np.ndarray:
    """The random vector of a letter (0: the gap between words), of +1 and -1."""
    return np.random.default_rng([code, 9]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter n-grams of a whole text, as packed code points, and their counts. Runs of
    other characters are one gap; a gap is put before and after the text. Long texts are read in
    steps."""
    text = text.lower()
    found = []
    carry = np.zeros(1, np.int64)
    for at in range(0, max(1, len(text)), _STEP):
        codes = np.frombuffer(text[at : at + _STEP].encode("utf-32-le", "replace"), "<u4")
        codes = np.where(_letters()[codes], codes, 0).astype(np.int64)
        if at + _STEP >= len(text):
            codes = np.append(codes, 0)
        codes = np.concatenate([carry, codes])
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[: len(carry)] = True
        codes = codes[keep]
        carry = codes[-(GRAM - 1) :]
        n = len(codes) - GRAM + 1
        if n > 0:
            packed = np.zeros(n, np.int64)
            for k in range(GRAM):
                packed = packed << 21 | codes[k : k + n]
            found.append(np.unique(packed, return_counts=True))
    if len(found) < 2:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    every, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts, (start, stop), of at most _GROUP texts and, but for single ones, _CHARS."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= _GROUP or held + len(t) > _CHARS):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def bundle(texts: list[str]) -> np.ndarray:
    """One row per text: the sum of its n-gram vectors. An n-gram's vector binds (multiplies) its
    letters' vectors, each permuted (rolled) by its place."""
    return _bundle(texts)[0]


def _bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """bundle(), and how many n-grams each text has. Sums are whole numbers, so a text's bundle
    doesn't depend on those beside it."""
    found = [grams(t) for t in texts]
    every, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    counts = np.concatenate([c for _, c in found])
    rows = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
    order = np.argsort(at, kind="stable")
    at, counts, rows = at[order], counts[order], rows[order]
    out = np.zeros((len(texts), DIM))
    for start in range(0, len(every), _GRAMS):
        part = every[start : start + _GRAMS]
        vectors = np.ones((len(part), DIM), np.int8)
        for k in range(GRAM):
            codes, place = np.unique(part >> 21 * (GRAM - 1 - k) & 0x1FFFFF, return_inverse=True)
            table = np.stack([np.roll(letter(int(c)), GRAM - 1 - k) for c in codes])
            vectors *= table[place]
        a, b = np.searchsorted(at, [start, start + len(part)])
        some = np.zeros((len(texts), len(part)), np.float32)
        some[rows[a:b], at[a:b] - start] = counts[a:b]
        out += some @ vectors.astype(np.float32)
    return out, np.array([c.sum() for _, c in found], np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _drawn(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: int) -> DataFrame:
    """(lang, text) of the rows that are learned from."""
    spark = df.sparkSession
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("_id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") > learn)
    often = sizes.limit(_LABELS + 1).collect()
    if len(often) <= _LABELS:
        sizes = F.broadcast(spark.createDataFrame([(r["lang"], r["n"]) for r in often], "lang string, n long"))
    rate = F.lit(learn) / F.coalesce("n", F.lit(learn)) * (1 << 20)
    drawn = F.pmod(F.xxhash64("_id", "text", F.lit("learn")), F.lit(1 << 20)) < rate
    return rows.join(sizes, "lang", "left").filter(drawn).select("lang", "text")


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    learn: int = LEARN,
) -> dict[str, np.ndarray]:
    """Prototypes: for each language, the sum of its documents' bundles, each of length one.

    Learns every label, from at most about `learn` rows of each, drawn by a hash of id and text;
    counts of all rows set the rates. Null texts and langs are left out, so are texts without a letter.
    Repeated rows are drawn together and count again; null ids are drawn by their texts. An empty
    table gives no prototypes; other columns are ignored. Sums don't depend on partitions."""
    rows = _drawn(df, id_col, text_col, lang_col, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, every = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), object)
            for a, b in groups(texts):
                units = np.rint(_unit(bundle(texts[a:b])) * _UNIT).astype(np.int64)
                langs = every[a:b]
                for lang in set(langs):
                    total = units[langs == lang].sum(axis=0)
                    sums[lang] = sums.get(lang, 0) + total
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                ["lang", "v"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in table["v"].to_pylist())
        return pa.table(
            {"lang": table["lang"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())}
        )

    schema = "lang string, v binary"
    sums = rows.mapInArrow(lean(run), schema).groupBy("lang").applyInArrow(add, schema).collect()
    found = {r["lang"]: np.frombuffer(r["v"], np.int64) for r in sorted(sums)}
    return {lang: _unit(v) for lang, v in found.items() if v.any()}


def spreads(
    df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", learn: int = LEARN,
) -> dict[str, tuple[float, float]]:
    """How well a language's own documents fit it: the mean product of an n-gram with the prototype,
    and the deviation of a document's from that, times the root of its number of n-grams. Neither
    depends on the other languages. From the documents that fit() learns from; the deviation is
    infinite for languages with fewer than FEW of them, and no less than the mean."""

    none = np.zeros(DIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, means, sizes = [], [], []
            texts, every = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in groups(texts):
                sums, n = _bundle(texts[a:b])
                own = every[a:b]
                dots = np.einsum("ij,ij->i", sums, np.stack([prototypes.get(lang, none) for lang in own]))
                langs += own
                means += (dots / np.maximum(n, 1)).tolist()
                sizes += n.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(means, pa.float64()), pa.array(sizes, pa.float64())],
                ["lang", "mean", "n"],
            )

    rows = _drawn(df, id_col, text_col, lang_col, learn).mapInArrow(lean(run), "lang string, mean double, n double")
    own = rows.filter("n > 0").groupBy("lang").agg(
        F.avg("mean").alias("m"), F.avg(F.col("n") * F.col("mean") * F.col("mean")).alias("a"),
        F.avg(F.col("n") * F.col("mean")).alias("b"), F.avg("n").alias("n"), F.count("*").alias("docs"),
    )
    found = dict.fromkeys(prototypes, (0.0, np.inf))
    for r in own.collect():  # a row per label
        if r["lang"] not in found:
            continue
        square = r["a"] - 2 * r["m"] * r["b"] + r["m"] ** 2 * r["n"]
        dev = max(r["m"], float(np.sqrt(max(0.0, square)))) if r["docs"] >= FEW else np.inf
        found[r["lang"]] = (r["m"], dev)
    return found


def predict(
    df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
    keep: list[Column] | None = None, spread: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """(id, kept columns, lang_pred, score) by the largest cosine of a text with the prototypes.

    score: the share of the language in a softmax of the cosines, from 0 to 1. A text that is null
    or has no letter, and any text if nothing was learned: 'und' and score 0. Ties go to the first
    language by name. Repeated rows and null ids pass as they are; an empty table gives no rows.
    With `spread` there are two columns more, null for 'und'. fit: by how many deviations the text
    fits its language better (or, below zero, worse) than the language's own documents of its
    length. level: how well it fits, as a part of their mean."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), *(keep or []), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, fits, levels = [], [], [], []
            every = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in groups(every):
                texts = every[a:b]
                sums, n = _bundle(texts)
                x = _unit(sums)
                if not names:
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    fits += [None] * len(texts)
                    levels += [None] * len(texts)
                    continue
                cosine = x @ matrix.T
                share = np.exp((cosine - cosine.max(axis=1, keepdims=True)) / TEMPERATURE)
                share /= share.sum(axis=1, keepdims=True)
                best = cosine.argmax(axis=1)
                known = x.any(axis=1)
                langs += [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores += np.where(known, share[np.arange(len(best)), best], 0.0).tolist()
                if spread is not None:
                    dots = np.einsum("ij,ij->i", sums, matrix[best]) / np.maximum(n, 1)
                    mean, dev = np.array([spread[k] for k in names]).T[:, best]
                    z = (dots - mean) * np.sqrt(n) / dev
                    part = np.divide(dots, mean, out=np.ones_like(dots), where=mean > 0)
                    fits += [f if k else None for f, k in zip(z.tolist(), known)]
                    levels += [f if k else None for f, k in zip(part.tolist(), known)]
            more = [] if spread is None else [pa.array(fits, pa.float64()), pa.array(levels, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more],
                [*batch.schema.names[:-1], "lang_pred", "score", *(["fit", "level"] if more else [])],
            )

    extra = "" if spread is None else ", fit double, level double"
    return rows.mapInArrow(lean(run), f"{schema}, lang_pred string, score double{extra}")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are not learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = fit(docs.filter(~held_out()))
    return predict(docs, prototypes, keep=[held_out().alias("held_out")])
