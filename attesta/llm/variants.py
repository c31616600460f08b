"""Spelling variants: words that are one code point apart, grouped under their commoner forms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, release, slices

#: One occurrence in NOISE, told by its hash, loses a code point.
NOISE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: Characters of a text read in one step; distinct words, and characters of them, that a task adds up
#: before it passes them on.
_STEP, _HELD, _CHARS = 1 << 20, 200_000, 1 << 23
_RUN, _GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def runs(text: bytes) -> Counter:
    """Maximal runs of letters with their counts; A-Z are lower-cased, other letters stay. Long texts
    are read in steps that end between runs."""
    whole = text.lower().decode("utf-8", "replace")  # bytes.lower() changes A-Z alone
    found: Counter = Counter()
    at = 0
    while at < len(whole):
        gap = _GAP.search(whole, at + _STEP) if len(whole) - at > _STEP else None
        end = gap.start() if gap else len(whole)
        found.update(_RUN.findall(whole, at, end))
        at = end
    return found


def noisy(name: str, found: Counter, noise: int = NOISE, least: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """Words of a document: runs of which some, by the hash of the document's id and the run, have
    lost a code point."""
    start = crc32(f"{name}:".encode())
    for run, n in found.items():
        if len(run) < least:
            continue
        h = crc32(run.encode(), start)
        if h % noise == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n) over whole texts. Each task adds up its words before they are shuffled. Null texts
    have no words; a null id is an empty one in the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary())
            for name, text in zip(batch.column(0).to_pylist(), texts):
                if not text.is_valid:
                    continue
                for word, n in noisy(name or "", runs(text.as_py()), least=least_length):
                    if word in counts:
                        counts[word] += n
                    else:
                        counts[word] = n
                        held += len(word)
                if len(counts) >= _HELD or held >= _CHARS:
                    yield rows()
                    counts.clear()
                    held = 0
        if counts:
            yield rows()

    two = df.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    words = two.mapInArrow(lean(run), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, key, lo, hi) for each word itself and each distinct string that is left when
    one of its code points goes. A key is the hash of the string, made from sums over the word's
    beginning and end, so a word of n letters costs n steps. lo to hi are the places whose deletion
    leaves that string: those of a run of one letter. The word itself has all places."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[of]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _BASE, np.uint64))
        terms = _mixed(codes + np.uint64(1)) * powers[place]
        before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        left = before[:-1] - before[starts[of]]
        right = (before[ends[of]] - before[1:]) * _BACK
        cut = _mixed(left + right + (sizes[of] - 1).astype(np.uint64))
        whole = _mixed(before[ends] - before[starts] + sizes.astype(np.uint64))
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(codes))[: len(lo)] - 1
    n = len(words)
    return (
        np.concatenate([np.arange(n), of[lo]]),
        np.concatenate([whole, cut[lo]]).view(np.int64),
        np.concatenate([np.zeros(n, np.int64), place[lo]]),
        np.concatenate([np.full(n, np.iinfo(np.int32).max, np.int64), place[hi]]),
    )


def _keys(words: DataFrame) -> DataFrame:
    """(key, wid, lo, hi): see deletions()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            of, key, lo, hi = deletions(batch.column(0).to_pylist())
            wid = np.asarray(batch.column(1))[of]
            for at in range(0, len(of), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[s]), pa.array(wid[s]), pa.array(lo[s].astype(np.int32)), pa.array(hi[s].astype(np.int32))],
                    ["key", "wid", "lo", "hi"],
                )

    return words.select("word", "wid").mapInArrow(lean(run), "key long, wid long, lo int, hi int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all words(word, n, wid) one inserted, deleted or replaced code
    point apart, in both directions.

    Words meet on equal keys, at exactly one for two words that are near: the shorter word, or what
    both leave when the replaced letter goes. Two words of one key that leave it at different places
    are further apart and don't pass; strings are then compared exactly. Key rows are four numbers,
    so long words aren't copied for each of their letters. A key is shared by at most as many words
    as there are ways to put one letter into it, whatever the size of the corpus."""
    keys = materialize(_keys(words), "keys")
    a, b = keys.alias("a"), keys.alias("b")
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.wid") < F.col("b.wid"))
        & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    )
    pairs = a.join(b, meet).select(F.col("a.wid").alias("x"), F.col("b.wid").alias("y"))
    one = words.select(F.col("wid").alias("x"), "word", "n")
    two = words.select(F.col("wid").alias("y"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = materialize(
        pairs.join(one, "x").join(two, "y").filter(F.levenshtein("word", "other", 1) == 1)
        .select("word", "n", "other", "other_n"),
        "near",
    )
    release(keys)
    return near.unionByName(
        near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) for links(word, form): the end of the word's chain of forms. Each round doubles
    the length of the way that a link covers; chains are short, as counts at least double along them."""
    at = materialize(links.select("word", F.col("form").alias("root")), "links")
    for _ in range(rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = at.join(on, "root", "left")
        done = materialize(
            step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "links"
        )
        release(at)
        at = done
        if not at.filter("moved").limit(1).count():
            return at.select("word", "root")
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of the corpus; see op12.

    Null, empty and letterless texts give no words, null ids hash as empty ones, repeated rows count
    again, an empty table gives no rows; other columns are ignored. Equal counts: the form is the
    first word in code-point order."""
    counted = word_counts(df, id_col, text_col, least_length, least_count)
    words = materialize(counted.select("word", "n", F.xxhash64("word").alias("wid")), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    formed = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_delete_join_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of documents, see spelling_variants()."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC_TABLE = "SELECT i, i AS c FROM range(256) t(i)"
for _ in range(8):
    _CRC_TABLE = f"SELECT i, {_CRC_STEP} AS c FROM ({_CRC_TABLE})"

ORACLE_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({_CRC_TABLE})),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM
  (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
    lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [192 + (ord(ch) >> 6), 128 + (ord(ch) & 63)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM own, crc WHERE length(run) >= {LEAST_LENGTH}),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0
    THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= {LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM
  (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS MATERIALIZED (SELECT v.word, v.n, o.word AS other, o.n AS other_n, count(o.word) OVER (PARTITION BY v.word) AS n_near
  FROM words v LEFT JOIN near r ON r.word = v.word LEFT JOIN words o ON o.word = r.other
  QUALIFY row_number() OVER (PARTITION BY v.word ORDER BY o.n DESC NULLS LAST, o.word) = 1),
formed AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form,
  CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM best),
chain AS (SELECT word, coalesce(form, word) AS root FROM formed
  UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word)
  JOIN formed e ON e.word = c.root WHERE e.form IS NULL"""
