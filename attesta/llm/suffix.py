"""Removal of byte strings that stand earlier in the corpus, by merged Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import first_places
from .common import lean, materialize, order_id, release, size_estimate, sorted_groups

SPAN = 100
#: An anchor is the least of the hashes of the GRAM-byte strings of a SPAN-byte window.
GRAM = 24
_WINDOWS = SPAN - GRAM + 1
_CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of segments whose transforms are merged at once (their blocks then number below 2**16),
#: and input bytes per bucket of anchors.
TILE, BUCKET = 48_000, 4 << 20
#: Different segments of one anchor above which its windows are dealt one by one, by their bytes.
HOT = 20_000


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts all SPAN-byte windows of texts laid one after another into segments: maximal runs of
    windows with the same anchor. Equal windows have equal anchors wherever they stand.

    Returns for each segment: anchor's hash, hash of its bytes, text number, start in the text,
    number of windows."""
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    last = begins + lengths - SPAN  # the last window of each text, before its start if none
    out = []
    for c in range(0, len(data) - SPAN + 1, _CHUNK):
        s = data[c : c + _CHUNK + SPAN - 1]
        h = {1: _TABLE[s]}
        for k in (1, 2, 4, 8, 16, 32):
            h[2 * k] = h[k][:-k] * _power(k) + h[k][k:]
        n = len(s) - GRAM + 1
        grams = _mix(h[16][:n] * _power(8) + h[8][16 : 16 + n])
        least = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
        k = 1
        while 2 * k <= _WINDOWS:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        n = len(s) - SPAN + 1
        anchor = np.minimum(least[:n], least[_WINDOWS - k : _WINDOWS - k + n]) & _PLACE
        anchor = anchor.astype(np.int64)
        # windows that reach into the next text are none
        a, b = np.searchsorted(begins, [c, c + n - 1], side="right") - 1
        inner = np.maximum(begins[a : b + 1] - c, 0)
        text = np.repeat(np.arange(a, b + 1), np.diff(np.append(inner, n)))
        whole = np.arange(n) + c <= last[text]
        change = np.flatnonzero(
            np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])])
        )
        count = np.diff(np.append(change, n))
        keep = whole[change]
        at, count = change[keep], count[keep]
        size = count + SPAN - 1
        content = _mix(h[64][at]) * np.uint64(3) + _mix(h[64][at + (size - 64) // 2] + np.uint64(1))
        content = _mix(content * np.uint64(5) + h[64][at + size - 64] + size.astype(np.uint64))
        own = text[at]
        out.append((grams[anchor[at]], content, own, at + c - begins[own], count))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*out)))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes apart, so that small numbers compress."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return b"".join(planes)


def _unpack(data: list[bytes], *kinds) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    found: list[list] = [[] for _ in kinds]
    for d in data:
        n, at = len(d) // width, 0
        for k, own in zip(kinds, found):
            size = np.dtype(k).itemsize
            plane = np.frombuffer(d, np.uint8, n * size, at).reshape(size, n)
            own.append(np.ascontiguousarray(plane.T).reshape(-1).view(k))
            at += n * size
    return [np.concatenate(x) for x in found]


_ANCHORS = ("<u8", "<u8", "<i8", "<i8", "<u4", "u1")
_RUNS = ("<i8", "<i8", "<u4", "<u4")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the length of each entry (null: 0)."""
    values = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.fromiter(map(len, values), np.int64, len(values))


def _document(id_col: str, text_col: str) -> tuple:
    """What a document goes by: its id (those without one after all others), then a hash of its
    text, so that rows of one id and different texts are documents of their own."""
    return order_id(id_col).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("sub")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, sub, starts, stops) of the bytes of each document that a SPAN-byte string covers which
    also starts earlier: in a document that comes before, or before it in the same one. Spans may
    overlap and come in no order; documents without any are absent. key, sub: see _document(); rows
    that agree in both are one document.

    1. Every window of SPAN bytes belongs to its anchor's segment. Tasks send (anchor, hash of the
       segment, place), packed, once per distinct segment and batch; further copies of it are
       covered. Buckets of anchors drop those that stand once; of equal segments all but the first
       are covered; where one anchor has different segments, the first of each is asked for.
    2. Asked segments are cut from the texts and go to their anchor's bucket, which builds the
       transforms of shards (runs of documents), merges them by interleave refinement and finds the
       intervals whose suffixes share SPAN bytes; all but the first place of one are covered.

    Copies of any number cost one segment per batch, and anchors are spread by hash. An anchor with
    more than HOT different segments (the edges of a passage that very many texts share) has its
    windows dealt one by one, by the hash of their bytes. Memory of a task: one Arrow batch, one
    bucket (BUCKET bytes of input) or HOT segments."""
    keyed = df.select(*_document(id_col, text_col), F.col(text_col).cast("string").alias("t"))
    buckets = max(8, min(1 << 20, size_estimate(df.select(text_col)) // BUCKET))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, lengths = _bytes_of(batch.column(2))
            gram, content, text, start, count = segments(data, lengths)
            if not len(gram):
                continue
            sent, first, again = _copies(gram, content, keys[text], subs[text], start, count)
            rows: list[tuple[int, int, bytes]] = []
            if again.any():
                _, _, k, u, s, n = (x[again] for x in sent)
                place = (_mix((k ^ u).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(place, kind="stable")
                k, u, s, e = k[by], u[by], s[by].astype("<u4"), (s + n + SPAN - 1)[by].astype("<u4")
                for b, i, j in _slices(place[by]):
                    rows.append((b, 1, _pack(k[i:j], u[i:j], s[i:j], e[i:j])))
            sent = [x[first] for x in sent]
            place = (sent[0] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(place, kind="stable")
            sent = [x[by].astype(kind) for x, kind in zip(sent, _ANCHORS)]
            for b, i, j in _slices(place[by]):
                rows.append((b, 0, _pack(*(x[i:j] for x in sent))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.binary())],
                ["bucket", "kind", "data"],
            )

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "bucket"):
            kind = rows["kind"].to_numpy()
            known = rows.filter(pa.array(kind == 1))["data"].to_pylist()
            if known:
                key, sub, start, end = _unpack(known, *_RUNS)
                yield _told(key, sub, start, end, np.zeros(len(key), np.uint64))
            sent = rows.filter(pa.array(kind == 0))["data"].to_pylist()
            if not sent:
                continue
            own = _unpack(sent, *_ANCHORS)
            order = np.argsort(own[0], kind="stable")
            g = own[0][order]
            same = np.concatenate([[False], g[1:] == g[:-1]])
            order = order[same | np.append(same[1:], False)]  # anchors that stand more than once
            (gram, _, key, sub, start, count), first, again = _copies(*(x[order] for x in own))
            end = start.astype(np.int64) + count + SPAN - 1
            if again.any():
                yield _told(key[again], sub[again], start[again], end[again], np.zeros(int(again.sum()), np.uint64))
            gram, key, sub, start, end = (x[first] for x in (gram, key, sub, start, end))
            same = np.concatenate([[False], gram[1:] == gram[:-1]]) if len(gram) else np.empty(0, bool)
            many = same | np.append(same[1:], False) if len(gram) else same
            if many.any():
                heads = np.flatnonzero(_heads(gram))
                size = np.diff(np.append(heads, len(gram)))
                hot = np.repeat(size > HOT, size)[many]
                yield _told(key[many], sub[many], start[many], end[many], gram[many], True, hot)

    found = materialize(
        keyed.mapInArrow(lean(cut), "bucket long, kind int, data binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(sift), "key long, sub long, start long, stop long, gram long, asked boolean, hot boolean"),
        "segments",
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own: list[tuple] = []
            parts: list[bytes] = []
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for key, sub, text, asked in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3)
            ):
                values = asked.values
                starts, stops, grams = (values.field(i).to_numpy() for i in range(3))
                hot = values.field(3).to_numpy(zero_copy_only=False)
                if hot.any():
                    # windows as segments of their own, each under the hash of its bytes
                    each = [np.arange(a, b - SPAN + 1) for a, b in zip(starts[hot], stops[hot])]
                    single = np.concatenate(each)
                    named = [xxhash.xxh64_intdigest(text[a : a + SPAN]) for a in single.tolist()]
                    starts = np.concatenate([starts[~hot], single])
                    stops = np.concatenate([stops[~hot], single + SPAN])
                    grams = np.concatenate([grams[~hot], np.array(named, np.uint64).view(np.int64)])
                parts += [text[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
                named = (np.full(len(grams), x, np.int64) for x in (key, sub))
                own.append((grams, *named, starts, stops - starts))
            gram, key, sub, start, size = map(np.concatenate, zip(*own))
            gram = gram.view(np.uint64)
            place = (gram % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(place, kind="stable")
            rows = [
                (b, _pack(gram[o], key[o], sub[o], start[o].astype("<u4"), size[o].astype("u1")),
                 b"".join([parts[x] for x in o.tolist()]))
                for b, i, j in _slices(place[by]) for o in [by[i:j]]
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())],
                ["bucket", "data", "text"],
            )

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "bucket"):
            gram, key, sub, start, size = _unpack(rows["data"].to_pylist(), "<u8", "<i8", "<i8", "<u4", "u1")
            text = np.frombuffer(b"".join(rows["text"].to_pylist()), np.uint8)
            size = size.astype(np.int64)
            begin = np.cumsum(size) - size
            order = np.argsort(gram, kind="stable")
            ends = np.append(np.flatnonzero(_heads(gram[order])[1:]) + 1, len(order))
            total = np.cumsum(size[order])
            at = 0
            while at < len(order):
                # anchors that together stay within a tile, or one that doesn't
                limit = (total[at - 1] if at else 0) + TILE
                fit = ends[(ends > at) & (total[ends - 1] <= limit)] if len(ends) < 64 else _fitting(ends, total, at, limit)
                to = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, at, side="right")])
                own = order[at:to]
                own = own[np.lexsort((start[own], sub[own], key[own]))]
                at = to
                lens = size[own]
                shift = np.cumsum(lens) - lens
                blob = text[np.arange(lens.sum()) + np.repeat(begin[own] - shift, lens)]
                first, counts = first_places(blob, lens, SPAN)
                who = np.repeat(np.arange(len(own)), counts)
                offset = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
                k, u = key[own][who], sub[own][who]
                place = start[own].astype(np.int64)[who] + offset
                # a place that a repeated row gives twice isn't before itself
                later = (k != k[first]) | (u != u[first]) | (place != place[first])
                edge = np.empty(len(who) + 1, bool)
                edge[0] = edge[-1] = True
                edge[1:-1] = (who[1:] != who[:-1]) | (later[1:] != later[:-1])
                runs = np.flatnonzero(edge)
                a, b = runs[:-1], runs[1:] - 1
                a, b = a[later[a]], b[later[a]]
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[a]), pa.array(u[a]), pa.array(place[a]), pa.array(place[b] + SPAN)],
                        ["key", "sub", "start", "stop"],
                    )

    asked = (
        found.filter("asked").groupBy("key", "sub")
        .agg(F.collect_list(F.struct("start", "stop", "gram", "hot")).alias("asked"))
    )
    merged = materialize(
        keyed.join(asked.hint("shuffle_hash"), ["key", "sub"])
        .mapInArrow(lean(fetch), "bucket long, data binary, text binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(transform), "key long, sub long, start long, stop long"),
        "merged",
    )
    spans = materialize(
        found.filter("not asked").select("key", "sub", "start", "stop").unionByName(merged)
        .groupBy("key", "sub").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")),
        "spans",
    )
    release(found)
    release(merged)
    return spans


def _copies(gram, content, key, sub, start, count) -> tuple[list, np.ndarray, np.ndarray]:
    """Segments in the order of anchor, bytes and place; which are the first of their bytes; and
    which are further copies, all of whose bytes stand earlier (not a place given twice)."""
    order = np.lexsort((start, sub, key, content, gram))
    own = [x[order] for x in (gram, content, key, sub, start, count)]
    first = _heads(own[0], own[1])
    origin = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.empty(0, int)
    again = ~first & ((own[2] != own[2][origin]) | (own[3] != own[3][origin]) | (own[4] != own[4][origin]))
    return own, first, again


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether an entry of sorted columns differs from the one before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _slices(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.flatnonzero(_heads(sorted_))
    for i, j in zip(starts.tolist(), np.append(starts[1:], len(sorted_)).tolist()):
        yield int(sorted_[i]), i, j


def _fitting(ends: np.ndarray, total: np.ndarray, at: int, limit: int) -> np.ndarray:
    lo = np.searchsorted(ends, at, side="right")
    hi = np.searchsorted(total[ends - 1], limit, side="right")
    return ends[lo:hi]


def _told(key, sub, start, stop, gram, asked: bool = False, hot: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key), pa.array(sub), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64)),
            pa.array(gram.view(np.int64)), pa.array(np.full(len(key), asked)),
            pa.array(np.zeros(len(key), bool) if hot is None else hot),
        ],
        ["key", "sub", "start", "stop", "gram", "asked", "hot"],
    )


def merged_spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[new], stops[np.append(np.flatnonzero(new)[1:] - 1, len(stops) - 1)]


def without(text: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """The text without spans that are sorted and apart."""
    a = np.append(0, stops).tolist()
    b = np.append(starts, len(text)).tolist()
    return b"".join([text[x:y] for x, y in zip(a, b)])


def _with_spans(df: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with _starts and _stops. The hash side is the small one; texts are not sorted."""
    keyed = df.select("*", *(c.alias(n) for c, n in zip(_document(id_col, text_col), ("_key", "_sub"))))
    named = spans.toDF("_key", "_sub", "_starts", "_stops")
    return keyed.join(named.hint("shuffle_hash"), ["_key", "_sub"], "left").drop("_key", "_sub")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document without its repeats.

    Null text: no bytes. Null ids: after all others. Rows of one id and different texts are
    documents in an order that their texts give. Rows that share id and text, and so rows of one text
    without an id, are one document: neither is before the other, both get what it gets. Texts below
    SPAN bytes keep everything. An empty table gives no rows; other columns are
    ignored."""
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    joined = _with_spans(rows, repeated_spans(df, id_col, text_col), id_col, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for text, starts, stops in zip(texts, batch.column(2), batch.column(3)):
                text, removed, n = text or b"", 0, 0
                size = len(text)
                if starts.is_valid:
                    a, b = merged_spans(starts.values.to_numpy(), stops.values.to_numpy())
                    removed, n = int((b - a).sum()), len(a)
                    text = without(text, a, b)
                for c, v in zip(cols, (size, removed, n, hashlib.sha256(text).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select(id_col, "t", "_starts", "_stops").mapInArrow(lean(run), schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts less the repeats. A character goes if all of its bytes are covered; one
    covered in part stays, so texts remain valid. Nulls and rows as in digests(); null stays null.
    Other columns pass as they are."""
    rows = df.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
        F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("_row"),
    )
    joined = _with_spans(rows, repeated_spans(df, id_col, text_col), "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = []
            for text, starts, stops in zip(texts, batch.column(2), batch.column(3)):
                if text and starts.is_valid:
                    a, b = merged_spans(starts.values.to_numpy(), stops.values.to_numpy())
                    inner = (np.frombuffer(text + b"a", np.uint8) & 0xC0) == 0x80
                    for _ in range(3):
                        a = np.where(inner[a], a + 1, a)
                        b = np.where(inner[b], b - 1, b)
                    keep = a < b
                    text = without(text, a[keep], b[keep])
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["_row", "_text"]
            )

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _text string"
    done = joined.select("_row", "_text", "_starts", "_stops").mapInArrow(lean(run), schema)
    return done.select(
        *(F.col("_text" if c == text_col else f"_row.`{c}`").alias(c) for c in df.columns)
    )


def op1_merged_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
