"""Packing token sequences by multiway number differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

CAPACITY = 2048
END = 1
#: Windows that are filled together; a task holds the tokens of so many.
WINDOWS = 256
#: Items below a window's size over BUNDLE are put together, in order, until they reach it; a window's
#: worth of pieces that an answer holds at once.
BUNDLE, SHOWN = 32, 16
#: Distinct words, with what stands next to them, that a worker remembers; longer ones are not.
PIECES, LONG = 400_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Pre-tokens of lower-case Latin-1 text: the contractions and classes of the file's own pattern.
_LETTER, _DIGIT, _GAP = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_GAP}{_LETTER}{_DIGIT}]+"
)


#: White space that parts words for str.split() and not for the file's pattern.
_ODD = re.compile("[\x1c-\x1f]")


class WordTokenizer:
    """Ids of a tokenizers file that lower-cases and splits text into words, single digits and runs
    of other characters, and drops the white space between them. Of Latin-1 text, each distinct run
    between white space is encoded once, by the library; other text, or text with special tokens, as
    a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._hf = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        names = self._hf.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(names.values()) + 1, bool)
        self._ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _words(self, text: str) -> list[str] | None:
        if "<|" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = text.lower()
        return None if _ODD.search(text) else text.split()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._hf.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded as one text: each ends with the token that ends a word."""
        ids = np.array(self._hf.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(pieces) or (len(ids) and ends[-1] != len(ids)):
            return self._encode(pieces)
        data, at = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *at[:-1]], at)]

    def _learn(self, new: set[str]) -> list[str]:
        """Adds words by their pre-tokens, and returns all that were added."""
        known = self._known
        split = {w: _PIECES.findall(w) for w in new if not w.isalpha()}
        unknown = [w for w in new if w not in split]
        unknown += {p for own in split.values() for p in own}.difference(known, unknown)
        for at in range(0, len(unknown), 8192):
            part = unknown[at : at + 8192]
            known.update(zip(part, self._encode_pieces(part)))
        get = known.__getitem__
        known.update([(w, b"".join(map(get, own))) for w, own in split.items() if w not in known])
        return [*split, *unknown]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, END appended."""
        known = self._known
        if len(known) > PIECES:
            known.clear()
        words = [self._words(t) for t in texts]
        added = self._learn(set().union(*(own for own in words if own)).difference(known))
        end = np.array([END], "<u4").tobytes()
        get = known.__getitem__
        nothing = np.frombuffer(end, "<u4")
        found = [
            nothing if own == [] else np.frombuffer((self._encode([t])[0] if own is None else b"".join(map(get, own))) + end, "<u4")
            for t, own in zip(texts, words)
        ]
        for w in added:
            if len(w) > LONG:
                known.pop(w, None)
        return found


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """Window of each item by multiway differencing. Every item begins as a partition with one
    filled window; the two partitions of largest spread are merged, the fullest windows of one
    with the emptiest of the other, until one is left."""
    if windows <= 1:
        return np.zeros(len(lengths), np.int64)
    if len(lengths) <= windows:
        return np.arange(len(lengths))
    slot = np.int16 if windows < 1 << 15 else np.int32

    def sums_of(entry) -> np.ndarray:
        if entry[2] is not None:
            return entry[2]
        sums = np.zeros(windows, np.int64)
        sums[0] = -entry[0]
        return sums

    heap = [(-n, i, None) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    made = len(lengths)
    children: list[tuple] = []
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        both = sums_of(one) + sums_of(two)[::-1]  # one's falls, so its fullest meets the emptiest of two
        order = np.argsort(-both, kind="stable")
        sums = both[order] - both[order[-1]]
        # slot k of the merged partition: slot order[k] of one, and that of two from the other end
        children.append((one[1], two[1], order.astype(slot)))
        heapq.heappush(heap, (-int(sums[0]), made, sums))
        made += 1
    at = np.empty(len(lengths), np.int64)
    todo = [(heap[0][1], np.arange(windows, dtype=slot))]
    while todo:
        node, names = todo.pop()
        if node < len(lengths):
            at[node] = names[0]
            continue
        one, two, order = children[node - len(lengths)]
        for n, slots in ((one, order), (two, windows - 1 - order)):
            own = np.empty(windows, slot)
            own[slots] = names
            todo.append((n, own))
    return at


def bundles(lengths: list[int], most: int) -> list[list[int]]:
    """Items in order; those below `most` together as long as their sum doesn't exceed it."""
    out: list[list[int]] = []
    room = -1
    for i, n in enumerate(lengths):
        if n >= most:
            out.append([i])
        elif n <= room:
            open_.append(i)
            room -= n
        else:
            open_, room = [i], most - n
            out.append(open_)
    return out


def balanced(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of items, none above the capacity: differencing gives near-equal windows, and
    their number rises whenever one exceeds it, by what its excess over the mean calls for. Tiny items
    are differenced in bundles, so that its memory follows the tokens, not the number of items."""
    if max(lengths, default=0) > capacity:
        raise ValueError("an item is longer than a window")
    together = bundles(lengths, max(1, capacity // BUNDLE))
    sizes = [sum(lengths[i] for i in own) for own in together]
    total = sum(sizes)
    windows = -(-total // capacity)
    while True:
        at = differencing(sizes, windows)
        sums = np.bincount(at, weights=sizes, minlength=windows) if len(sizes) else np.zeros(0)
        top = int(sums.max(initial=0))
        if top <= capacity:
            break
        room = capacity - (top - total / windows)
        windows = min(len(sizes), max(windows + 1, int(total / room) if room > 0 else 0))
    out: list[list[int]] = [[] for _ in range(windows)]
    for own, w in zip(together, at.tolist()):
        out[w] += own
    return [w for w in out if w]


def pack(
    lengths: list[int], capacity: int = CAPACITY, cut: bool = True
) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length), none above the capacity.

    cut=False keeps items whole, in balanced() windows; none may be longer than a window. cut=True:
    of an item beyond the capacity full windows come off; balanced() takes the rest. The windows by
    which their number rose are then dealt, cut where need be, to the room that is left in the
    others, so that all but the last are full."""
    if not cut:
        return [[(i, 0, lengths[i]) for i in w] for w in balanced(lengths, capacity)]
    out = []
    rest = []  # pieces (item, start, length) below the capacity
    for i, n in enumerate(lengths):
        whole = n // capacity
        out += [[(i, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            rest.append((i, whole * capacity, n % capacity))
    filled = [[rest[k] for k in w] for w in balanced([p[2] for p in rest], capacity)]
    filled.sort(key=lambda w: -sum(p[2] for p in w))
    full = sum(p[2] for p in rest) // capacity
    over = [p for w in filled[full:] for p in w]
    for w in filled[:full]:
        room = capacity - sum(p[2] for p in w)
        while room:
            i, start, n = over.pop()
            take = min(n, room)
            w.append((i, start, take))
            if n > take:
                over.append((i, start + take, n - take))
            room -= take
    return out + filled[:full] + ([over] if over else [])


def powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts a window into ones whose lengths are powers of two, which need no padding."""
    out, left = [], list(window[::-1])
    total = sum(p[2] for p in window)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                i, start, n = left.pop()
                take = min(n, room)
                own.append((i, start, take))
                if n > take:
                    left.append((i, start + take, n - take))
                room -= take
            out.append(own)
    return out


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence, with the piece's ids if asked for.

    Each task packs the documents of its partition, WINDOWS full windows at a time (see pack()); what
    is left at a partition's end is cut into sequences of a power of two each. No shuffle. sequence_id
    holds the partition's number above bit 40, so a task that runs again gives the same rows.

    Null text: the end id alone. Null ids pass as they are, repeated rows are packed again; an empty table
    gives no rows. Other columns are ignored."""
    path = path or default_path()
    extra = ", ids array<int>" if with_ids else ""
    columns = [
        id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        *["ids"] * with_ids,
    ]
    schema = (
        f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, "
        f"sequence_id long, offset long{extra}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        sequence = TaskContext.get().partitionId() << 40
        # documents, or what is left of them: name, ids, ids before these, ids in all
        open_: list[tuple] = []
        held = 0

        def emit(windows):
            for k in range(0, len(windows), SHOWN):
                yield shown(windows[k : k + SHOWN])

        def shown(windows):
            nonlocal sequence
            rows: list[list] = [[] for _ in range(8)]
            for w in windows:
                offset = 0
                for i, start, n in w:
                    name, ids, base, total = open_[i]
                    part = ids[start : start + n]
                    row = (name, base + start, n, zlib.crc32(part), total, sequence, offset, part)
                    for col, value in zip(rows, row):
                        col.append(value)
                    offset += n
                sequence += 1
            arrays = [pa.array(c, pa.int64()) for c in rows[:7]]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in rows[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, columns)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for name, ids in zip(part.column(0).to_pylist(), tokenizer.encode_all(texts)):
                    open_.append((name, ids, 0, len(ids)))
                    held += len(ids)
                if held < WINDOWS * capacity:
                    continue
                windows = pack([len(x[1]) for x in open_], capacity)
                left = windows.pop() if held % capacity else []
                yield from emit(windows)
                # what doesn't fill a window goes on into the next group
                open_ = [
                    (open_[i][0], open_[i][1][start : start + n], open_[i][2] + start, open_[i][3])
                    for i, start, n in left
                ]
                held %= capacity
        if open_:
            windows = pack([len(x[1]) for x in open_], capacity)
            if held % capacity:
                windows[-1:] = powers(windows[-1])
            yield from emit(windows)

    two = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return two.mapInArrow(lean(run), schema)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
