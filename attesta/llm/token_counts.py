"""Token counts that follow edits: a segment tree of pre-tokens per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBPE, load

#: Pre-tokens of a leaf; a leaf that edits let grow to GROWN times that has the tree built anew.
LEAF, GROWN = 64, 8
#: Characters after a pre-token that its end can depend on: the longest special token, or the
#: pattern's own look ahead.
_AHEAD = 16

EDIT = "array<struct<start:int,stop:int,text:string>>"


class TokenTree:
    """A document's pre-tokens in leaves, under a binary tree of the leaves' sums of characters and
    tokens."""

    def __init__(self, text: str, bpe: ByteBPE):
        self.text, self._bpe = text, bpe
        self.reencoded = 0
        pieces = self._all(text)
        lengths = np.array(list(map(len, pieces)), np.int64)
        counts = list(map(self._count, pieces)) if "<" in text else bpe.counts(pieces)
        self._plant(lengths, np.asarray(counts, np.int64))

    def _all(self, text: str) -> list[str]:
        if "<" not in text:
            return self._bpe._pieces.findall(text)
        return [p for p, _ in self._scan(0)]

    def _scan(self, at: int) -> Iterator[tuple[str, int]]:
        """(pre-token, end) from a border on. Special tokens are pre-tokens of their own."""
        bpe, text = self._bpe, self.text
        while at < len(text):
            special = bpe._split.search(text, at) if bpe._split else None
            until = special.start() if special else len(text)
            for m in bpe._pieces.finditer(text, at, until):
                yield m[0], m.end()
            at = until
            if special:
                yield special[0], special.end()
                at = special.end()

    def _count(self, piece: str) -> int:
        return 1 if piece in self._bpe.special else self._bpe.count(piece)

    def _plant(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        cuts = range(0, len(lengths), LEAF)
        self._leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in cuts] or [(lengths, counts)]
        self._size = 1 << max(0, len(self._leaves) - 1).bit_length()
        self._sums = np.zeros((2 * self._size, 2), np.int64)
        if len(lengths):
            leaf = np.arange(0, len(lengths), LEAF)
            own = self._sums[self._size : self._size + len(leaf)]
            own[:, 0], own[:, 1] = np.add.reduceat(lengths, leaf), np.add.reduceat(counts, leaf)
        level = self._size
        while level > 1:
            half = level // 2
            self._sums[half:level] = self._sums[level : 2 * level : 2] + self._sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def tokens(self) -> int:
        return int(self._sums[1, 1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts. Down the tree by sums."""
        node, start = 1, 0
        while node < self._size:
            node *= 2
            left = int(self._sums[node, 0])
            if place - start >= left:
                node, start = node + 1, start + left
        return min(node - self._size, len(self._leaves) - 1), start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters from start to stop (cut to the text's length)."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        shift = len(new) - (stop - start)
        old_size = len(self.text)
        self.text = self.text[:start] + new + self.text[stop:]
        # pre-tokens that end well before the edit stay; so do those after the first border that
        # old and new text share behind it, as matching only looks forward
        first, at = self._leaf_at(max(0, start - _AHEAD))
        borders = at + np.cumsum(self._leaves[first][0])
        keep = int(np.searchsorted(borders, start - _AHEAD, side="right"))
        begin = int(borders[keep - 1]) if keep else at
        last, base = self._leaf_at(min(stop, max(0, old_size - 1)))
        ends = base + np.cumsum(self._leaves[last][0])
        made_lengths, made_counts, put = [], [], -1
        for piece, end in self._scan(begin):
            made_lengths.append(len(piece))
            made_counts.append(self._count(piece))
            old = end - shift
            if old < stop:
                continue
            while last + 1 < len(self._leaves) and (not len(ends) or old > ends[-1]):
                base = int(ends[-1]) if len(ends) else base
                last += 1
                ends = base + np.cumsum(self._leaves[last][0])
            where = int(np.searchsorted(ends, old))
            if old == base:
                put = 0
                break
            if where < len(ends) and ends[where] == old:
                put = where + 1
                break
        self.reencoded += sum(made_lengths)
        if put < 0:
            last, put = len(self._leaves) - 1, len(self._leaves[-1][0])
        made = (np.array(made_lengths, np.int64), np.array(made_counts, np.int64))
        head, tail = self._leaves[first], self._leaves[last]
        joined = tuple(np.concatenate([h[:keep], m, t[put:]]) for h, m, t in zip(head, made, tail))
        for i in range(first, last + 1):
            own = joined if i == first else (joined[0][:0], joined[1][:0])
            self._leaves[i] = own
            self._sums[self._size + i] = own[0].sum(), own[1].sum()
        for node in {(self._size + i) // 2 for i in range(first, last + 1)}:
            while node:
                self._sums[node] = self._sums[2 * node] + self._sums[2 * node + 1]
                node //= 2
        if len(joined[0]) > GROWN * LEAF:
            every = tuple(np.concatenate(c) for c in zip(*self._leaves))
            self._plant(*every)


def edited_counts(
    df: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, n_reencoded) of each document.

    edits: an array of (start, stop, text), applied in order, each to what those before have left;
    places are characters, cut to the text's length. n_reencoded counts the characters that edits
    had encoded again. Null text: the empty text. Null edits, or nulls in one, change nothing. Repeated rows and null ids
    pass as they are; an empty table gives no rows; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(5)]
            for text, changes in zip(batch.column(1), batch.column(2)):
                tree = TokenTree(text.as_py() or "", bpe)
                before, n = tree.tokens, 0
                for e in changes.as_py() or []:
                    if e and e["start"] is not None and e["stop"] is not None and e["text"] is not None:
                        tree.edit(e["start"], e["stop"], e["text"])
                        n += 1
                for c, v in zip(cols, (before, n, tree.tokens, len(tree.text), tree.reencoded)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols)],
                [id_col, "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_reencoded"],
            )

    schema = (
        f"{id_col} long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, "
        "n_reencoded long"
    )
    rows = df.select(
        F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"),
        edits.cast(EDIT).alias("e"),
    )
    return rows.mapInArrow(run, schema)


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits of each document, which its id and length give: some words put in, seven
    characters taken out, two replaced."""
    size = F.char_length(F.coalesce(F.col(text_col), F.lit("")))

    def at(k: int) -> Column:
        place = F.crc32(F.concat_ws(":", F.lit(str(k)), F.col(id_col).cast("string")))
        return F.pmod(place, size + 1).cast("int")

    def edit(k: int, length: int, new: str) -> Column:
        return F.struct(
            at(k).alias("start"), (at(k) + length).cast("int").alias("stop"), F.lit(new).alias("text")
        )

    return F.array(edit(0, 0, " and some words, too"), edit(1, 7, ""), edit(2, 2, "'re 42\n"))


def op5_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), sample_edits())
