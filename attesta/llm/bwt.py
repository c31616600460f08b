"""Burrows-Wheeler transforms of many short strings: building, merging, repeated intervals.

Strings are circles padded to a multiple of STEP. The alphabet is that of STEP-byte blocks: the
symbol of a place is the block that begins there, and the transform gives, for each place in sorted
order, the block before it. A round of refinement therefore sorts by STEP more bytes."""

from __future__ import annotations

import numpy as np

STEP = 20
SHARDS = 4


class Strings:
    """Strings laid out one after another, padded, with the block before each place."""

    def __init__(self, blob: np.ndarray, lengths: np.ndarray):
        padded = -(-(lengths + 1) // STEP) * STEP
        self.starts = np.concatenate([[0], np.cumsum(padded)[:-1]]).astype(np.int64)
        self.size = int(padded.sum())
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = np.zeros(self.size, np.uint64)
        text[np.arange(len(blob)) + np.repeat(self.starts - begins, lengths)] = blob.astype(np.uint64) + 1
        place = np.arange(self.size, dtype=np.int64)
        first = np.repeat(self.starts, padded)
        width = np.repeat(padded, padded)
        block = np.zeros(self.size, np.uint64)
        inside = place - first
        for k in range(STEP):
            at = inside + k
            at -= np.where(at >= width, width, 0)
            block = block * np.uint64(0x9E3779B97F4A7C15 | 1) + text[first + at] * np.uint64(0xD6E8FEB86659FD93)
        _, symbol = np.unique(block, return_inverse=True)
        before = inside - STEP
        self.before = first + before + np.where(before < 0, width, 0)
        kind = np.uint16 if len(symbol) == 0 or symbol.max() < 1 << 16 else np.int64
        self.symbol = symbol.astype(kind)[self.before]


def build(strings: Strings, low: int, high: int, depth: int) -> np.ndarray:
    """The places low to high (whole strings, a shard) sorted to `depth` bytes; the shard's
    transform is strings.symbol at these. Each round deals the places by the block before them and
    steps back to it, so the order is right to one block more."""
    symbol, back = strings.symbol[low:high], strings.before[low:high] - low
    order = np.arange(high - low)
    for _ in range(-(-depth // STEP)):
        order = back[order[np.argsort(symbol[order], kind="stable")]]
    return order + low


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves shards' transforms (their symbols, in sorted order) and derives prefix lengths.

    All that changes is which shard each place of the merged order belongs to: a shard's own entries
    follow one another as its transform has them and are never sorted again, so the transforms must
    be in order. A round reads the symbols through the interleave and deals it by them, stably, after
    which it is right to one block more; a place begins a new interval when its symbol or the
    interval that it came from differs from those of the place above.

    Returns the shard of each place and how many bytes, in whole blocks and `depth` at most, the
    suffix there shares with the one above (0 for the first). Intervals of entries that share
    `depth` bytes are the repeats."""
    sizes = [len(t) for t in transforms]
    symbol = np.concatenate(transforms) if transforms else np.empty(0, np.uint16)
    n = len(symbol)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) < 256 else np.int32), sizes)
    interval = np.zeros(n, np.int64)
    rounds = -(-depth // STEP)
    common = np.full(n, rounds * STEP, np.int32)
    seen = np.empty_like(symbol)
    for k in range(rounds):
        # the entries of one shard after another, where they stand in the interleave
        seen[np.argsort(shard, kind="stable")] = symbol
        deal = np.argsort(seen, kind="stable")
        shard, s, was = shard[deal], seen[deal], interval[deal]
        new = np.ones(n, bool)
        new[1:] = (s[1:] != s[:-1]) | (was[1:] != was[:-1])
        # intervals only split, in place: the first round that parts two entries tells what they share
        common[new] = np.minimum(common[new], k * STEP)
        interval = np.cumsum(new)
    return shard, common


def merged(strings: Strings, orders: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all shards in the merged order, and what each shares with the one above."""
    shard, common = merge([strings.symbol[o] for o in orders], depth)
    places = np.empty(len(shard), np.int64)
    places[np.argsort(shard, kind="stable")] = np.concatenate(orders) if orders else []
    return places, common


def first_places(blob: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places of all strings that have `depth` bytes to their right in their string, in the
    order of the layout: the number of the place (in that order) where the same bytes stand first.
    The strings are cut into SHARDS runs of like size, whose transforms are merged. depth must be a
    multiple of STEP."""
    s = Strings(blob, lengths)
    cut = np.searchsorted(s.starts, np.linspace(0, s.size, SHARDS + 1)[1:-1])
    bounds = np.unique(np.concatenate([[0], s.starts[np.minimum(cut, len(s.starts) - 1)], [s.size]]))
    orders = [build(s, a, b, depth) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    places, common = merged(s, orders, depth)
    counts = np.maximum(0, lengths - depth + 1)
    number = np.full(s.size, -1, np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    full = np.arange(total) + np.repeat(s.starts - ends + counts, counts)
    number[full] = np.arange(total)
    got = number[places]
    group = np.cumsum(common < depth) - 1
    keep = got >= 0
    got, group = got[keep], group[keep]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, total, np.int64)
    np.minimum.at(least, group, got)
    first = np.empty(total, np.int64)
    first[got] = least[group]
    return first, counts
