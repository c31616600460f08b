"""Byte-level BPE by backtracking: longest matches, kept where adjacent tokens are compatible."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a worker remembers, with their ids or just their number.
CACHE, COUNTS = 700_000, 1_500_000
LONG = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one vocabulary file.

    A pre-token's longest match is tried at each place; where it isn't compatible with the token
    before it, the next shorter prefix that is a token is, and where none is left, the token before
    is taken back. A place found to lead nowhere is not tried again, so time is linear."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(_byte_letters())}
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        by_id = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )
        by_id |= {i: t.encode() for t, i in self.special.items()}
        n = max(by_id) + 1
        # rank: when a token is made; single bytes come first
        self._rank, self._parts, self._made = [-1] * n, [None] * n, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (vocab[bytes(letters[c] for c in x)] for x in (a, b))
            made = vocab[by_id[a] + by_id[b]]
            self._made[a, b] = (rank, made)
            if self._parts[made] is None:
                self._parts[made], self._rank[made] = (a, b), rank
        self._compatible: dict[tuple[int, int], bool] = {}
        self._find = ahocorasick.Automaton()
        own = {}
        for token in sorted(vocab.values(), key=lambda t: self._rank[t]):
            parts = self._parts[token]
            # a token that its own bytes don't encode to can't occur
            own[token] = len(by_id[token]) == 1 or (
                parts is not None and own[parts[0]] and own[parts[1]] and self._meet(*parts, token)
            )
            if own[token]:
                self._find.add_word(by_id[token].decode("latin-1"), (len(by_id[token]), token))
        self._find.make_automaton()
        self._length = [len(by_id.get(i, b"")) for i in range(n)]
        # the longest proper prefix of each token that is a token
        self._shorter: list[int] = [-1] * n
        for t, i in vocab.items():
            for k in range(len(t) - 1, 0, -1):
                j = vocab.get(t[:k], -1)
                if j >= 0 and own[j]:
                    self._shorter[i] = j
                    break
        # decoding: one blob of bytes, and where each token starts in it
        self._blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(n)), np.uint8)
        self._start = np.concatenate([[0], np.cumsum(self._length)]).astype(np.int64)
        self._pieces = regex.compile(PATTERN)
        self._cache: dict[str, tuple[str, bytes, int]] = {}
        self._counts: dict[str, int] = {}

    def _meet(self, left: int, right: int, made: int = -1) -> bool:
        """Whether the border between two tokens holds while the merges of both are made. Goes back
        in time along both spines; a merge across the border happens if it comes before the merges
        that take its parts away (of equal ones, the one to the left comes first). made: a token
        whose own merge is allowed."""
        until_left = until_right = len(self._made) + 1
        while True:
            rank, token = self._made.get((left, right), (None, None))
            if rank is not None and token != made and rank < until_left and rank <= until_right:
                return False
            a, b = self._rank[left], self._rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until_left, left = a, self._parts[left][1]
            else:
                until_right, right = b, self._parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            known = self._compatible[key] = self._meet(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        longest = [(0, -1)] * len(piece)
        for end, match in self._find.iter(piece.decode("latin-1")):
            start = end - match[0] + 1
            if match[0] > longest[start][0]:
                longest[start] = match
        dead = bytearray(len(piece) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0][1] if piece else -1
        while at < len(piece):
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + self._length[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self._shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at][1] if at < len(piece) else -1
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= self._length[token]
        return tokens

    def _entry(self, piece: str) -> tuple[str, bytes, int]:
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        found = (",".join(map(str, ids)), np.array(ids, "<u4").tobytes(), len(ids))
        if len(piece) <= LONG:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            self._cache[piece] = found
        return found

    def entries(self, text: str) -> list[tuple[str, bytes, int]]:
        """(ids as text, ids as bytes, their number) of each pre-token, in order."""
        get = self._cache.get
        if self._split is None or "<" not in text:
            return [get(p) or self._entry(p) for p in self._pieces.findall(text)]
        found = []
        for part in self._split.split(text):
            if part in self.special:
                i = self.special[part]
                found.append((str(i), np.array([i], "<u4").tobytes(), 1))
            else:
                found += [get(p) or self._entry(p) for p in self._pieces.findall(part)]
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([e[1] for e in self.entries(text)]), "<u4")

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        found = self._counts.get(piece)
        if found is None:
            found = len(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
            if len(piece) <= LONG:
                if len(self._counts) >= COUNTS:
                    self._counts.clear()
                self._counts[piece] = found
        return found

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each of some pre-tokens, none of them special."""
        get, count = self._counts.get, self.count
        return np.array([get(p) or count(p) for p in pieces], np.int64)

    def pieces(self, text: str, at: int = 0) -> Iterator:
        """Matches of the pre-token pattern from a place on."""
        return self._pieces.finditer(text, at)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, by one gather over the blob. Ids beyond the table give nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self._start) - 1)]
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            start = self._start[part]
            length = self._start[part + 1] - start
            ends = np.cumsum(length)
            if len(ends):
                out.append(self._blob[np.arange(ends[-1]) + np.repeat(start - ends + length, length)])
        return np.concatenate(out).tobytes() if out else b""


@lru_cache(maxsize=4)
def load(path: str | None = None) -> ByteBPE:
    """The encoder of a file, once per process."""
    return ByteBPE(path)


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """(id, ids array<int>) of whole texts; null text gives no ids. No shuffle; a task holds one
    Arrow batch. Repeated rows, null ids and extra columns pass as they are; an empty table gives
    no rows."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"]
            )

    return _two(df, id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None):
    """(id, text) of ids; bytes that aren't UTF-8 become U+FFFD, null ids the empty text."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = [
                bpe.decode(x.values.to_numpy() if x.is_valid else []).decode("utf-8", "replace")
                for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], [id_col, "text"])

    two = df.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>"))
    return two.mapInArrow(run, f"{id_col} long, text string")


def round_trip_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Encodes and decodes each text and returns (id, n_tokens, ids_sha256, decoded_sha256): what
    encode() and decode() give, digested where they run, so that ids needn't leave the worker.

    Null text: as the empty text, no ids. Null ids and repeated rows pass as they are; long texts are
    read whole, one at a time. An empty table gives no rows; other columns are ignored. No shuffle."""

    def run(batches):
        bpe = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                entries = bpe.entries(t.as_py() or "")
                ids = np.frombuffer(b"".join([e[1] for e in entries]), "<u4")
                n.append(len(ids))
                a.append(sha(",".join([e[0] for e in entries]).encode()))
                back = bpe.decode(ids)
                b.append(sha(back.decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _two(df, id_col, text_col).mapInArrow(run, schema)


def _two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
