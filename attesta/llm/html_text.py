"""Main text of web pages: a recurrent labeller over the blocks of a page."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .common import lean, shared_dir, slices
from .page_maker import Maker

PATH, WORDS, PLAIN = 128, 256, 14
WIDTH = PATH + WORDS + PLAIN
HIDDEN = 20
#: Invented pages that the labeller is trained on, and passes over them.
PAGES, PASSES, GROUP = 4000, 8, 32
#: Blocks, with those that fill up shorter pages, that are labelled at once.
PLACES = 1 << 13


@lru_cache(maxsize=1 << 16)
def _path_row(path: tuple) -> np.ndarray:
    """A path's hashed elements, and those of its last three apart."""
    row = np.zeros(PATH, np.float32)
    half = PATH // 2
    for i, (tag, *words) in enumerate(path[::-1]):
        for name in (tag, *(f"{w}" for w in words)):
            kind = "t:" if name is tag else "n:"
            h = zlib.crc32((kind + name).encode())
            row[h % half] += 1.0 if h >> 16 & 1 else -1.0
            if i < 3:
                h = zlib.crc32((f"{i if name is tag else 9}" + kind + name).encode())
                row[half + h % half] += 1.0 if h >> 16 & 1 else -1.0
    return np.clip(row, -2, 2)


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % WORDS * 2 + (h >> 16 & 1)


_EDGE = str.maketrans(dict.fromkeys(".,;:!?()[]|\"'。、，！？：；（）「」؟،", " "))
#: Letters of scripts that put no spaces between words, and ones that say as much as several others.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff]")
_DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def words_of(text: str) -> list[str]:
    """Lower-cased words; where no spaces part them, pairs of letters."""
    out: list[str] = []
    for w in text.lower().translate(_EDGE).split():
        if w.isascii() or not _UNSPACED.search(w):
            out.append(w)
        else:
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
    return out


def _weight(text: str) -> float:
    """The length of a text, in letters of an alphabet."""
    return len(text) + (0 if text.isascii() else 1.5 * len(_DENSE.findall(text)))


def features(found: list[Block]) -> np.ndarray:
    """A row per block: tag path, all its words (hashed, once each, by the root of their number), size,
    links, and its share of the page's text with those of its parent and grandparent element."""
    n = len(found)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return x
    size = np.array([_weight(b.text) for b in found], np.float32)
    linked = np.array([b.linked / len(b.text) for b in found], np.float32)
    free = size * (1 - linked)
    shares = []
    for up in (1, 2):
        names: dict[tuple, int] = {}
        at = np.array([names.setdefault(b.path[: len(b.path) - up] if len(b.path) > up else (), len(names)) for b in found])
        held, chars, blocks_ = (np.bincount(at, w)[at] for w in (free, size, np.ones(n)))
        shares += [held / max(1.0, float(free.sum())), held / chars, np.log1p(held / blocks_) / 6]
    for i, b in enumerate(found):
        x[i, :PATH] = _path_row(b.path)
        words = words_of(b.text)
        if words:
            distinct = dict.fromkeys(words)
            codes = np.fromiter(map(_word_hash, distinct), np.int64, len(distinct))
            signs = (codes & 1) * 2.0 - 1.0
            x[i, PATH : PATH + WORDS] = np.bincount(codes >> 1, signs, WORDS) / np.sqrt(len(distinct))
        x[i, PATH + WORDS : PATH + WORDS + 8] = (
            np.log1p(size[i]) / 6, np.log1p(len(words)) / 5, linked[i], size[i] > 80,
            b.text[-1] in ".!?。！？؟।", i / n, "©" in b.text, 1.0,
        )
    x[:, PATH + WORDS + 8 :] = np.stack(shares, axis=1)
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output, in numpy."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in "fb":
            self.w[f"W{d}"] = (rng.standard_normal((WIDTH + h, 4 * h)) / np.sqrt(WIDTH / 8 + h)).astype(np.float32)
            self.w[f"B{d}"] = np.zeros(4 * h, np.float32)
            self.w[f"B{d}"][h : 2 * h] = 1.0
        self.w["U"] = (rng.standard_normal(2 * h) / np.sqrt(2 * h)).astype(np.float32)
        self.w["V"] = np.zeros(WIDTH, np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, live: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """x: time, page, width. live: time, page. Places that aren't live keep the state. tape: gets
        what training needs of each step."""
        h = HIDDEN
        w, bias = self.w[f"W{d}"], self.w[f"B{d}"]
        into = x @ w[:WIDTH] + bias
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out = np.zeros((*x.shape[:2], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = into[t] + state @ w[WIDTH:]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            on = live[t][:, None]
            new = np.where(on, f * cell + i * g, cell)
            flat = np.tanh(new)
            if tape is not None:
                tape.append((t, state, cell, i, f, o, g, flat))
            state, cell = np.where(on, o * flat, state), new
            out[t] = state
        return out

    def scores(self, x: np.ndarray, live: np.ndarray, tapes: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._pass(x, live, d, None if tapes is None else tapes[d]) for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["U"] + x @ self.w["V"] + self.w["c"]), both

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        tapes: dict[str, list] = {"f": [], "b": []}
        p, both = self.scores(x, live, tapes)
        n = live.sum()
        delta = ((p - y) * live / n).astype(np.float32)
        e = 1e-7
        loss = -(np.where(live, y * np.log(p + e) + (1 - y) * np.log(1 - p + e), 0)).sum() / n
        g = {
            "U": np.einsum("tp,tph->h", delta, both), "V": np.einsum("tp,tpw->w", delta, x),
            "c": delta.sum(keepdims=True).ravel()[:1],
        }
        h = HIDDEN
        for d, tape, part in (("f", tapes["f"], slice(0, h)), ("b", tapes["b"], slice(h, 2 * h))):
            w = self.w[f"W{d}"]
            gw, gb = np.zeros_like(w), np.zeros(4 * h, np.float32)
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, state, cell, i, f, o, gate, flat in reversed(tape):
                on = live[t][:, None]
                ds = ds + delta[t][:, None] * self.w["U"][part]
                do = ds * flat
                dn = dc + ds * o * (1 - flat * flat)
                dz = np.concatenate(
                    [dn * gate * i * (1 - i), dn * cell * f * (1 - f), do * o * (1 - o), dn * i * (1 - gate * gate)],
                    axis=1,
                ) * on
                gw[:WIDTH] += x[t].T @ dz
                gw[WIDTH:] += state.T @ dz
                gb += dz.sum(axis=0)
                ds = np.where(on, dz @ w[WIDTH:].T, ds)
                dc = np.where(on, dn * f, dc)
            g[f"W{d}"], g[f"B{d}"] = gw, gb
        return float(loss), g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of the blocks of each page. Pages of like length run together, PLACES blocks at a time,
        the places that are filled up counted; a longer page runs alone."""
        order = np.argsort([len(p) for p in pages], kind="stable").tolist()
        out: list = [np.zeros(0)] * len(pages)
        while order:
            longest = len(pages[order[-1]])
            own = order[-max(1, PLACES // max(1, longest)) :]
            del order[-len(own) :]
            if longest:
                x, live = _stack([pages[k] for k in own])
                p = self.scores(x, live)[0]
                for c, k in enumerate(own):
                    out[k] = p[: len(pages[k]), c].copy()
        return out


def _stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(pages) == 1:
        return pages[0][:, None], np.ones((len(pages[0]), 1), bool)
    n = max(map(len, pages))
    x, live = np.zeros((n, len(pages), WIDTH), np.float32), np.zeros((n, len(pages)), bool)
    for c, p in enumerate(pages):
        x[: len(p), c], live[: len(p), c] = p, True
    return x, live


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, passes: int = PASSES, seed: int = 11) -> Labeller:
    """A labeller trained on invented pages; the same for the same arguments."""
    made = []
    maker = Maker(seed)
    while len(made) < pages:
        page, labels = maker.page()
        found = blocks(page)
        if len(found) != len(labels):
            raise AssertionError("the page maker and the parser disagree on blocks")
        if found:
            made.append((features(found), np.array(labels, np.float32)))
    made.sort(key=lambda m: len(m[0]))
    groups = []
    for at in range(0, len(made), GROUP):
        own = made[at : at + GROUP]
        x, live = _stack([m[0] for m in own])
        y = np.zeros(live.shape, np.float32)
        for c, m in enumerate(own):
            y[: len(m[1]), c] = m[1]
        groups.append((x, live, y))
    model, rng = Labeller(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, steps = 0, passes * len(groups)
    for _ in range(passes):
        for k in rng.permutation(len(groups)):
            x, live, y = groups[k]
            # some hashed names are hidden, so that no single one decides
            hide = (rng.random((1, x.shape[1], WIDTH)) > 0.08).astype(np.float32)
            _, g = model.gradients(x * hide, live, y)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            rate = 0.02 * (1 - step / (steps + 1))
            for name, v in g.items():
                v = v * min(1.0, 5.0 / (size + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                a, b = first[name] / (1 - 0.9**step), second[name] / (1 - 0.99**step)
                model.w[name] -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return model


def fitted(spark: SparkSession) -> Labeller:
    """trained(), stored in the shared folder under the hash of its code: sessions that share the folder
    train once."""
    sources = b"".join(Path(__file__).with_name(f).read_bytes() for f in ("html_text.py", "blocks.py", "page_maker.py"))
    path = f"{shared_dir(spark)}/attesta-labeller-{hashlib.sha256(sources).hexdigest()[:16]}"
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:  # nobody has stored it yet
        row = None
    if row is None:
        model = trained()
        weights = [(name, bytearray(v.astype("<f4").tobytes())) for name, v in sorted(model.w.items())]
        spark.createDataFrame([(dict(weights),)], "weights map<string,binary>").coalesce(1).write.mode("overwrite").parquet(path)
        return model
    model = Labeller()
    for name, v in model.w.items():
        model.w[name] = np.frombuffer(row["weights"][name], "<f4").reshape(v.shape)
    return model


def _groups(pages: list[str | None]) -> Iterator[list[list[Block]]]:
    """The blocks of pages, in runs of about PLACES blocks."""
    held: list[list[Block]] = []
    n = 0
    for page in pages:
        held.append(blocks(page or ""))
        n += len(held[-1])
        if n >= PLACES:
            yield held
            held, n = [], 0
    if held:
        yield held


def main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    model: Labeller | None = None,
) -> DataFrame:
    """(id, url, text, n_chars) of each page: the blocks that the labeller takes for main text,
    joined by line feeds. Memory follows the longest page, not the number of pages beside it.

    Null or empty html, and pages without main text: the empty text. Null ids and urls and repeated
    rows pass as they are; an empty table gives no rows; other columns are ignored. No shuffle."""
    model = model or fitted(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            at = 0
            for found in _groups(part.column(2).to_pylist()):
                scores = model.label([features(b) for b in found])
                texts = [
                    "\n".join(b.text for b, p in zip(own, s) if p > 0.5) for own, s in zip(found, scores)
                ]
                rows = part.slice(at, len(found))
                at += len(found)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    [id_col, url_col, "text", "n_chars"],
                )

    rows = df.select(
        F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col),
        F.col(html_col).cast("string").alias("h"),
    )
    return rows.mapInArrow(lean(run), f"{id_col} long, {url_col} string, text string, n_chars long")


def op8_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
