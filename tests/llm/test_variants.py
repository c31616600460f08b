import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from attesta.llm import variants
from attesta.llm.variants import deletions, roots, spelling_variants


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = counted(docs)
    out = {}
    for w in n:
        near = [o for o in n if apart(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        best = best if best and n[best] >= 2 * n[w] else None
        out[w] = [best, w, n[w], len(near), n.get(best)]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *r) for w, r in out.items()}


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(df).collect()}


def test_against_all_pairs(spark, make):
    rng = random.Random(4)
    docs = []
    for i in range(60):
        words = ["".join(rng.choices("abÀé", k=rng.randint(4, 7))) for _ in range(60)]
        words += [w.upper() for w in rng.choices(["letter", "lettter", "leter", "lätter", "latter", "later"], [40, 9, 5, 3, 8, 20], k=30)]
        docs.append((i if i % 7 else None, rng.choice([" ", "\n", "1", "-"]).join(words)))
    docs += [docs[1], (1000, None), (1001, ""), (1002, "123 !!"), (None, "letter " * 50)]
    want = plain(docs)
    assert got(make([(i, t, None, None) for i, t in docs])) == want
    assert any(r[2] != r[1] and r[1] for r in want)  # chains of more than one form


def test_keys_are_those_of_strings():
    """Two words share a key, at places that overlap, if and only if they are one code point apart."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("aab", k=rng.randint(1, 8))) for _ in range(300)} | {"é" * 40, "é" * 39})
    of, key, lo, hi = deletions(words)
    rows = list(zip(of.tolist(), key.tolist(), lo.tolist(), hi.tolist()))
    met = Counter()
    for a, ka, la, ha in rows:
        for b, kb, lb, hb in rows:
            if a < b and ka == kb and la <= hb and lb <= ha:
                met[words[a], words[b]] += 1
    near = {(words[a], words[b]) for a in range(len(words)) for b in range(a + 1, len(words)) if apart(words[a], words[b])}
    assert set(met) == near and set(met.values()) == {1}


def test_long_words_cost_no_squares(spark, make):
    """A run of 60,000 letters: as many keys, each of them four numbers."""
    long = "".join(random.Random(1).choices("abcdefgh", k=60_000))
    docs = [(i, f"{long} {long[:-1]}", None, None) for i in range(8)]
    rows = {len(r[0]): r for r in got(make(docs)) if len(r[0]) > 59_998}
    want = {len(r[0]): r for r in plain([d[:2] for d in docs]) if len(r[0]) > 59_998}
    assert rows == want and rows[60_000][4] == 1


def test_steps_end_between_runs(monkeypatch):
    text = ("Wörter und mehr Wörter, " * 40).encode()
    want = variants.runs(text)
    for step in (1, 7, 50):
        monkeypatch.setattr(variants, "_STEP", step)
        assert variants.runs(text) == want
    assert want["wörter"] == 80


def test_tasks_pass_words_on(spark, make, monkeypatch):
    docs = [(i, "several words that repeat and repeat", None, None) for i in range(9)]
    want = got(make(docs))
    monkeypatch.setattr(variants, "_HELD", 1)
    assert got(make(docs)) == want and want


def test_chains(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)] + [("x", "0"), ("y", "z")], "word string, form string")
    assert {(r["word"], r["root"]) for r in roots(links).collect()} == {(str(i), "37") for i in range(37)} | {("x", "37"), ("y", "z")}


def test_odd_and_empty(odd, none):
    rows = {r[0]: r for r in got(odd)}
    assert rows["quick"][3] > 3000 and all(len(w) >= 5 for w in rows)
    assert got(none) == set()
    assert np.array(deletions([])[0]).size == 0
