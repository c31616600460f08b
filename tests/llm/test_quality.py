import random
import re
from collections import Counter

import numpy as np
import pytest

from attesta.llm import quality
from attesta.llm.quality import COUNTS, MORE, grow, measure, repeated, rules, threshold


def plain(text):
    """The five base counts, from their definition."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(3)
    yield from (None, "", " \n\t", "x", "\x00\x1c a\x85b \xa0", "é\x0bè\x0cê  ñ", "a " * 9, "a " * 8, "日本 語 " * 30, "#*$%&|<>\n\n|\n|")
    yield "\n".join(["one line"] * 3 + ["one line ", "", " ", "one line"])
    for _ in range(200):
        words = rng.choices(["a", "b", "é$", "<c>"][: rng.randint(1, 4)], k=rng.randint(0, 60))
        yield "".join(w + rng.choice([" ", " ", "\n", "\t\r"]) for w in words)
    block = " ".join(f"w{i}" for i in range(20))
    yield f"{block} x {block} y {block}"
    yield " ".join(str(rng.random()) for _ in range(40_000)) + (" same eight words stand here and here again" * 2)


def test_counts_against_definition():
    for t in texts():
        assert measure((t or "").encode())[: len(COUNTS)] == plain(t), t


@pytest.mark.parametrize("window", [2, 4, 8])
def test_windows(window):
    rng = np.random.default_rng(2)
    for n in range(0, 40):
        ids = rng.integers(0, 2, n)
        w = Counter(tuple(ids[i : i + window]) for i in range(n - window + 1))
        want = {i + k for i in range(n - window + 1) if w[tuple(ids[i : i + window])] > 1 for k in range(window)}
        assert repeated(ids, window) == len(want)


def clean(rng):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(25, 200)))


def junk(rng):
    kind = rng.randrange(3)
    t = clean(rng)
    return [t.upper().replace(" ", "!! "), t.replace(" ", "*** "), t.replace(" ", " | ")][kind]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    return [(i, junk(rng) if i % 10 == 3 else clean(rng), "en", "s") for i in range(1500)]


def labelled(spark, corpus, every=3):
    rows = [(i, int(i % 10 != 3), 0, "x") for i, *_ in corpus if i % every == 0 and i is not None]
    return spark.createDataFrame([*rows, (None, 1, 0, "x"), (5, None, 0, "x"), (10**9, 0, 0, "x")], "doc_id long, quality int, toxic int, score string")


def test_junk_goes_and_clean_stays(spark, make, corpus):
    """Half of the corpus are copies of one document: the forest isn't drawn from them alone."""
    copies = [(10_000 + i, corpus[0][1], "en", "s") for i in range(1500)]
    out = {r["doc_id"]: r for r in rules(make(corpus + copies), labelled(spark, corpus)).collect()}
    assert len(out) == 3000 and not any(r["base_failed"] for r in out.values())
    unseen = [i for i, *_ in corpus if i % 3]
    bad = [i for i in unseen if i % 10 == 3]
    good = [i for i in unseen if i % 10 != 3]
    assert np.mean([out[i]["kept"] for i in good]) > 0.98
    assert np.mean([out[i]["kept"] for i in bad]) < 0.05
    assert all(out[i]["kept"] == out[0]["kept"] for i, *_ in copies)


def test_scores_are_path_lengths():
    """Against a walk of each row through each tree."""
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 300, (400, len(COUNTS) + len(MORE)))
    forest = grow(counts, trees=20, drawn=64)
    x = forest.rates(counts)
    for i in range(0, 400, 17):
        total = 0.0
        for node in forest.roots:
            while forest.path[node] < 0:
                node = forest.left[node] + (x[i, forest.feature[node]] >= forest.cut[node])
            total += forest.path[node]
        assert forest.scores(counts[i : i + 1])[0] == pytest.approx(2 ** (-total / 20 / quality.usual_path(64)))


def test_threshold_is_the_best_of_all(spark):
    rng = random.Random(6)
    scores = [(i, 100, 0, (rng.randrange(4096) if i % 4 else rng.randrange(2000, 4096)) / 4096) for i in range(800)]
    labels = [(i, int(i % 4 != 0)) for i in range(800)]
    at = threshold(
        spark.createDataFrame(scores, "doc_id long, n_words long, n_repeat_words long, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )
    gain = lambda t: np.mean([s[3] >= t for s in scores if s[0] % 4 == 0]) - quality.CAUTION * np.mean([s[3] >= t for s in scores if s[0] % 4])
    assert gain(at) == pytest.approx(max(gain(b / 4096) for b in range(4097)))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 0)], "doc_id long, quality int")
    rows = rules(odd, labels).collect()
    assert len(rows) == 17
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules(none, labels).collect() == []


def test_without_labels_the_base_rules_decide(spark, make, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] != r["base_failed"] for r in rules(make(corpus[:200]), labels).collect())
