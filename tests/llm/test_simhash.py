import random
import re

import numpy as np
import xxhash

import attesta.llm.simhash as s


def plain(text, words=3):
    """The fingerprint, as the definition reads."""
    b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, near):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def families(seed, n=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(1, 150))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            other = list(base)
            for _ in range(r.randint(0, 3)):
                other[r.randrange(len(other))] = word()
            texts.append(r.choice([" ", "\n"]).join(other).upper() if r.random() < 0.2 else " ".join(other))
    return texts


def test_fingerprints_follow_the_definition():
    for t in [*families(1), "", "  ", "One", "One two", "ÉTÉ Été\xa0été \x1c x", "a b c d"]:
        assert s.fingerprint(t.encode()) == plain(t)


def test_components_agree_with_brute_force(make):
    texts = families(2)
    prints = [plain(t) for t in texts]
    want = components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r["doc_id"]: r for r in s.simhash_components(make([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(want) - 5


def test_tiles_find_all_links(monkeypatch):
    monkeypatch.setattr(s, "TILE", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(k) for k in rng.integers(0, 64, 60)]
    prints = np.concatenate([base, base ^ np.array(flips[:30], np.uint64), base ^ np.array(flips[30:], np.uint64)])
    for radius in (1, 2, 3):
        want = components(prints.tolist(), lambda i, j: (int(prints[i]) ^ int(prints[j])).bit_count() <= radius)
        roots = s.link(prints, radius)
        same = lambda a: [[x == y for y in a] for x in a]
        assert same(roots.tolist()) == same(want)


def test_hot_buckets_are_dealt_by_population_count(make, monkeypatch):
    monkeypatch.setattr(s, "HOT_BUCKET", 3)
    texts = families(6, 15)
    prints = [plain(t) for t in texts]
    want = components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r["doc_id"]: r["component_id"] for r in s.simhash_components(make([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_ids_link_nothing(make, monkeypatch):
    """Rows without an id, and one id on several fingerprints, against brute force by fingerprint."""
    r = random.Random(12)
    texts = families(9, 20)
    rows = [(r.choice([None, None, i, i // 3, 7]), t, "en", "a") for i, t in enumerate(texts)]
    prints = [plain(t) for t in texts]
    root = components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    low = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in root}
    want = sorted([(rows[i][0], f"{prints[i]:016x}", low[root[i]]) for i in range(len(rows))], key=str)
    got = s.simhash_components(make(rows)).collect()
    assert sorted([(g["doc_id"], g["fingerprint"], g["component_id"]) for g in got], key=str) == want
    assert sum(i is None and low[c] is None for (i, *_), c in zip(rows, root)) > 1


def test_two_classes_without_ids_stay_apart(spark, make, monkeypatch):
    """Fingerprints A, A' and B, B' within the radius, A and B far apart; A' and B' without an id."""
    a, b = 0x0123456789ABCDEF, 0xFEDCBA9876543210
    made = {"a": a, "a2": a ^ 1, "b": b, "b2": b ^ 6}
    for ids in ((None, None), (9, 9)):
        classes = spark.createDataFrame([(p if p < 2**63 else p - 2**64,) for p in made.values()], "fp long")
        pairs = {frozenset(x + 2**64 if x < 0 else x for x in e) for e in s._edges(classes, 2).collect()}
        assert pairs == {frozenset((made["a"], made["a2"])), frozenset((made["b"], made["b2"]))}, ids


def test_odd_rows(odd, none):
    got = s.simhash_components(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[1]["component_id"]
    assert by[5]["component_id"] == 4
    assert s.simhash_components(none).count() == 0


def test_near_duplicates_agree_with_brute_force(make):
    texts = families(8, 30)
    sets = [set(s.shingles(t.encode(), 5).tolist()) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = components(texts, near)
    df = make([(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_large_buckets_are_dealt_as_pairs_of_parts(make, monkeypatch):
    monkeypatch.setattr(s, "HOT_BUCKET", 4)
    texts = families(9, 4)
    shared = "five words that all share"
    texts = [f"{shared} {t}" for t in texts] + [f"{texts[0]} {shared} more{i}" for i in range(30)]
    sets = [set(s.shingles(t.encode(), 5).tolist()) for t in texts]
    want = components(texts, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(make([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_dropping_from_odd_rows(odd, none):
    kept = s.drop_near_duplicates(odd).collect()
    ids = [r["doc_id"] for r in kept]
    # the shingles of 6, repeated over and over, are those of -3
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids and -3 in ids and 9 in ids
    # of the texts without words one stays
    assert sum(not (r["text"] or "").split() for r in kept) == 1
    assert s.drop_near_duplicates(none).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(make):
    """A copy goes, another text of its id stays; so for rows without an id, and repeated rows."""
    r = random.Random(31)
    text = [" ".join(r.choice("abcdefghij") * 3 + str(r.randint(0, 99)) for _ in range(60)) for _ in range(5)]
    rows = [
        (1, text[0], "en", "a"), (2, text[0], "en", "a"), (2, text[1], "en", "a"), (3, text[2], "en", "a"),
        (3, text[3], "fr", "b"), (None, text[0], "en", "a"), (None, text[4], "en", "a"), (None, text[4], "en", "b"),
        (3, text[3], "fr", "b"), (2, text[3], None, None),
    ]
    kept = [(x["doc_id"], x["text"]) for x in s.drop_near_duplicates(make(rows)).collect()]
    want = [(1, text[0]), (2, text[1]), (3, text[2]), (2, text[3]), (None, text[4])]
    assert sorted(kept, key=str) == sorted(want, key=str)
    found = {(x["doc_id"], x["component_id"]) for x in s.near_duplicates(make(rows)).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (2, 2), (3, 3), (3, 2), (None, None)}


def test_unequal_repeats_and_pairs_at_the_bound_are_found(make):
    """Near copies whose repeats differ, and pairs at 0.8 with and without a shared least hash."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for _ in range(8):  # lines that one text repeats
        lines = [" ".join(word() for _ in range(6)) for _ in range(30)]
        texts.append(" ".join(lines))
        texts.append(" ".join(lines + [(lines[-1] + " ") * 40]))
    for _ in range(400):  # 36 distinct shingles of which 4 differ: 32 of 40
        base = [word() for _ in range(40)]
        texts += [" ".join(base), " ".join([*base[:-4], *(word() for _ in range(4))])]
    sets = [set(s.shingles(t.encode(), 5).tolist()) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert all(near(i, i + 1) for i in range(0, len(texts), 2))
    got = {x["doc_id"]: x["component_id"] for x in s.near_duplicates(make([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]
    # the whole prefixes find what the first elements don't
    one = s.near_duplicates(make([(i, t, "en", "a") for i, t in enumerate(texts)]), keys=1).collect()
    assert {x["doc_id"]: x["component_id"] for x in one} == got


def test_sketches_never_differ_by_more_than_their_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(0, 9000)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, 30, dtype=np.uint64)]))
        (_, x), (_, y) = (s._runs([s.sketch(v)])[0] for v in (a, b))
        words = min(x.shape[1], y.shape[1])
        apart = np.bitwise_count(s._folded(x, words) ^ s._folded(y, words)).sum()
        assert int(apart) <= len(np.setxor1d(a, b))


def test_shared_counts_elements():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 50, int(rng.integers(0, 40)))).astype(np.uint64) for _ in range(30)]
    for own in sets:
        assert s.shared(own, sets).tolist() == [len(np.intersect1d(own, x)) for x in sets]
    assert s.shared(sets[0], []).tolist() == []


def test_long_texts_of_all_sizes_agree_with_brute_force(make, monkeypatch):
    """Sets of 100 to 9000 elements, some of which share passages without being near copies."""
    monkeypatch.setattr(s, "TILE", 16)
    r = random.Random(40)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(300)]
    texts = []
    for n in (100, 450, 600, 1000, 1200, 2500, 9000):
        base = [word() for _ in range(n)]
        for share in (0.0, 0.02, 0.08, 0.15, 0.5):
            cut = int(len(base) * share)
            texts.append(" ".join(base[cut:] + [word() for _ in range(cut)]))
        texts.append(" ".join([*passage, *[word() for _ in range(n)]]))
    sets = [set(s.shingles(t.encode(), 5).tolist()) for t in texts]
    want = components(texts, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(make([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(want)
