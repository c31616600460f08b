import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import bwt, suffix


def brute(docs):
    """docs: [(key, bytes)]; the removed places of each."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            w = text[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        out[key] = gone
    return out


def expected(docs):
    out = {}
    for key, gone in brute(docs).items():
        text = dict(docs)[key]
        kept = bytes(b for b, g in zip(text, gone) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[key] = (len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(passage) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        texts.append(" ".join(parts))
    texts += r.sample(texts, 15)
    texts.append("ab" * 400)
    texts.append("z" * 350)
    return texts


def test_first_places_agrees_with_a_dictionary():
    r = random.Random(1)
    for _ in range(60):
        base = bytes(r.choice(b"ab\0") for _ in range(80))
        strings = []
        for _ in range(r.randint(1, 12)):
            size = r.randint(0, 70)
            at = r.randint(0, 80 - size)
            x = bytearray(base[at : at + size])
            if x and r.random() < 0.5:
                x[r.randrange(len(x))] = r.choice(b"abc")
            strings.append(bytes(x))
        first, _ = bwt.first_places(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), 40)
        seen, want = {}, []
        for s in strings:
            for i in range(len(s) - 39):
                want.append(seen.setdefault(s[i : i + 40], len(want)))
        assert first.tolist() == want


def shards(seed=4, letters=3):
    rng = np.random.default_rng(seed)
    lengths = np.full(40, 130)
    blob = rng.integers(97, 97 + letters, lengths.sum()).astype(np.uint8)
    blob[130 * 30 : 130 * 40] = blob[130 * 5 : 130 * 15]  # strings that stand in two shards
    s = bwt.Strings(blob, lengths)
    cuts = [0, int(s.starts[9]), int(s.starts[20]), s.size]
    return s, blob, [bwt.build(s, a, b, 100) for a, b in zip(cuts, cuts[1:])]


def suffix_at(s, blob, place, n=100):
    """The circle of the string at a place, from there, as bytes + 1 with 0 for padding."""
    own = int(np.searchsorted(s.starts, place, side="right") - 1)
    circle = np.concatenate([blob[own * 130 : own * 130 + 130].astype(int) + 1, np.zeros(10, int)])
    return np.roll(circle, -(place - int(s.starts[own])))[:n].tolist()


def test_merged_order_is_that_of_one_transform():
    s, blob, orders = shards()
    places, common = bwt.merged(s, orders, 100)
    whole = bwt.build(s, 0, s.size, 100)
    # equal up to the order of suffixes that share all of the depth
    assert sorted(places.tolist()) == list(range(s.size)) and common[0] == 0
    assert [suffix_at(s, blob, int(p)) for p in places] == [suffix_at(s, blob, int(p)) for p in whole]


def test_prefix_lengths_follow_from_the_refinement():
    s, blob, orders = shards(letters=2)
    places, common = bwt.merged(s, orders, 100)
    suffixes = [suffix_at(s, blob, int(p)) for p in places]
    for x, y, c in zip(suffixes, suffixes[1:], common[1:].tolist()):
        same = next((i for i in range(100) if x[i] != y[i]), 100)
        assert c == same - same % 20
    assert (common == 100).any() and len(set(common.tolist())) > 2


def test_the_merge_uses_the_order_of_its_shards():
    """Suffixes of a shard are not sorted again, so a shard out of order gives another result."""
    s, _, orders = shards()
    places, common = bwt.merged(s, orders, 100)
    rng = np.random.default_rng(1)
    mixed, other = bwt.merged(s, [rng.permutation(o) for o in orders], 100)
    assert (mixed != places).any() and (other == 100).sum() != (common == 100).sum()


def test_segments_of_equal_windows_have_equal_anchors():
    r = random.Random(2)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(300))
    texts = [bytes(r.choice(b"xyz ") for _ in range(r.randint(0, 400))) + passage for _ in range(5)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    gram, _, text, start, count = suffix.segments(data, np.array([len(t) for t in texts]))
    anchors = {}
    for g, t, a, n in zip(gram, text, start, count):
        for w in range(a, a + n):
            anchors.setdefault(texts[t][w : w + 100], set()).add(int(g))
    assert all(len(a) == 1 for a in anchors.values())
    assert count.sum() == sum(max(0, len(t) - 99) for t in texts)


def test_digests_agree_with_brute_force(make):
    texts = corpus(3)
    rows = [(i * 3 % 101, t, "en", "a") for i, t in enumerate(texts)]
    want = expected([(i, t.encode()) for i, t, *_ in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(make(rows)).collect()}
    assert got == want


def test_hot_anchors_are_dealt_by_window(make, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 20)
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(i, f"{r.random()} {passage} {r.random()}", "en", "a") for i in range(300)]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(corpus(6, 20))]
    want = expected([(i, t.encode()) for i, t, *_ in rows])
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix.digests(make(rows)).collect()}
    assert got == want


def test_odd_rows(odd, none):
    got = suffix.digests(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == 0 and by[7]["n_removed"] == 499
    # each string of the repeated words stands in the text of -3, or a period before
    assert by[6]["n_removed"] == by[6]["n_bytes"] == 204_000 and by[-3]["n_removed"] == 0
    assert suffix.digests(none).count() == 0


def test_texts_stay_valid_and_columns_pass(odd, make):
    out = suffix.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter("text is null").count() == odd.filter("text is null").count()
    accents = "é" * 120
    rows = [(1, "x" + accents, "fr", "a"), (2, "yy" + accents + "z", "fr", "a")]
    kept = {r["doc_id"]: r["text"] for r in suffix.remove_repeats(make(rows)).collect()}
    # in 1 the run repeats itself; in 2 all of it stood before
    assert kept[2] == "yyz" and kept[1].startswith("xé")


def test_a_repeated_row_is_not_taken_from_itself(make):
    text = " ".join(str(i) for i in range(200))
    got = suffix.digests(make([(1, text, "en", "a"), (1, text, "en", "a")])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_documents_are_told_apart_by_id_and_text(make):
    """One id on two texts, equal texts without an id, one id and text in other rows."""
    r = random.Random(8)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(3))
    rows = [
        (1, a, "en", "a"), (2, a, "en", "a"), (2, "short other text", "en", "a"), (2, c[:300] + b[:200], "en", "a"),
        (3, b, "en", "a"), (3, b, "fr", "b"), (None, c, "en", "a"), (None, c, "en", "a"), (None, "x" + a, "en", "a"),
        (None, None, "en", "a"), (4, None, None, None), (4, "", "de", "a"),
    ]
    got = sorted(tuple(x) for x in suffix.digests(make(rows)).collect() for x in [[(x[0] is None, x[0] or 0), *x[1:]]])
    assert len(got) == len(rows)
    # documents in order: by id, then by their texts' order, which changes nothing here
    docs = {k: t for k, t in [((1, 0), a), ((2, 0), a), ((2, 1), c[:300] + b[:200]), ((2, 2), "short other text"), ((3, 0), b), ((9, 0), c), ((9, 1), "x" + a)]}
    want = expected([(k, t.encode()) for k, t in docs.items()])
    names = {t: k for k, t in docs.items()}
    for (i, t, *_), key in [(x, names[x[1]] if x[0] != 2 or x[1] != a else (2, 0)) for x in rows if x[1]]:
        if i == 1:
            key = (1, 0)
        assert ((i is None, i or 0), *want[key]) in got
    assert all(x[2] <= x[1] for x in got)
    assert sum(x[2] for x in got) == 600 + 200 + 200 + 300 + 300 + 600
    none = hashlib.sha256(b"").hexdigest()
    assert got.count(((False, 4), 0, 0, 0, none)) == 2 and ((True, 0), 0, 0, 0, none) in got


def test_spans_merge_and_cut():
    a, b = suffix.merged_spans(np.array([5, 0, 10, 30]), np.array([10, 6, 12, 31]))
    assert a.tolist() == [0, 30] and b.tolist() == [12, 31]
    assert suffix.without(b"abcdefghijklmnopqrstuvwxyz0123456789", a, b) == b"mnopqrstuvwxyz012346789"[:0] + b"mnopqrstuvwxyz0123" + b"56789"


def test_result_does_not_depend_on_partitions(make):
    rows = [(i, t, "en", "a") for i, t in enumerate(corpus(9, 25))]
    one = suffix.digests(make(rows).coalesce(1)).agg(F.sum("n_removed")).first()[0]
    many = suffix.digests(make(rows).repartition(7)).agg(F.sum("n_removed")).first()[0]
    assert one == many
