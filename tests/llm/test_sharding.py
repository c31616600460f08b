import random
import zlib

from pyspark.sql import functions as F

from attesta.llm import sharding
from attesta.llm.sharding import shard_by_bytes


def check(df, rows, shards=8):
    got = df.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    groups = {}
    for x in got:
        groups.setdefault((x["text_crc32"], x["size"]), set()).add(x["shard"])
    assert all(len(s) == 1 for s in groups.values())
    return got, [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


def plain(points, shards):
    """Shard of each point by a k-d tree in plain Python: sorted positions instead of histograms."""
    total = sum(p["weight"] for p in points)
    order = sorted(points, key=lambda p: (-p["weight"], p["group_hash"]))
    out = {}
    while len(out) < shards - 1 and order and order[0]["weight"] * (shards - len(out)) > total:
        total -= order[0]["weight"]
        out[order.pop(0)["group_hash"]] = len(out)
    extent = lambda own, d: max(p[d] for p in own) - min(p[d] for p in own)
    whole = {d: max(1, extent(order, d)) for d in sharding.DIMS} if order else {}

    def split(own, names):
        if len(names) == 1 or not own:
            out.update((p["group_hash"], names[0]) for p in own)
            return
        mid = len(names) // 2
        dim = max(sharding.DIMS, key=lambda d: extent(own, d) / whole[d])
        own = sorted(own, key=lambda p: (p[dim], p["d_tie"]))
        need, k = mid / len(names) * sum(p["weight"] for p in own), 0
        while k < len(own) and need >= own[k]["weight"]:
            need -= own[k]["weight"]
            k += 1
        if k < len(own) and need > own[k]["weight"] / 2:
            need -= own[k]["weight"]
            k += 1
        low, high = own[:k], own[k:]
        if abs(need) >= 1:
            near = high[: sharding.NEAR] if need > 0 else low[::-1][: sharding.NEAR]
            left, moved, rest = abs(need), set(), []
            for p in sorted(near, key=lambda p: (p["weight"], p["group_hash"]), reverse=True):
                if p["weight"] <= left:
                    moved.add(p["group_hash"])
                    left -= p["weight"]
                else:
                    rest.append(p)
            if rest and rest[-1]["weight"] < 2 * left:
                moved.add(rest[-1]["group_hash"])
            low, high = (
                [p for p in own if (p in low) != (p["group_hash"] in moved)],
                [p for p in own if (p in low) == (p["group_hash"] in moved)],
            )
        split(low, names[:mid])
        split(high, names[mid:])

    split(order, list(range(len(out), shards)))
    return out


def corpus(n=1500):
    r = random.Random(4)
    texts = ["w" * int(r.paretovariate(1.1) * 20) + str(i) for i in range(n)]
    texts += [texts[3]] * 40 + ["same text"] * 200
    return [(i, t, r.choice("ab"), f"s{r.randint(0, 9)}") for i, t in enumerate(texts)]


def test_shards_are_those_of_a_plain_tree(spark, make, monkeypatch):
    kept = []
    real = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    rows = corpus(400)
    for shards in (8, 3):
        kept.clear()
        got, _ = check(shard_by_bytes(make(rows), shards), rows, shards)
        points = [r.asDict() for r in dict(kept)["points"].collect()]
        want = plain(points, shards)
        hashed = spark.createDataFrame([(t,) for _, t, *_ in rows], "t string").distinct()
        names = {(zlib.crc32(r["t"].encode()), len(r["t"].encode()) + 1): r["h"] for r in hashed.select("t", F.xxhash64("t").alias("h")).collect()}
        assert all(r["shard"] == want[names[r["text_crc32"], r["size"]]] for r in got)


def test_bytes_are_near_equal(make):
    rows = corpus()
    _, loads = check(shard_by_bytes(make(rows)), rows)
    mean = sum(loads) / 8
    assert max(loads) - min(loads) <= 0.01 * mean


def test_a_group_beyond_a_share_has_its_own_shard(make):
    rows = [(i, "hot text " * 5 if i % 2 else f"other {i} " * 4, "en", "a") for i in range(800)]
    got, loads = check(shard_by_bytes(make(rows)), rows)
    assert {r["size"] for r in got if r["shard"] == 0} == {46}
    assert max(loads[1:]) - min(loads[1:]) <= 2 * 46  # two points


def test_rows_of_one_id_are_dealt_once_each(make):
    """One id with other texts, sources and langs, and rows without one, in a group beyond a share."""
    r = random.Random(6)
    rows = [(i // 3, "hot " * 30, r.choice(["en", None]), r.choice("abc")) for i in range(500)]
    rows += [(None, "cold " * r.randint(1, 40), None, r.choice("abc")) for _ in range(300)]
    rows += [(i % 7, f"text {i} " * r.randint(1, 9), "fr", None) for i in range(100)]
    check(shard_by_bytes(make(rows)), rows)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(shard_by_bytes(odd), rows)
    assert shard_by_bytes(none).count() == 0


def test_few_documents(make):
    check(shard_by_bytes(make([(1, "only", "en", "a")])), [(1, "only")])
    long = [(i, f"{i} " + "very long " * 200_000 * (i == 2), "en", "a") for i in range(5)]
    _, loads = check(shard_by_bytes(make(long)), long)
    assert sorted(loads)[-2] < 10


def test_many_rows_that_agree_in_all(make, monkeypatch):
    """Null texts without an id and a repeated row: counted rows become rows again, with gapless slots."""
    import attesta.llm.sharding as own

    monkeypatch.setattr(own, "BLOCK", 7)
    rows = [(None, None, "en", "a")] * 100 + [(-1, "again and again", "en", "a")] * 30 + [(i, f"text {i}", "en", "b") for i in range(60)]
    got = own.shard_by_bytes(make(rows), shards=4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and slots
    assert sum(r["doc_id"] is None for r in got) == 100 and sum(r["doc_id"] == -1 for r in got) == 30
