import hashlib

import numpy as np
import pytest

from attesta.llm.codes import decoded, digest, neighbours, search, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, v string, code string, error string, _id int, slot int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2, 3) for r in rows], SCHEMA).repartition(3)


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd's rounds over all entries, in Python integers."""
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(o) for col in zip(*o)] if o else e for o, e in zip(own, books[p])]
    found = [(i, bytes(nearest(p, c[p])[1] for p in range(parts)), sum(nearest(p, c[p])[0] for p in range(parts))) for (i, _), c in zip(kept, cut)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(found, key=str), hashlib.sha256(text.encode()).hexdigest()


def found(df):
    rows, books = vector_codes(df)
    return sorted(((r["vec_id"], bytes(r["code"]), r["error"]) for r in rows.collect()), key=str), books, rows


@pytest.mark.parametrize("seed,n,grid", [(1, 90, None), (2, 60, 4), (3, 9, None), (4, 70, 2)])
def test_against_plain_rounds(spark, seed, n, grid):
    """grid: few different components, so many distances tie and entries repeat."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24)) if grid is None else rng.integers(-grid, grid, (n, 24)) / 4096
    rows = [(int(i), [float(c) for c in v], int(i) % 3) for i, v in zip(rng.permutation(n), x)]
    rows += [rows[0], (None, rows[1][1], None), (5, None, 1), (6, [float("nan")] * 24, 1), (7, [None] + [0.5] * 23, 1), (8, [float("inf")] * 24, 1)]
    want, sha = plain(rows)
    got, books, _ = found(table(spark, rows))
    assert got == want
    assert [digest(b) for b in books.values()] == [sha]


def test_search_scans_a_sufficient_radius():
    rng = np.random.default_rng(5)
    for spread in (3, 50, 1 << 20):
        book = rng.integers(-spread, spread, (16, 3))
        book[5] = book[2]
        x = rng.integers(-spread, spread, (500, 3))
        all_ = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        code, dist = search(x, book, rng.integers(0, 16, 500))
        assert (code == all_.argmin(axis=1)).all() and (dist == all_.min(axis=1)).all()
        gaps, others = neighbours(book)
        assert all(sorted([a, *o]) == list(range(16)) and (np.diff(gaps[a, o]) >= 0).all() for a, o in enumerate(others))


def test_lengths_and_large_components(spark):
    rows = [(i, [float(i + j) for j in range(8 if i % 2 else 11)], None) for i in range(30)]
    rows += [(100, [], 1), (101, [1e30] * 8, 1), (102, [-4e4] * 8, 1)]
    got, books, at = found(table(spark, rows))
    assert sorted(books) == [8, 16] and [g[0] for g in sorted(got)] == [*range(30), 102]
    for r in at.filter("dim = 16 and error = 0").collect():
        x = np.array([float(r["vec_id"] + j) for j in range(11)] + [0.0] * 5) * 4096
        assert (decoded(bytes(r["code"]), books[16]) == x).all()


def test_query(spark, tmp_path):
    from attesta.llm.codes import op11_exponion_codes

    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=16)], [None, 1, 2][i % 3]) for i in range(40)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    at = {r["vec_id"]: r for r in op11_exponion_codes(spark, str(tmp_path)).collect()}
    want, sha = plain(rows)
    assert {(i, c.hex(), e, sha) for i, c, e in want} == {(i, r["code"], r["error"], r["codebooks_sha256"]) for i, r in at.items()}
    for label in (None, 1, 2):
        own = [i for i, _, x in rows if x == label]
        assert {at[i]["label_error"] for i in own} == {sum(at[i]["error"] for i in own)}


def test_empty(spark, tmp_path):
    from attesta.llm.codes import op11_exponion_codes

    table(spark, [(1, None, None)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_exponion_codes(spark, str(tmp_path)).collect() == []
