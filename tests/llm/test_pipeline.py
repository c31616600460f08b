import random

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from attesta.llm import langid, packing


def test_stages(spark, make, tmp_path):
    """Copies, near copies and rejected texts go; repeats are cut; the rest is packed whole."""
    base = [f"sentence number {i} of the first document goes on and on" for i in range(12)]
    one = " ".join(base)
    near = one.replace("number 7", "number seven")
    passage = "this passage of well over a hundred bytes stands in two otherwise different documents, word for word, again"
    rows = [
        (1, one, "en", "a"), (2, one, "en", "a"), (3, near, "en", "b"), (4, None, "en", "a"), (5, "123 !!!", "en", "a"),
        (6, f"alpha beta {passage} gamma", "en", "a"), (7, f"delta epsilon zeta eta theta iota {passage} kappa lambda mu nu xi omicron pi rho sigma tau", "en", "a"),
        (8, "un petit texte en français où l'été est beau", "fr", "a"),
    ]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    ids = []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted(r["doc_id"] for r in at.collect()))
    assert ids[0] == [1, 2, 3, 6, 7, 8] and ids[1] == [1, 6, 7, 8] and ids[2] == ids[1]
    cut = {r["doc_id"]: r for r in at.collect()}
    assert passage not in cut[7]["text"] and passage in cut[6]["text"] and cut[7]["n_chars"] == len(cut[7]["text"])
    packed = pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.load(packing.default_path()).encode_all([r["text"] for r in at.collect()])
    assert sum(r["length"] for r in packed) == sum(map(len, tokens))


def test_empty_documents(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass(spark, odd):
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns


def test_entry_has_all_queries():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert langid.DIM >= 512


def test_rejection_does_not_depend_on_the_number_of_languages(spark, make):
    """Short clean texts stay among 20 languages, noise goes among one, four and 20."""
    r = random.Random(5)

    def language():
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 12)
        return ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(60)]

    vocabularies = [language() for _ in range(20)]
    for n in (1, 4, 20):
        rows = [
            (1000 * k + i, " ".join(r.choice(v) for _ in range(3 if i < 10 else 80)), f"l{k:02}", "a")
            for k, v in enumerate(vocabularies[:n]) for i in range(40)
        ]
        noise = [(10**6 + i, "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(800)), None, "a") for i in range(20)]
        kept = pipeline.identify_language(spark, make(rows + noise), "")
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(x[0] for x in rows)


def test_whole_pipeline_against_brute_force(spark, make, tmp_path):
    """run() against plain Python: copies, near copies, shared passages, odd rows, repeated ids."""
    import zlib

    import numpy as np

    from attesta.llm import common
    from attesta.llm import simhash as s

    r = random.Random(77)
    words = [f"{a}{b}{c}" for a in ("be", "lo", "mi") for b in ("ran", "to", "vel") for c in ("da", "sk", "ern", "u")]
    passage = " ".join(r.choice(words) for _ in range(40))
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words) + str(r.randint(0, 9)) for _ in range(r.randint(3, 120)))
        rows.append((i, text + (f" {passage} " if i % 4 == 0 else "") + r.choice(words), "en", "a"))
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(0, 30, 3)]
    rows += [(200 + i, rows[i][1] + " and more", "en", "b") for i in range(0, 30, 5)]
    rows += [(7, "another text of an id that stands twice " + passage, "fr", "a"), (None, rows[8][1], "en", "a"), (None, " ".join(words[3:9]), "en", "a"),
             (300, None, "en", "a"), (301, "", "en", "a"), (302, "123 ?!", "en", "a"), (5, rows[5][1], "en", "a")]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = len(common.made())
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert len(common.made()) == before + 1

    # letters; the fixture's languages have no outliers
    known = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    sets = [set(s.shingles(t.encode(), 5).tolist()) for _, t in known]
    root = list(range(len(known)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(known)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    order = lambda k: (known[k][0] is None, known[k][0] or 0)
    kept = [min((k for k in range(len(known)) if find(k) == g), key=order) for g in {find(k) for k in range(len(known))}]
    # repeats, in the order of ids; of id 7 two texts stay, whose order is that of their hashes
    hashed = {x["t"]: x["h"] for x in spark.createDataFrame([(t,) for _, t in known], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    seen, want = set(), []
    for k in sorted(kept, key=lambda k: (*order(k), hashed[known[k][1]])):
        text = known[k][1].encode()
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 99):
            if text[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(text[at : at + 100])
        want.append((known[k][0], bytes(b for b, g in zip(text, gone) if not g).decode()))
    tokens = packing.load(packing.default_path()).encode_all([t for _, t in want])
    ids = sorted((str(i), len(v)) for (i, _), v in zip(want, tokens))
    starts = sorted((str(x["doc_id"]), x["doc_tokens"]) for x in got if x["start"] == 0)
    assert starts == ids
    assert sum(x["length"] for x in got) == sum(map(len, tokens))
    whole = {zlib.crc32(v.tobytes()) for v in tokens}
    assert all(x["ids_crc32"] in whole for x in got if x["length"] == x["doc_tokens"])
    assert any(x["length"] == x["doc_tokens"] for x in got) and len(kept) < len(known) - 10
