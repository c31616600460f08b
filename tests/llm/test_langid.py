import random
import zlib

import numpy as np

from attesta.llm import langid

WORDS = {
    "en": "the and that with this house running thing over where".split(),
    "fr": "le la été une maison où être français garçon avec".split(),
    "de": "der und nicht straße über schön haus ich werden größe".split(),
}


def documents(seed, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang, "a"))
    return rows


def test_held_out_accuracy(make):
    df = make(documents(1))
    model = langid.fit(df.filter(~langid.held_out()))
    assert sorted(model) == ["de", "en", "fr"]
    rows = langid.predict(df, model, keep=[langid.held_out().alias("held_out"), df["lang"]]).collect()
    own = [r for r in rows if r["held_out"]]
    assert len(own) > 40 and sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundles_are_sums_of_bound_letters():
    text = "Ab, ab!"
    code = {c: langid.letter(ord(c) if c != " " else 0).astype(int) for c in "ab "}
    total = np.zeros(langid.DIM)
    s = " ab ab "
    for i in range(len(s) - 2):
        total += np.roll(code[s[i]], 2) * np.roll(code[s[i + 1]], 1) * code[s[i + 2]]
    assert (langid.bundle([text])[0] == total).all()
    # a batch gives what each text gives alone
    texts = ["one two", "", "zwei drei vier", "!!!"]
    both = langid.bundle(texts)
    assert all((both[i] == langid.bundle([t])[0]).all() for i, t in enumerate(texts))


def test_odd_rows(odd, none, make):
    model = langid.fit(make(documents(2)))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 8):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[6]["lang_pred"] == "en" and by[12]["lang_pred"] in model
    assert langid.predict(none, model).count() == 0
    assert langid.fit(none) == {}
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


def test_learning_is_bounded_and_repeatable(make):
    df = make(documents(3, 400))
    a, b = langid.fit(df, learn=30), langid.fit(df.repartition(5), learn=30)
    assert all((a[k] == b[k]).all() for k in a)


def test_predictions_are_those_of_plain_profiles(make):
    """Predictions and scores against dictionaries of n-grams, bound and bundled one by one."""
    rows = documents(5, 90) + [(900, "", "en", "a"), (901, "12 %", "fr", "a"), (902, None, "de", "a"), (903, "the und", None, "a")]
    letters = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "

    def vector(text):
        total, s = np.zeros(langid.DIM), letters(text or "")
        for i in range(len(s) - 2 if s.strip() else 0):
            v = [langid.letter(ord(c) if c != " " else 0).astype(float) for c in s[i : i + 3]]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        size = np.linalg.norm(total)
        return total / size if size else total

    known = [(t, lang) for i, t, lang, _ in rows if lang and t is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    plain = {lang: sum(vector(t) for t, own in known if own == lang) for lang in WORDS}
    plain = {lang: v / np.linalg.norm(v) for lang, v in plain.items()}
    df = make(rows)
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df.filter(~langid.held_out()))).collect()}
    for i, t, *_ in rows:
        x = vector(t)
        if not x.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosines = np.array([x @ plain[lang] for lang in sorted(plain)])
        share = np.exp((cosines - cosines.max()) / langid.TEMPERATURE)
        assert got[i]["lang_pred"] == sorted(plain)[int(cosines.argmax())]
        assert abs(got[i]["score"] - share.max() / share.sum()) < 1e-6


def test_long_texts_are_read_in_steps(monkeypatch):
    r = np.random.default_rng(3)
    text = "".join(r.choice(list("abc, é. 中"), 5000))
    whole = langid.grams(text)
    sums = langid.bundle([text, "other text", text])
    for step in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(langid, "_STEP", step)
        steps = langid.grams(text)
        assert (steps[0] == whole[0]).all() and (steps[1] == whole[1]).all()
    monkeypatch.setattr(langid, "_GRAMS", 5)
    assert (langid.bundle([text, "other text", text]) == sums).all()


def test_groups_are_cut_by_characters(monkeypatch):
    monkeypatch.setattr(langid, "_GROUP", 3)
    monkeypatch.setattr(langid, "_CHARS", 10)
    cut = lambda sizes: [b - a for a, b in langid.groups(["x" * n for n in sizes])]
    assert cut([1, 1, 1, 1, 20, 1, 9, 2]) == [3, 1, 1, 2, 1] and cut([]) == []


def test_every_label_is_learned(make):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS["en"]) for _ in range(9)), f"label{i}", "a") for i in range(60)]
    assert len(langid.fit(make(rows))) == 60
    assert langid.fit(make([(1, "123", "en", "a"), (2, None, "fr", "a")])) == {}
