import random
import zlib
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from attesta.llm import packing

PATH = packing.default_path()


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


def test_differencing_balances():
    r = random.Random(1)
    for _ in range(50):
        lengths = [r.randint(1, 1000) for _ in range(r.randint(40, 120))]
        at = packing.differencing(lengths, 8)
        sums = np.bincount(at, weights=lengths, minlength=8)
        assert sums.sum() == sum(lengths) and sums.max() - sums.min() <= 0.05 * sums.mean() + 5


def test_window_count_rises_when_items_stay_whole():
    r = random.Random(2)
    for _ in range(200):
        lengths = [r.randint(1, 100) for _ in range(r.randint(0, 40))]
        windows = packing.pack(lengths, 100, cut=False)
        assert sorted(p[0] for w in windows for p in w) == list(range(len(lengths)))
        assert all(sum(p[2] for p in w) <= 100 for w in windows)
    assert len(packing.pack([60, 60, 60], 100, cut=False)) == 3


def test_windows_that_are_cut_begin_as_whole_items():
    """Only items beyond a window and those of the windows that were added are cut."""
    r = random.Random(8)
    lengths = [r.randint(1, 900) for _ in range(400)]
    windows = packing.pack(lengths, 1000)
    least = -(-sum(lengths) // 1000)
    rose = len(packing.balanced(lengths, 1000))
    assert rose > least
    pieces = [p for w in windows for p in w]
    cut = {i for i, start, n in pieces if n < lengths[i]}
    added = sorted((sum(lengths[i] for i in w), len(w)) for w in packing.balanced(lengths, 1000))[: rose - least + 1]
    assert len(cut) <= sum(n for _, n in added)


def test_long_words_are_not_remembered():
    tokenizer = packing.WordTokenizer(PATH)
    texts = ["abc " + "x" * 5000 + " " + "y," * 300, "x" * 5000 + " abc"]
    for t, m in zip(texts * 2, tokenizer.encode_all(texts) + tokenizer.encode_all(texts)):
        assert m.tolist() == library().encode(t, add_special_tokens=False).ids + [1]
    assert max(map(len, tokenizer._known)) <= packing.LONG


def test_very_long_texts(make):
    docs = [(1, "word and word, " * 60_000), (2, "x" * 300_000), (3, "é1 " * 50_000 + "中"), (4, None)]
    sizes = check(packing.pack_documents(make([(i, t, "en", "a") for i, t in docs])).collect(), docs)
    assert sum(2048 - n for n in sizes if n & (n - 1)) == 0


def test_cut_windows_are_full():
    r = random.Random(3)
    for _ in range(200):
        lengths = [r.choice([1, 5, 64, 200, r.randint(1, 300)]) for _ in range(r.randint(0, 40))]
        windows = packing.pack(lengths, 64)
        assert all(sum(p[2] for p in w) == 64 for w in windows[:-1])
        seen = [set() for _ in lengths]
        for w in windows:
            for i, start, n in w:
                own = set(range(start, start + n))
                assert n > 0 and not own & seen[i]
                seen[i] |= own
        assert [len(s) for s in seen] == lengths


def test_powers():
    parts = packing.powers([(0, 10, 700), (1, 0, 313)])
    assert [sum(p[2] for p in w) for w in parts] == [512, 256, 128, 64, 32, 16, 4, 1]


def check(rows, docs):
    """rows against documents (id, text); ids must be unique."""
    ids = {i: np.array(library().encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, v in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(v)
    sizes = []
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        sizes.append(at)
    return sizes


def test_pieces_cover_documents_without_padding(make):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 8)))
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 30, 900, 6000])))) for i in range(60)]
    rows = packing.pack_documents(make([(i, t, "en", "a") for i, t in docs])).collect()
    sizes = check(rows, docs)
    assert sum(2048 - n for n in sizes if n & (n - 1)) == 0


def test_groups_follow_on(make, monkeypatch):
    monkeypatch.setattr(packing, "WINDOWS", 1)
    docs = [(i, f"word{i} " * (i * 7 % 900)) for i in range(300)]
    check(packing.pack_documents(make([(i, t, "en", "a") for i, t in docs]).coalesce(1)).collect(), docs)


def test_ids_agree_with_the_library():
    r = random.Random(5)
    alphabet = [chr(i) for i in range(256)] + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "ς", "中", "é", " ", "  ", "\n"] * 4
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    mine = packing.load(PATH).encode_all(texts)
    for t, m, e in zip(texts, mine, library().encode_batch(texts, add_special_tokens=False)):
        assert m.tolist() == e.ids + [1], t


def test_odd_rows(odd, none):
    rows = packing.pack_documents(odd).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    n = lambda t: len(library().encode(t or "", add_special_tokens=False).ids) + 1
    want = {}
    for r in odd.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + n(r["text"])
    assert got == want
    assert packing.pack_documents(none).count() == 0


def test_ids_can_be_asked_for(make):
    row = packing.pack_documents(make([(1, "hello world", "en", "a")]), with_ids=True).collect()
    assert [i for r in sorted(row, key=lambda r: r["start"]) for i in r["ids"]][-1] == 1


def test_many_tiny_documents_take_little_memory():
    """A group of 524,288 documents of one token each, as of empty texts, in one task."""
    import subprocess
    import sys

    code = """
import resource
from attesta.llm.packing import pack
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
windows = pack([1] * 524_288)
assert len(windows) == 256 and all(sum(n for *_, n in w) == 2048 for w in windows)
assert sorted(i for w in windows for i, *_ in w) == list(range(524_288))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout.split()[-1]) < 250


def test_bundles_hold_every_item_once():
    import random

    from attesta.llm.packing import bundles

    r = random.Random(3)
    for _ in range(50):
        lengths = [r.choice([0, 1, 3, 20, 64, 65, 500]) for _ in range(r.randint(0, 60))]
        found = bundles(lengths, 64)
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        assert all(len(b) == 1 or sum(lengths[i] for i in b) <= 64 for b in found)
