import hashlib
import json
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, token_counts

PATH = bpe.default_path()
ALPHABET = [
    "a", "b", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "中", "😀", "'s", "'LL", "'re", "'",
    "<|endoftext|>", "<|endo", "ftext|>", "1", "²", "٣", "́", "__", "!!", "aaaa", "\x00", "Ⅷ", "İ", "Σ",
]


@pytest.fixture(scope="module")
def library():
    return _library()


@pytest.fixture(scope="module")
def mine():
    return bpe.load(None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_ids_and_text_agree_with_the_library(text):
    library, mine = _library(), bpe.load(None)
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == ids
    assert mine.decode(ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


@lru_cache
def _library():
    return Tokenizer.from_file(PATH)


def test_every_token_that_its_bytes_encode_to(mine, library):
    with open(PATH, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    own = random.Random(1).sample(list(vocab.values()), 3000)
    texts = [library.decode([i], skip_special_tokens=False) for i in own]
    for t in texts:
        assert mine.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_backtracking_takes_tokens_back(mine):
    # plain longest matches would be wrong for many of these
    r = random.Random(3)
    for _ in range(3000):
        piece = "".join(r.choice("abcdeginorst") for _ in range(r.randint(1, 25)))
        assert mine.encode_piece(piece.encode()) == _library().encode(piece, add_special_tokens=False).ids


def test_parts_of_characters_decode_as_the_library_does(mine):
    ids = _library().encode("中文😀é", add_special_tokens=False).ids
    for i in range(len(ids)):
        assert mine.decode(ids[i:]).decode("utf-8", "replace") == _library().decode(ids[i:], skip_special_tokens=False)


def test_query_digests(odd, none):
    want = {}
    for r in odd.collect():
        ids = _library().encode(r["text"] or "", add_special_tokens=False).ids
        back = _library().decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids)] = (
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
        )
    got = bpe.round_trip_digests(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert want[r["doc_id"], r["n_tokens"]] == (r["ids_sha256"], r["decoded_sha256"])
    assert bpe.round_trip_digests(none).count() == 0


def test_operators_round_trip(odd):
    back = bpe.decode(bpe.encode(odd))
    key = lambda df: sorted((r[0] is None, r[0] or 0, r[1] or "") for r in df.collect())
    assert key(back) == key(odd.select("doc_id", "text"))


def test_edits_are_counted_as_a_new_count_would(mine):
    r = random.Random(2)
    small = [*ALPHABET, "x", " and", "word "]
    for _ in range(400):
        tree = token_counts.TokenTree("".join(r.choice(small) for _ in range(r.choice([0, 3, 20, 600]))), mine)
        assert tree.tokens == len(mine.encode(tree.text))
        for _ in range(r.randint(1, 8)):
            n = len(tree.text)
            start = r.randint(0, n)
            stop = min(n, start + r.choice([0, 0, 1, 5, 40, 300]))
            new = "".join(r.choice(small) for _ in range(r.choice([0, 1, 3, 30])))
            want = tree.text[:start] + new + tree.text[stop:]
            tree.edit(start, stop, new)
            assert tree.text == want and tree.tokens == len(mine.encode(want))


def test_edits_encode_little_anew(mine):
    text = "some plain words here, over and over again. " * 2000
    tree = token_counts.TokenTree(text, mine)
    tree.edit(40_000, 40_003, "xyz")
    assert tree.reencoded < 100 and tree.tokens == len(mine.encode(tree.text))


def test_growing_leaves_are_planted_anew(mine):
    tree = token_counts.TokenTree("a b", mine)
    for i in range(300):
        tree.edit(len(tree.text) // 2, len(tree.text) // 2, f" word{i} and more of it")
    assert tree.tokens == len(mine.encode(tree.text))


def test_edited_counts_query(odd, none):
    got = token_counts.edited_counts(odd, token_counts.sample_edits()).collect()
    assert len(got) == odd.count()
    rows = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    edits = odd.filter("doc_id is not null").select("doc_id", token_counts.sample_edits().alias("e")).collect()
    for r in edits:
        text = texts[r["doc_id"]]
        before = len(_library().encode(text, add_special_tokens=False).ids)
        for e in r["e"]:
            at = min(e["start"], len(text))
            text = text[:at] + e["text"] + text[max(at, min(e["stop"], len(text))) :]
        after = len(_library().encode(text, add_special_tokens=False).ids)
        x = rows[r["doc_id"]]
        assert (x["n_tokens"], x["n_tokens_edited"], x["n_chars_edited"], x["n_edits"]) == (before, after, len(text), 3)
    assert token_counts.edited_counts(none, token_counts.sample_edits()).count() == 0


def test_null_edits_change_nothing(odd):
    got = token_counts.edited_counts(odd, F.lit(None)).collect()
    assert all(r["n_tokens"] == r["n_tokens_edited"] and r["n_edits"] == 0 for r in got)


def test_decoding_ignores_ids_beyond_the_table(mine):
    assert mine.decode(np.array([-1, 10**6])) == b""
