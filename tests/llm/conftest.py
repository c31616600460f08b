import pytest

from attesta.llm.common import ship

#: A documents table with the columns that operators use inside, as extra ones.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, t string, fp long, "
    "bucket int, score string, lang_pred int, _row string, shard string, start int"
)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text, lang, source) as a documents table with clashing extra columns."""

    def build(rows):
        full = [
            (i, t, lang, src, None if t is None else len(t), "x", 7, 1, "s", 3, "r", "q", 5)
            for i, t, lang, src in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls everywhere, empty and long texts, ties and repeated rows."""
    words = "the quick brown fox jumps over the lazy dog and runs away from here "
    long = words * 3000
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t", "en", "a"), (4, words, "en", None),
        (4, words, "en", None), (5, words, "fr", "b"), (None, words, "en", "a"), (None, None, None, None),
        (None, "no id here", None, "a"), (6, long, "en", "a"), (7, "a" * 500, "de", "c"), (8, "!!! 123", "en", "a"),
        (9, "été à la plage où l'on mange <|endoftext|> bien", "fr", "b"), (10, "x", "es", "c"),
        (11, "\x00\x1c null \x85 byte", "en", "a"), (12, "日本語 のテキスト", None, "c"), (-3, long[:100], "en", "a"),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def none(make):
    return make([(1, "x", "en", "a")]).filter("doc_id = 2")
