import pytest

#: Odd rows: null and empty texts, copies, repeated rows, a null id, odd white space, one long text, marks of special tokens.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog", "b"), (2, "the QUICK brown fox jumps over the lazy dog", "b"), (3, None, None), (4, "", "a"), (5, " \t\n ", "a"), (6, "one", "a"),
    (7, "  two  spaces and\tnbsp \n\n end ", "c"), (8, "word " * 5000, "b"), (9, "don't <|endoftext|> 123 été 你好 🙂", "c"), (10, "The quick brown fox jumps over the lazy dog", "a"),
    (10, "The quick brown fox jumps over the lazy dog", "a"), (None, "no id here at all", "c"), (12, "a b c d e f g h", None), (13, "a b c d e f g h", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", s, len(t or ""), 5, "x", 1.5) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `size` int, `key` string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
