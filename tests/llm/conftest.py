import pytest

SF = "/root/testdata/sf0.001"
VOCABULARY = "word_bpe_49k.json"
LONG = "never ending story " * 20_000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (None, "words without an id are words as well"), (4, "Hello hello world foo"),
    (4, "Hello hello world foo"), (5, LONG), (6, "One two three four five six seven eight"),
    (7, "one TWO three four five six seven eight"), (8, "ab \x01 cd  \U0001f600 ef"), (9, "ß É 日本 x"),
]


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators also use."""

    def make(rows):
        full = [(i, t, "en", "s", 0, "x", 1, 2, "k") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, key string, row long, shard long, "
            "_words string"
        )

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(ROWS).coalesce(2)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
