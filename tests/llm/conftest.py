import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, words long, `key` int, label int"
LONG = "äöü ßab " * 40_000


@pytest.fixture(scope="session")
def odd_texts():
    """Texts at the edges, with ties and repeats."""
    return [
        (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n "), (5, "one two three four five six"),
        (6, LONG), (7, LONG), (None, "no key"), (None, "no key"), (8, "x"), (8, "x"), (9, "One  two\nthree four\tfive six"),
        (10, "emoji 🙂 and ſ K İ  \x1c  end"), (11, "a\r\nb\r\n\r\n  c  "), (12, "password"), (13, "\x00 nul"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with extra columns, some of them named like columns the operators use inside."""
    rows = [(i, t, None, "s", None, "r", 1, 2, 3) for i, t in odd_texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
