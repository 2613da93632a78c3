import pytest

LONG = "lorem ipsum dolor sit amet " * 9000 + "x" * 50_000
#: Nulls in any column, empty and very long texts, ties and repeated rows, and columns whose names clash with those the operators use.
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", 1, "a"),
    (1, "one two three four five six seven eight nine ten eleven", 1, "a"),
    (2, None, None, None),
    (3, "", 3, "b"),
    (None, "text without an id stands here", 4, "c"),
    (None, None, None, None),
    (4, " \n\t ", 5, "d"),
    (5, LONG, 6, "e"),
    (6, "é😀 ünïcode a@b.co +1 (555) 555-0100 10.0.0.1", 7, "f"),
    (7, "word", 7, "g"),
    (8, "one two three four five six seven eight nine ten twelve", 7, "g"),
]
CLASHING = "doc_id long, text string, count long, key string"
SCHEMA = f"{CLASHING}, rep long, spans string, row_key long, size long, length long, shard int, n_words string, _x string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, r[2], r[3], r[2], r[2], r[2], 1, "z", None) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
