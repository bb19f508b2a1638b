import pytest

#: Rows that every operator must bear: nulls, empty and blank texts, ties, repeats, a long text, extra columns.
PROSE = (
    "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions near the old stone bridge and "
    "nobody in the village below notices that the river has changed its colour twice since the early morning bells rang "
    "out across fields where farmers were cutting hay before the storm that everyone expected finally arrived at noon. "
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, extra int"


def odd_rows():
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "word", "en", None), (5, PROSE, "en", "a"),
        (5, PROSE, "en", "a"), (None, PROSE, None, "b"), (6, PROSE * 300, "en", "b"), (7, "x" * 50_000, "de", "b"),
        (8, "naïve 😀 façade " * 40, "fr", "c"), (9, "... !!! ???", "fr", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "clash", 1.0, 7) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """Whole small table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
