import pytest

from marginalia.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture()
def odd(spark):
    """Nulls, empties, blanks, repeated rows, a long text, and columns named like those the operators add."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta\nsecond line", "en"), (1, "alpha beta gamma delta epsilon zeta\nsecond line", "en"),
        (2, None, None), (3, "", "en"), (4, "  \n\t ", "fr"), (5, long, "en"), (None, "a text without an id", None),
        (6, "alpha beta gamma delta epsilon zeta\nsecond line ", "de"), (7, "\U0001F600 ÄÖ ß 中文 1234 !!", None),
    ]
    names = "doc_id bigint, text string, lang string, score string, n_lines string, ids int, spans int, kept string, id string, body string, row string, key string, root string"
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z", "i", "b", "r", "k", "t") for r in rows], names)
