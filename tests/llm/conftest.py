import pytest

from barloom.session import cut

LONG = " ".join(f"palabra{i % 97} der{i % 13}" for i in range(30_000))


def prose(i, n=60):
    """Deterministic words, different for every i."""
    return " ".join(f"w{(i * 7919 + j * j * 31) % 1009}x{(i + j) % 7}" for j in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows and columns named like results."""
    base = prose(1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " " + base.replace(" ", "\n") + "\t", "en", None),
        (4, None, None, None), (None, prose(4), "de", "b"), (None, None, None, None), (5, "", "en", "b"), (6, "   \n\t ", "en", "c"),
        (7, "12345 !!", "en", "c"), (8, LONG, "de", "c"), (9, base + " extra", None, "a"), (10, prose(10), "de", "b"),
        (11, "Ünïcödé — ÄÖÜ " + prose(11), "de", "\U0001f600"), (12, "one two", "en", "a"), (13, "One TWO", "en", "b"),
    ]
    rows = [(*r, 10 * k, "x", "y") for k, r in enumerate(rows)]
    return cut(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int, fp string, shard string"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return cut(odd_docs.limit(0))


@pytest.fixture(scope="session")
def odd_benchmark(spark):
    item = " ".join(prose(10).split()[5:30])
    rows = [(1, item), (1, item), (None, "One  two!"), (3, None), (4, ""), (5, "nowhere to be found at all"), (6, "palabra5 der5 palabra6 der6")]
    return cut(spark.createDataFrame(rows, "item_id bigint, text string"))
