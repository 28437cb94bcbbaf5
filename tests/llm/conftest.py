import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, kept string, shard string, fp string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, columns that clash."""
    long = "word " * 30_000 + "x" * 20_000
    rows = [
        (1, None, None, None, None), (None, "a b c", "en", "s0", 5), (2, "", "en", "s0", 0), (3, long, "en", None, len(long)), (4, "a b c", "de", "s1", 5),
        (4, "a b c", "de", "s1", 5), (5, "a b c", None, "s1", 5), (6, " \t\n ", "fr", "s2", 4), (7, "1 2 3 %% 　 \U0001f600", "en", "s2", 9), (8, "A\nB\n\nA\nB", "es", "s0", 8),
        (9, "x<|endoftext|>y  z", "en", "s0", 17), (None, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
