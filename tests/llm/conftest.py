import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark string, removed string, x int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, ids that repeat, and extra columns with clashing names."""
    words = [f"word{i}" for i in range(3000)]
    base = " ".join(words[:300])
    rows = [
        (1, base),
        (2, base),
        (3, base.replace("word7 ", "other ")),
        (4, None),
        (5, ""),
        (5, ""),
        (6, " \n \n"),
        (7, " ".join(words) * 4),
        (8, "short text here"),
        (8, "another text of the same id"),
        (9, "é漢字 ünï  code — “quoted”\nline two of it\nline two of it"),
        (None, "no id at all but some words in it"),
        (10, "aaaa" * 200),
        (11, "the quick brown fox jumps over the lazy dog again and again today\n" + base),
    ]
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 7, "m", "r", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
