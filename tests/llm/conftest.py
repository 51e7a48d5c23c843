import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty, blank, very long, tied and repeated texts, and columns whose names clash with what operators add."""
    long = " ".join(f"w{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, "one two three", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "fr"), (5, long, "en"), (6, long + " end", "en"), (7, "one two three", "de"), (7, "one two three", "de"), (8, f"a {passage} b", None), (9, f"c {passage} d", "en"),
        (None, f"{passage}", "en"), (None, None, None), (10, "é 日本  x\x85y \x1c z 🎉", "ja"), (11, "x" * 50_000, "en"), (12, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en"), (7, "another text under the same id", "en"),
    ]
    return spark.createDataFrame([(*r, 5, "s", 1.5, 7, "k", 3, 0) for r in rows], "doc_id long, text string, lang string, length int, source string, score double, ordinal int, `key` string, n int, shard int")


@pytest.fixture
def none(odd):
    return odd.where("false")
