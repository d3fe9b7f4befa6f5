import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """documents with everything that may go wrong: nulls, empty and long texts, repeats, odd characters."""
    long = "the quick brown fox of that town and its dog was here for the night with it " * 4000
    clean = "the river was wide and the boat that it held was of old wood and for the most part dry when he stood on it "
    data = [
        (1, clean, "en", "src1", len(clean)), (2, clean, "en", "src1", len(clean)), (2, clean, "en", "src1", len(clean)), (3, clean.upper(), "en", "src1", 5),
        (4, None, "en", "src1", None), (5, "", None, None, 0), (6, " \n\t ", "xx", "src2", 4), (None, clean + "token = \"4534254f83b7e27b3670756d7cab6da61ccfcea9\"", None, "src0", 9),
        (None, None, None, None, None), (7, long, "en", "src0", len(long)), (8, long + "x", "en", "src0", len(long) + 1), (9, "x", "de", "", 1), (10, "\U0001f600 é  ", "fr", "7", 5),
        (11, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "en", "src5", 60),
    ]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(hard):
    """Extra columns under names that operators use in what they return or inside."""
    from pyspark.sql import functions as F

    names = ["id", "n", "key", "h", "f", "a", "b", "w", "rep", "bands", "tokens", "budget", "piece", "rank", "count", "license", "name", "start", "score", "root", "duplicate_of", "bin_id", "n_tokens", "epoch", "domain", "n_words", "p", "hashes", "elements", "h1", "h2"]
    return hard.withColumns({c: F.lit(f"clash-{c}") for c in names})
