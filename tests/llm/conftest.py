import pytest

#: As in tests/conftest.py: in a run of all tests this file bears its name.
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated
    rows, one id with two texts."""
    long_text = " ".join(f"word{i % 700} of the {i % 13}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat and the dog ran\nsecond line here\nthird line here", "en", "a", 10),
            (2, "the cat sat on the mat and the dog ran\nsecond line here\nthird line here", "en", "a", 10),
            (2, "another text under the same id", "en", None, 10), (3, None, "en", "b", None), (4, "", "fr", "b", 0),
            (5, "  \n\t ", None, "b", 5), (None, "le chat est sur la table et le chien court", "fr", "c", 9),
            (6, long_text, "en", "c", 1), (7, "le chat est sur la table et le chien court", "fr", None, 9),
            (8, "123 456 !!", None, None, 3), (7, "le chat est sur la table et le chien court", "fr", None, 9),
            (9, "\U0001f600 café naïve 中文", "fr", "d", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with names that the operators use themselves or return."""
    from pyspark.sql import functions as F
    names = ["_row", "_k1", "_k2", "_n", "_r", "_s", "_size", "_rank", "_source", "_id", "_pos", "key", "bucket", "fp", "shard",
             "size", "target", "copies", "blob", "spans", "rule_version", "length", "start", "n_words", "kept", "lang_pred", "lang_score",
             "n_paragraphs", "licences", "component_id", "_t", "_l", "id", "gram", "n", "a.b", "two words"]
    return odd.select("*", *[F.lit("x").alias(c) for c in names])
