import pytest

LONG = " ".join(f"w{i % 977}x" for i in range(12_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs into the deep green forest again", "en", "a", 0),
    (2, "The quick brown fox jumps over the lazy dog and runs into the deep green forest again", "en", "a", 0),
    (2, "The quick brown fox jumps over the lazy dog and runs into the deep green forest again", "en", "a", 0),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "Released under the MIT License. MIT license, Apache License; GNU General Public License", "fr", "a", 0),
    (5, "   \t\n  ", "de", "b", 0),
    (6, LONG, "en", "b", 0),
    (7, "  a  b   c\td▁e <s> </s> ﬁ Ａ ​\n\nÉÀ  MIT LICENSE", "fr", None, 0),
    (8, "one", None, "c", 0),
    (9, "x" * 5000, "en", "a", 0),
    (10, "漢字" * 300 + " mit license mit license", "zh", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows; columns that clash with added ones."""
    added = "_row _id _part id key fp size shard slot n_tokens epoch block weight score spans host tokens a b".split()
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", *[f"'{c}' as `{c}`" for c in added])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog and runs"), (2, "one"), (3, ""), (None, "lazy dog and runs into the deep green forest again"), (5, None), (1, "the quick brown fox jumps over the lazy dog and runs")],
        "item_id long, text string",
    )


@pytest.fixture(scope="session")
def rows():
    return ROWS


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
