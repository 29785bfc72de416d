import pytest

AWKWARD = [
    (1, "One line here\nand a second one\nand the third line\nand a last one of the text", "en", "a", 1),
    (2, "One line here\nand a second one\nand the third line\nand a last one of the text", "en", "a", 1),
    (2, "One line here\nand a second one\nand the third line\nand a last one of the text", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "de", None, 0),
    (5, "word", None, "b", 4),
    (6, " \t\r\n \x0b ", "fr", "b", 6),
    (7, "été Ünï çödé ✓ 漢字かな \x00 zero", "fr", "b", 2),
    (None, "A text without an id, of a few words only, and nothing more to it", "en", "c", 3),
    (8, "long " * 20000 + "end", "en", "c", 100003),
    (9, "x" * 60000, None, "c", 60000),
    (10, "Released under the MIT License. MIT license, mit-license! Licensed under CC BY-NC 4.0.", "en", "c", 1),
    (11, "#### $$$ %%% line\n#### $$$ %%% line\n\n\n\n\n\n", "en", "c", 1),
]
#: Columns whose names the operators use inside or return.
CLASHING = ["key", "node", "row", "mark", "lines", "ids", "decoded", "kept", "n_words", "stratum", "comp", "slice", "score", "id", "found"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, an id twice, clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """Real documents, with a null text and an empty one."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
