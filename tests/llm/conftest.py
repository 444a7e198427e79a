import pytest
from pyspark.sql import types as T

SF001 = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # extra columns with the names that operators add
        T.StructField("shard", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("ids", T.StringType()),
    ]
)

TEXTS = [
    "the cat sat on the mat and looked at the dog, then it left.",
    "the cat sat on the mat and looked at the dog, then it left.",
    "",
    None,
    "   ",
    "one",
    "Ünïcödé  with   runs of spaces\n\nand\ttabs 12,345.67 — “quotes” <|endoftext|> 's it's",
    "word " * 3000,
    "é compose ÀÉ İstanbul ΣΑΣ ﬁ ½ x² 漢字仮名 🙂🙂",
    "a" * 5000,
    "12345 !!! ...",
    "\n a\n  b  \n   c ",
]


def rows_of(texts):
    return [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def dirty(spark):
    """Nulls in every column, empty and long texts, equal texts, a repeated row, rows without an id."""
    rows = rows_of(TEXTS)
    return spark.createDataFrame([*rows, rows[0], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)], DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").toPandas()
