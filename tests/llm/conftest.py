import pytest

LONG = "word " * 30_000 + "aé日b" * 5_000

#: nulls, empty and very long texts, ties, repeated rows; extra columns with clashing names
EDGE_ROWS = [
    (1, "The cat sat on the mat and the dog ran off.", "en", "a", 43, 1.0, "x"),
    (2, "The cat sat on the mat and the dog ran off.", "en", "a", 43, 2.0, None),
    (2, "The cat sat on the mat and the dog ran off.", "en", "a", 43, 2.0, None),
    (3, None, None, None, None, None, None),
    (4, "", "fr", "b", 0, None, "y"),
    (5, " \t\n ", "fr", "b", 4, None, "y"),
    (None, "no id here", "en", None, 10, 0.0, "z"),
    (None, None, None, "c", None, None, None),
    (6, LONG, "en", "a", None, 5.0, "long"),
    (7, "12345 !!! ???", "en", "c", 13, 5.0, "marks"),
    (8, "le chat est dans la maison et il dort", "fr", "c", 37, 5.0, "fr"),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
CLASHING = ["ids", "decoded", "copy", "order_key", "id", "label", "weight", "component", "n", "v", "g", "fingerprint",
            "n_tokens", "lang_pred", "spans", "grams", "numbers", "u", "m", "vector", "c", "k"]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/labels.parquet")
