import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use inside, as extra columns of their input.
CLASHING = ("key", "sid", "part", "bucket", "seed", "spans", "rest", "toxic", "weight", "n", "length")


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs or (doc_id, text, lang) triples, with clashing extra columns."""

    def make(rows, clashing=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            for name in CLASHING:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


def known(key):
    """A key that sorts, in place of null."""
    return -1 if key is None else key


def words(random, n, vocabulary=2000, prefix="w"):
    return [f"{prefix}{random.randrange(vocabulary)}" for _ in range(n)]


#: Empty, null, blank, tiny and odd texts that every operator must take.
ODD = [
    (900, None),
    (901, ""),
    (902, " \t\n "),
    (903, "a"),
    (904, "é中😀 ▁ \x00\x1f"),
    (None, "a row without a key"),
    (905, "same text here"),
    (906, "same text here"),
    (907, "twice the same row"),
    (907, "twice the same row"),
    (908, "x" * 5000),
]
