import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])

#: Texts every operator must take: null, empty, blank, short, long, other scripts, control characters.
EDGE_TEXTS = [None, "", " \t\n", "a", "the  the\nthe the", "word " * 5000, "x" * 20000, "café ΔΣ 你好 \U0001f600 don't <|endoftext|> 12½",
              "\x00\x1c\x7f", "line\nline\n\nline", "One two three four five six seven eight nine ten eleven.", "One two three four five six seven eight nine ten eleven."]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts; repeated rows, null ids, languages and sources, extra columns with names used inside."""
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(EDGE_TEXTS)]
    rows += [rows[10], rows[5], (None, "no id", None, None, 5), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("size", "row", "ids", "fp", "key", "kept", "copies", "score"):
        frame = frame.withColumn(name, frame["doc_id"])
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
