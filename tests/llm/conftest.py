import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names the operators use themselves."""

    def make(rows, clash=True):
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clash:
            for name in ("size", "__text", "keep_id", "node", "rank", "id", "lang_pred", "score", "draws", "__times", "cell"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit(f"extra {name}"))
        return df

    return make


#: Nulls, empty and blank texts, ties, repeated rows, odd characters, long texts.
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\v\f\r", "en", "a"),
    (4, "one two three four five six", "en", "a"),
    (5, "one two three four five six", "en", None),
    (5, "one two three four five six", "en", None),
    (6, "one  two\nthree four five six ", "en", "b"),
    (None, "a row without id", None, "b"),
    (7, "é ▁ \u00a0 🙂 <s> \x00 <0x41> ﬁ", "fr", "b"),
    (8, "x" * 30_000, None, "c"),
    (9, "long words of a text " * 3_000, "en", "c"),
    (10, "12 34 -- !", "en", "c"),
    (-11, "negative ids are ids", "en", "\U0001f642"),
]
