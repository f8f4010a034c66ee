import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of (doc_id, text) rows with extra columns whose names clash with results."""

    def make(rows):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("KEPT", T.StringType()), T.StructField("copy", T.StringType()), T.StructField("ids", T.StringType())]
        )
        return spark.createDataFrame([(i, t, "src0" if (i or 0) % 2 else None, "x", None, "y") for i, t in rows], schema)

    return make


#: Nulls, empty and blank texts, repeated rows, ties, odd white space, a long text.
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j.\nIt was a good day, and all went well there."),
    (5, "a b c d e f g h i j.\nIt was a good day, and all went well there."), (None, "no id at all, but a text that is long enough to be kept here."),
    (6, "x\x1cy \xa0z  two  spaces\r\nend É中文 don't!"), (7, "word " * 30_000), (8, "CLICK!! HERE!! NOW!! AND!! WIN!! A!! PRIZE!! TODAY!! FOR!! FREE!!"),
]
