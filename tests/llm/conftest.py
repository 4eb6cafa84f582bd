import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs; further columns may be given as fields and values."""
    def build(pairs, lang="en", partitions=3, extra=()):
        schema = T.StructType(DOCUMENTS.fields + [T.StructField(n, T.StringType()) for n in extra])
        rows = [(i, t, lang, None, len(t) if t is not None else None, *("x" for _ in extra)) for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Texts that have to come through every operator."""
    return [
        (1, None), (2, ""), (3, " \n\t\n "), (4, "word"), (5, "ß" * 50), (6, "a b " * 40_000), (7, "x" * 20_000), (8, "same text here again"),
        (9, "same text here again"), (9, "same text here again"), (10, "\u0000\u0001 odd \U0001f600 𝔘𝔫𝔦\r\nline"), (None, "no id at all, still a text"), (None, None),
        (11, "it's 12 o'clock; we'll go.\n\n   Indented\tline  \n" * 3),
    ]
