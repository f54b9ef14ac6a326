import pytest
from pyspark.sql import types as T

# Extra columns whose names the operators use inside.
CLASHES = ["id", "row_id", "norm", "digest", "words", "sid", "label", "key", "position", "slot", "cls", "u", "v", "rep"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHES])

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, " \t\n ", "en", "src0", 4),
    (4, "One two three four five six seven eight", "en", "src1", 39),
    (5, "one TWO three four five six seven eight", "en", "src1", 39),
    (5, "one TWO three four five six seven eight", "en", "src1", 39),  # a repeated row
    (5, "another text with the same id", "en", None, 29),
    (6, LONG, "en", "src0", len(LONG)),
    (7, LONG + " tail", "en", "src0", len(LONG) + 5),
    (None, "a row without an id, Ünï\U0001F600 世界", "de", "src2", 30),
    (None, None, None, None, None),
    (8, "MIT License\r\nx\x00y\x1f z password=hunter2hunter2", "en", "elsewhere", 40),
]


def table(spark, rows):
    return spark.createDataFrame([tuple(r) + tuple("clash" for _ in CLASHES) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, [(i, t, "en", s, len(t or "")) for i, t, s in rows])


LOWER_TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
