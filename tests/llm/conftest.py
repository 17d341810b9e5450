import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def make_words(seed, n, vocabulary=900):
    r = random.Random(seed)
    return ["w%x" % (r.randrange(vocabulary) * 7919) for _ in range(n)]


def text_rows():
    """Documents with nulls, empty and long texts, ties, exact and near copies and repeated rows."""
    base = make_words(1, 120)
    near = list(base)
    near[60] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, "one"), (7, "One two"),
            (8, " \t\n "), (9, "one"), (10, " ".join(make_words(2, 6000))), (11, "x" * 3000),
            (12, " ".join(make_words(3, 200))), (12, " ".join(make_words(3, 200))), (13, " ".join(make_words(4, 80))),
            (13, " ".join(make_words(5, 80))), (None, " ".join(make_words(6, 60))), (None, None),
            (14, "éß 中文 \U0001f600 end."), (15, " ".join(make_words(7, 40) + base[:60]))]
    rows += [(20 + i, " ".join(make_words(100 + i, 30 + i))) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def llm(spark):
    from tabloom.llm.common import prepare
    return prepare(spark)


@pytest.fixture(scope="session")
def docs(llm):
    rows = [(i, t, "en", f"s{n % 3}", len(t) if t is not None else None) for n, (i, t) in enumerate(text_rows())]
    return llm.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The same rows with more columns, whose names clash with those the operators make."""
    from pyspark.sql import functions as F
    extra = ["score", "N_Bytes", "kept", "digest", "redacted", "tox_score", "shard", "row", "bands", "rank", "x"]
    out = docs
    for i, c in enumerate(extra):
        out = out.withColumn(c, F.lit(i) if i % 2 else F.lit(None).cast("string"))
    return out
