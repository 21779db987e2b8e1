import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators might use inside, under names that clash with theirs.
CLASHES = ("id", "mark", "n", "row", "key", "seed", "size", "spans", "kept", "fp", "part", "rank", "words")


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Straße", "élan", "ñandú", "日本", "don't", "x,y.", "ÀB"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(40):
        rows.append((i, text(rng.randint(1, 200)) + "\n" + text(30), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    rows += [(100 + i, f"{text(20)} {passage} {text(15)}", "en", "a") for i in range(4)]
    rows += [(110 + i, rows[3][1], "en", "b") for i in range(3)]  # exact copies
    rows += [(120 + i, rows[5][1].replace("w1 ", f"z{i} "), "en", "b") for i in range(3)]  # near copies
    rows += [(130, None, None, None), (131, "", "en", "a"), (132, " \t\n", "en", "a"), (133, "one", "en", "a"), (134, "a\tb\vc d e\x85f", "en", "a"), (135, "word " * 3000, "en", "b")]
    rows += [(136, "\n".join(["same line here"] * 30) + "\n" + text(40), "en", "a"), (137, "it's <|endoftext|> [INST] \\ ok", "en", "c")]
    rows += [(139, text(70), "en", "a")] * 2 + [(139, passage + " " + passage, "en", "a"), (None, passage, "en", "a"), (None, None, None, None)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
