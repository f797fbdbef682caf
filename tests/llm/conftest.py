import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("key", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("fp", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("uid", T.IntegerType()),
])


def texts() -> list[str | None]:
    """Prose with copies, near copies, shared passages, repeats, symbols, empty and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = prose(60), prose(25)
    out: list[str | None] = [None, "", "   \n\t ", "word", "Two words", "x" * 3000, "\u00a0 \u2003", "a\u0085b c"]
    for i in range(60):
        body = prose(rng.randint(3, 150))
        if i % 3 == 0:
            body = f"{prose(12)} {passage} {body}"
        if i % 4 == 0:
            body = f"{body}\n{other}"
        if i % 10 == 0:
            body = f"{body}\r\n{body}\n{body.upper()}"
        if i % 7 == 0:
            body = "### $$$ " + body.replace(" ", " *** ")
        out.append(body)
    out += [out[20], out[20], out[21], out[22] + " tail", "Tail " + (out[22] or ""), (prose(40) + "\n") * 30, prose(9000), "the same word " * 400]
    return out


def rows(shift: int = 0) -> list[tuple]:
    found = [(i + shift, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t or ""), "k", 1, "f", 2, 3) for i, t in enumerate(texts())]
    found.append((None, "a text without an id", "en", "a", 0, None, None, None, None, None))
    found.append((3, "another text with this id and some more words to say", "en", "a", 0, None, None, None, None, None))
    return [*found, found[10], found[30]]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
