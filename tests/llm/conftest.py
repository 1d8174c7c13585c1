import random

import pytest
from pyspark.sql import types as T

#: Columns of documents, and names that the operators use inside.
CLASHES = ["_k", "_row", "_rid", "_bytes", "_db", "_turn", "_text", "_bad", "_src", "copies", "_scored", "_h", "key",
           "toxicity", "_id", "_kept"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *[f"{c}{doc_id}" for c in CLASHES])


def corpus(seed=3, n=60):
    """Rows with every odd case: nulls, blanks, copies, near copies, repeated
    rows and ids, shared passages and lines, runs, one long text."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "über", "Ñandú", "the", "The", "of"] * 10
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, line = " ".join(words(45)), "  Common LINE of more than forty code points é  " + " ".join(words(6))
    rows = []
    for i in range(n):
        w = words(rng.choice([0, 1, 2, 5, 12, 40, 80, 200]))
        if i % 5 == 0:
            w[len(w) // 2: len(w) // 2] = passage.split()
        text = " ".join(w)
        if i % 4 == 0:
            text = f"{text}\n{line if i % 8 else line.lower()}\n{text[:60]}"
        rows.append(row(i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "c", None])))
    base = " ".join(words(150))
    for i in range(n, n + 8):  # copies and near copies
        near = base.split()
        if i % 2:
            near[i % 50] = "edited"
        rows.append(row(i, " ".join(near), "en", "a"))
    more = [None, "", " ", "\n", "\t \n", "a", "A b", "x " * 120, "ab" * 200, "\x00nul \x00byte " * 9, "é" * 70,
            "one word here", " ".join(words(6000)), "\n".join([line] * 3), "# * $ % & | < >"]
    rows += [row(n + 8 + i, t, None if i % 3 else "de", None if i % 2 else "z") for i, t in enumerate(more)]
    rows += [rows[3], rows[3], rows[5], row(3, "another text of a repeated id " + passage), row(None, passage),
             row(None, passage), row(None, None), row(7, None), row(2**40, passage.upper(), "es", "b")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a table of several files."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
