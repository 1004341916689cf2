import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(40)
    near = base.split()
    near[50] = "changed"
    line = "A line that some documents share, and that is long enough to matter."
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"), (4, base.replace(" ", "\t\n"), "en", "a"),
        (5, None, None, None), (6, "", "en", "a"), (7, " \n\t ", "de", "a"), (None, base, "en", "a"), (None, text(20), None, "b"),
        (8, text(10) + " " + passage + " " + text(30), "fr", "a"), (9, text(25) + " " + passage + " " + text(5), "fr", "b"),
        (10, line + "\n" + text(9), "de", "a"), (11, text(9) + "\n" + line, "de", "c"), (12, line[:-5] + "X" + line[-4:] + "\nown " + text(3), "de", "a"),
        (13, "é" * 40 + " 日本語 🎉 " + text(3), "es", "a"), (13, text(12), "es", "b"), (14, text(30_000), "en", "a"), (15, "ab" * 300, "en", "a"),
        (16, text(15), "en", "a"), (16, text(15), "en", "a"),
    ]
    rows.append(rows[-1])
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """With extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, SCHEMA).repartition(3)
    names = ["key", "kept", "did", "tie", "size", "shard", "block", "hash", "tokens", "features", "rest_", "row_", "score", "print", "root", "mark"]
    return docs.withColumns({n: F.lit("extra") for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
