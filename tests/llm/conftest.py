import random

import pytest
from pyspark.sql import types as T

WORDS = ["the", "of", "and", "thonre", "anblew", "sttible", "onhaly", "erstor", "Eau", "ouè", "leaux", "menti", "schön", "ung", "keit", "der"]


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls in every column, empty and blank texts, one very long, copies, near copies, shared passages, repeated rows, ties."""
    passage, base = words(1, 70), words(2, 90)
    near = base[:40] + ["changed"] + base[41:]
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(base), "en", "a"),
        (3, " ".join(near), "en", None),
        (4, " ".join(base).upper().replace("È", "è").replace("Ö", "ö"), "en", "b"),
        (5, None, "en", "a"),
        (6, "", "fr", "a"),
        (7, " \t\n ", None, "b"),
        (8, "one", "en", "b"),
        (9, "one two three", "fr", "c"),
        (10, "one two three", "fr", "c"),
        (11, " ".join(words(3, 30) + passage + words(4, 40)), "en", "a"),
        (12, " ".join(words(5, 60) + passage[5:] + words(6, 10)), "de", "a"),
        (13, "\n".join(words(7, 10) + passage[:50]), "de", "b"),
        (14, "a" * 3000, None, None),
        (15, "a" * 120, "en", "c"),
        (16, " ".join(["same"] * 400), "en", "c"),
        (17, " ".join(["same"] * 130), "en", "a"),
        (18, " ".join(words(8, 20_000)), "en", "a"),
        (None, " ".join(base), "en", "a"),
        (None, " ".join(words(9, 60)), None, None),
        (19, " ".join(words(10, 80)), "en", "a"),
        (19, " ".join(words(10, 80)), "en", "a"),
        (20, "!!! 123 ???", "en", "b"),
        (21, "é" * 60 + " 日本語 " + "x" * 49, "en", "b"),
    ]
    rows += [(100 + i, " ".join(base[: 85 - i % 3] + words(200 + i, 5)), "en", "a") for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with columns whose names the operators use inside."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in ("node", "part", "size", "id", "bucket", "_row", "tokens", "score", "shard", "slot")]
    )
    return spark.createDataFrame([r + ("x",) * 10 for r in edge_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
