import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and
    columns whose names clash with the operators' own."""
    rng = random.Random(3)
    words = [a + b for a in ("the", "an", "er", "ti", "ou", "st") for b in ("on", "ing", "ed", "es", "at", "or", "ly")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = prose(60)
    rows = [(1, same, "en", "a", 5), (2, same, "en", "a", 5), (3, same + " tail", "en", "b", 5), (4, None, None, None, None), (5, "", "en", "a", 0), (None, "no id here", "fr", "a", 3), (7, "  \n\t ", "fr", None, 3), (8, prose(9000), "en", "c", 9), (9, "é à ü ß 漢字 <|endoftext|> x", "de", "c", 9), (9, "é à ü ß 漢字 <|endoftext|> x", "de", "c", 9), (-3, "x" * 3000, "es", "c", 3), (11, "123 !!! ...", "es", "d", 3)]
    rows += [(100 + k, prose(40), "en", "a", 1) for k in range(30)]
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, SCHEMA)
    return base.withColumns({"id": F.lit("clash"), "fp": F.lit(1), "score": F.lit(2.0), "rank": F.lit(3), "batch": F.lit("b")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def all_plain(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
