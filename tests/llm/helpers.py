"""Small inputs and plain Python versions the operators are held against."""

from __future__ import annotations

import random

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents from (id, text) pairs, with columns whose names operators also use inside."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    return table.withColumns({"id": F.lit("x"), "row": F.lit(1), "n": F.lit(2), "span": F.lit("y"), "start": F.lit(0)})


def words(text):
    return (text or "").encode().split()


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def awkward():
    """Null and empty texts, a null id, repeated rows, one id with two texts, a long text."""
    long = prose(99, 6_000)
    return [
        (900, None),
        (901, ""),
        (902, " \t\n "),
        (903, "one"),
        (904, "é ß 漢字 😀"),
        (None, prose(5, 70)),
        (905, prose(6, 80)),
        (905, prose(6, 80)),
        (906, prose(7, 60)),
        (906, prose(8, 60)),
        (907, long),
        (908, long + " end"),
    ]
