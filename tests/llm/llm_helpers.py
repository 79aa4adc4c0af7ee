"""Small document tables with the awkward rows every operator has to take."""

import random

from pyspark.sql import types as T

# Columns that operators use inside, given to documents to see that they do not clash.
CLASHING = ("vertex", "key", "row", "score", "rate", "token", "u", "v", "n", "spans", "label", "turn")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
AWKWARD = [None, "", " \t\n", "a", "A", "é ß\x85ñ", " ", "word " * 3000]


def table(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(*r, None)[:3] + ("x",) * len(CLASHING) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(w if rng.random() > share else f"e{rng.randrange(999)}" for w in text.split())
