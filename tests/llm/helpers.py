"""Small tables for the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, kept boolean, ids string, leak string, size string, n long"


def documents(spark, texts, extra: bool = False):
    """Documents 0, 1, ... with the given texts (or (doc_id, text) pairs); ``extra`` adds columns whose names clash."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    if extra:
        return spark.createDataFrame([r + (0.5, None, "x", "y", "z", 1) for r in rows], SCHEMA + EXTRA)
    return spark.createDataFrame(rows, SCHEMA)


def written(spark, df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


ODD = [None, "", " ", "\t\n", "a", "A a A a", "é" * 30, "x" * 5000, "word " * 3000, "same text here", "same text here", "same  text here", " wide space", "🙂 smile 🙂"]
