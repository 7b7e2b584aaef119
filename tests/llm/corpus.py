"""Small document tables with the odd cases in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, **extra):
    """rows: (doc_id, text[, lang[, source]]). Extra columns get one value in every row."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    from pyspark.sql import functions as F

    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, a shared passage, a periodic text, repeated rows and ids."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 120), sentence(rng, 30)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 8):
        far[i] = f"x{i}"
    rows = [
        (10, base, "en", "a"), (11, base, "en", "b"), (12, " ".join(near), "en", "a"), (13, " ".join(far), "en", "c"),
        (14, base.replace(" ", "\n\t ").upper(), "en", "a"), (20, None, None, None), (21, "", "en", "a"), (22, " \t\n ", None, "b"),
        (23, "one", "fr", "b"), (24, "one", "fr", "b"), (25, "Zwölf Boxkämpfer, jagen! Viktor", "de", "ü"), (26, "日本語 のテキスト です", "ja", "日"),
        (30, sentence(rng, 40) + " " + passage, "en", "a"), (31, passage + " " + sentence(rng, 25), "fr", "a"), (32, sentence(rng, 10) + " " + passage + "\n" + sentence(rng, 10), "fr", "c"),
        (40, "a b c d e " * 30, "en", "c"), (41, sentence(rng, 30_000, 5_000), "en", "a"), (42, "x" * 200_000, "en", "a"),
        (None, base, "en", "a"), (None, sentence(rng, 50), "de", None), (50, sentence(rng, 22), "en", "a"), (50, sentence(rng, 22), "en", "a"),
    ]
    again = (51, sentence(rng, 60), "en", "b")
    return [*rows, again, again, again]
