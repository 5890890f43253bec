"""Small inputs shared by the tests of this folder."""

import random

SF = "/root/testdata/sf0.001"

#: Edge rows every document operator must give a defined result for.
EDGES = [
    (900, None),
    (901, ""),
    (902, " \n\t "),
    (903, "one"),
    (904, "İ ſ K naïve 日本 😀 a\x0bb"),
    (905, "the cat sat " * 3000),
    (906, "the cat sat " * 3000),
    (907, "same words here\nsame words here\n\nsame words here"),
    (907, "same words here\nsame words here\n\nsame words here"),
    (908, "x" * 50_000),
    (None, "a text without an id that is long enough to matter"),
]


def docs(spark, rows, extra=True):
    """documents-like table; ``extra`` adds columns named like internal ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("size", "rank", "n", "key", "node", "w", "quality", "secrets", "range", "ghost", "row", "ids", "lang"):
            df = df.selectExpr("*", f"'{c}' AS {c}")
    return df


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "is", "in"] + [a + b for a in ("ka", "lo", "mi", "ter", "ou") for b in ("ra", "st", "an", "el")]
    return " ".join(rng.choice(words) for _ in range(n))
