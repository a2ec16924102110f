from __future__ import annotations

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ta", "ko", "mi", "ru", "se", "lo", "va", "ne") for b in ("n", "r", "st", "lle", "ding", "m", "ks", "per")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS))
        if i % 9 == 8:
            out[-1] += ".\n" if i % 27 == 26 else "."
    return " ".join(out).replace("\n ", "\n")


def documents(spark, texts, start=0):
    """A documents table with further columns whose names operators use inside."""
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("t", "p", "s", "n", "base", "added", "words", "length", "piece", "w", "score", "n_words", "rate", "copies", "root", "_x")
    return frame.withColumns({c: F.lit(f"extra {c}") for c in clash})


AWKWARD = [None, "", "   \n ", "one", "one", "Ünï çødé 😀 words", "x" * 5000, "a b c d e", "A B C D E", "- . !", prose(1, 3000), prose(1, 3000)]


def every_row(spark, frame, n):
    rows = frame.collect()
    assert len(rows) == n
    return {r["doc_id"]: r for r in rows}
