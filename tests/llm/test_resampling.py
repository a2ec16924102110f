"""Importance resampling against brute force with zlib and math."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import resampling

from .helpers import AWKWARD, documents, every_row, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(texts, target, longest=1, share=10, least=20, k=10_000):
    found = {i: features(t, longest) for i, t in texts.items()}
    bucket = lambda f: zlib.crc32(f.encode()) % k
    s = Counter(bucket(f) for _, fs in found.values() for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + k) / ((s[b] + 1) * (T + k))))
    out = {}
    for i, (n, fs) in found.items():
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out[i] = [n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    may = sorted((i for i, r in out.items() if r[0] >= least), key=lambda i: (-out[i][3], i))
    for rank, i in enumerate(may[: share * len(may) // 100], 1):
        out[i][4] = rank
    return {i: tuple(r) for i, r in out.items()}


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_matches_brute_force(spark, longest):
    texts = [
        *AWKWARD, *(prose(i, 15 + i % 50) for i in range(150)), "日本語のテキスト" * 30, "word" * 3000 + " tail", "a-b_c'd\x00e\x7ff\u0080g", "É é ÀZ İ", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "😀" * 40,
        "the end\n" * 25, " " + prose(3, 30), prose(5, 30) + " ",
    ]
    target = [prose(3, 80), None, "", "日本語のテキスト x"]
    docs = documents(spark, texts)
    got = every_row(spark, resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest), len(texts))
    assert {i: (r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for i, r in got.items()} == brute(dict(enumerate(texts)), target, longest)


def test_states_are_crcs_at_every_length():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, lengths = np.arange(300), np.arange(300)[::-1] + 1
    states = resampling.advanced(np.full(300, 0xFFFFFFFF, np.uint32), data, starts, lengths)
    assert [int(s) ^ 0xFFFFFFFF for s in states] == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]


def test_small_blocks_give_the_same(spark, monkeypatch):
    texts = pa_texts = [None, "one two", "", "three" * 9, "à b", "", prose(1, 40)]
    import pyarrow as pa

    monkeypatch.setattr(resampling, "_BLOCK", 5)
    column = pa.array([t or "" for t in texts] + ["more"])
    found = [(int(d), len(o) - 1) for x, o in resampling._blocks(column.slice(1, 6)) for d in [len(x)]]
    assert sum(n for _, n in found) == 6 and sum(d for d, _ in found) == len("".join(t or "" for t in pa_texts).encode())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    row = prose(1, 40)
    docs = spark.createDataFrame([(1, row)] * 60 + [(2, prose(2, 40)), (None, row), (3, None)], "doc_id long, text string").repartition(7)
    got = resampling.resampled(docs, spark.createDataFrame([], "text string")).collect()
    assert len(got) == 63
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 7))  # a tenth of 61 rows with words and an id
    assert [(r["score"], r["rank"]) for r in got if r["doc_id"] is None] == [(None, None)]
    assert resampling.resampled(docs.filter("1 = 0"), docs).count() == 0


def test_ranks_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = documents(spark, [prose(i % 37, 30) for i in range(300)]).repartition(9)
        got = resampling.resampled(docs, docs.limit(3), share=50).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in order] == [*range(1, 151), *[None] * 150]


def test_gains_do_not_read_other_columns(spark):
    docs = documents(spark, [prose(1, 5)]).withColumn("bucket", F.lit(1))
    assert resampling.counted(docs).sum() == 5
