"""Pages and substring search against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import search
from emberline.operators.paging import Pages
from emberline.operators.search import SearchIndex


def test_pages_equal_the_sorted_list(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"n{k:04d}", rng.choice([None, 1.0, 2.0, 2.5, 7.0])) for k in range(1003)]
    frame = spark.createDataFrame(rows, "name string, score double").repartition(5)
    made = Pages.of(frame, [F.col("score").desc_nulls_last(), F.col("name")], str(tmp_path / "down"), per_range=200)
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert made.total == 1003 and len(made.sizes) >= 3
    for number in (0, 1, 3, 9, 10, 11):
        got = [(r["name"], r["score"], r["place"]) for r in made.page(number, 100).orderBy("place").collect()]
        assert got == [(*r, 100 * number + k) for k, r in enumerate(wanted[100 * number : 100 * number + 100])]
    read, before = made.ranges_of(300, 100)
    assert len(read) <= 3 and before <= 300
    assert len([f for f in made.page(3, 100).inputFiles()]) < len(frame.sparkSession.read.parquet(f"{made.folder}/ranges").inputFiles())
    empty = Pages.of(frame.filter("1 = 0"), [F.col("name")], str(tmp_path / "none"))
    assert empty.total == 0 and empty.page(0).count() == 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gämma", "de%lta", "e_psilon", "zeta\nzeta", "ETA", "日本語"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for k in range(300)]
    return [*rows, (300, None), (301, ""), (302, "ab"), (303, "x" * 999 + "needle" + "y" * 2500 + "thread"), (304, "alphabet"), (304, "other"), (None, "alpha")]


@pytest.mark.parametrize("wanted", ["alpha", "PHA be", "gämma", "%lt", "_ps", "a\nz", "日本語", "needle", "ythread", "nothing", "alphaa", "al", "b", ""])
def test_search_equals_contains(spark, tmp_path, texts, wanted):
    frame = spark.createDataFrame(texts, "id_ long, body string")
    index = SearchIndex.of(frame, "id_", F.col("body"), str(tmp_path / "index"), parts=8)
    found = sorted((r["id_"], r["body"] or "") for r in index.find(wanted).filter("id_ is not null").collect())
    assert found == sorted((i, t or "") for i, t in texts if i is not None and wanted.lower() in (t or "").lower())
    met = index.candidates(wanted)
    if met is not None and wanted in ("needle", "nothing", "%lt"):
        assert met.count() <= len(found) + 5
    if len(wanted) >= 3:
        assert index.find(wanted).filter("id_ is null").isEmpty()


def test_search_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "id_ long, body string")
    assert SearchIndex.of(frame, "id_", F.col("body"), str(tmp_path / "index")).find("abc").count() == 0


def test_postings_are_rows_of_chunks(spark, tmp_path):
    """A row for each trigram of a chunk, and not for each trigram of each text."""
    texts = [f"the same words again, number {k}" for k in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(1)
    index = SearchIndex.of(frame, "id", F.col("body"), str(tmp_path / "index"), parts=4)
    grams = len({t[k : k + 3] for t in texts for k in range(len(t) - 2)})
    assert spark.read.parquet(str(tmp_path / "index" / "postings")).count() <= grams + 1
    assert sorted(r["id"] for r in index.find("NUMBER 77").collect()) == [k for k, t in enumerate(texts) if "number 77" in t]


def test_too_many_candidates_are_scanned(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(search, "_BROADCAST", 3)
    frame = spark.createDataFrame(texts, "id_ long, body string")
    found = SearchIndex.of(frame, "id_", F.col("body"), str(tmp_path / "index"), parts=8).find("alpha")
    assert sorted((r["id_"], r["body"]) for r in found.collect()) == sorted((i, t) for i, t in texts if i is not None and "alpha" in (t or "").lower())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("n_bytes", "n_texts"), [(1, 1), (7, 3), (64, 1000), (1 << 20, 1 << 16)])
def test_chunks_hold_all_trigrams(monkeypatch, n_bytes, n_texts):
    """Chunks and their postings against sets, with texts longer than a chunk, empty ones, and bytes that aren't UTF-8."""
    monkeypatch.setattr(search, "_BYTES", n_bytes)
    monkeypatch.setattr(search, "_TEXTS", n_texts)
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.choice([0, 1, 2, 3, 5, 40]))) for _ in range(200)] + [b"zzzz", b"", b"ab"]
    data, ends = np.frombuffer(b"head" + b"".join(texts), np.uint8), 4 + np.cumsum([0, *map(len, texts)])
    chunks, met = list(search._chunks(ends)), {}
    assert [a for a, _ in chunks] == [0, *(z for _, z in chunks[:-1])] and chunks[-1][1] == len(texts)
    for a, z in chunks:
        assert z - a <= n_texts and (z - a == 1 or ends[z] - ends[a] <= n_bytes)
        for grams, counts, postings in search._postings(search._keys(data, ends[a : z + 1]), z - a):
            for g, n, posting in zip(grams, counts, postings.to_pylist(), strict=True):
                held = search._held(posting, z - a)
                assert len(held) == n
                met.setdefault(int(g), []).extend(int(a + k) for k in held)
    assert met == {g: [k for k, t in enumerate(texts) if g in search.trigrams(t)] for g in sorted({g for t in texts for g in search.trigrams(t)})}
