"""The n-gram join and SimHash against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from emberline.llm import graph, ngram_join, simhash
from emberline.llm.common import shared_folder, stored

from .helpers import AWKWARD, documents, every_row, prose


def brute(texts):
    sets = {}
    for i, t in enumerate(texts):
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(found)} if 0 < len(found) < 5 else {tuple(found[k : k + 5]) for k in range(len(found) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    shared = collections.Counter((a, b) for ids in held.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in text.split(" "))


def test_ngram_join_matches_brute_force(spark):
    base = [prose(i, 120) for i in range(6)]
    chain = [base[0]]
    for k in range(12):  # each near the last one, the ends far apart
        chain.append(edited(chain[-1], 0.02, k))
    group = [edited(base[1], 0.01, 100 + k) for k in range(40)]
    passage = prose(77, 70)
    sharing = [passage + " " + prose(200 + k, 60) for k in range(20)] + [passage + " " + prose(300 + k, 6) for k in range(6)]
    texts = [*AWKWARD, *base, *chain, *group, *sharing, *base, base[2].upper(), "only four words here", "only four words here"]
    got = every_row(spark, ngram_join.joined(documents(spark, texts)), len(texts))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(texts)


def test_one_each_and_empty(spark):
    docs = documents(spark, [prose(1, 80), prose(1, 80), prose(2, 80), None, None])
    kept = ngram_join.one_each(docs.union(docs.filter("doc_id = 2")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]
    assert ngram_join.joined(docs.filter("1 = 0")).count() == 0


def test_one_each_decides_by_row(spark):
    """Clashing ids with different texts, texts without an id, and rows without words."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(3, a + " end"), (5, a), (5, b), (7, b + " end"), (None, c), (None, c), (None, c + " end"), (8, " "), (8, " ")]
    kept = ngram_join.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["doc_id"]) == sorted([(3, a + " end"), (5, b), (8, " "), (8, " ")])
    assert len(kept) == 5 and [r["text"] for r in kept if r["doc_id"] is None][0] in (c, c + " end")


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (200, 201)]
    folder = shared_folder(spark)
    got = graph.components(stored(spark.createDataFrame(edges, "a long, b long"), folder, "e"), folder, "c").collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long"), folder, "none").count() == 0


def test_fingerprints(spark):
    texts = [*AWKWARD, *[prose(i, 60) for i in range(30)]]
    docs = documents(spark, texts, start=3)
    got = every_row(spark, simhash.report(docs), len(texts))
    order = sorted(got, reverse=True)
    for k, i in enumerate(order):
        own, following = texts[i - 3] or "", texts[order[(k + 1) % len(order)] - 3] or ""
        half = len(own) // 2
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()
        other = got[order[(k + 1) % len(order)]]["fingerprint"]
        apart = bin(int(got[i]["fingerprint"], 16) ^ int(other, 16)).count("1")
        assert abs(got[i]["near_next"] - (1 - apart / simhash.BITS)) < 1e-12
    by_text = collections.defaultdict(set)
    for i, r in got.items():
        by_text[texts[i - 3] or ""].add(r["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values())
    assert simhash.report(docs.filter("1 = 0")).count() == 0


def test_ranges_give_the_same(spark):
    docs = documents(spark, [prose(i, 20) for i in range(97)]).withColumn("doc_id", F.col("doc_id") * 7919 % 100_003)
    one = simhash.with_next(docs).filter("not _guest").select("doc_id", "_next")
    many = simhash.with_next(docs, per_range=5).filter("not _guest").select("doc_id", "_next")
    assert one.exceptAll(many).count() == 0 and many.count() == 97


def test_block_tables_find_all(spark):
    base = [prose(i, 100) for i in range(4)]
    texts = [edited(base[k % 4], 0.01 * (k % 6), k) for k in range(60)] + base
    members, pairs = simhash.near(documents(spark, texts), radius=12)
    prints = sorted({r["p"] for r in members.collect()})
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    wanted = {(a, b, apart(a, b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if apart(a, b) <= 12}
    assert {tuple(r) for r in pairs.collect()} == wanted and wanted


def test_probes_are_not_broadcast(spark):
    """A query makes 192 probes, so those of few queries (small enough for a broadcast) would still fill the driver."""
    prints = stored(spark.range(2000).select(*(F.shiftrightunsigned(F.xxhash64("id", F.lit(k)), 2).alias(f"f{k}") for k in range(3)), F.lit(1).alias("n")), shared_folder(spark), "p")
    found = simhash.counted(prints, prints.select("f0", "f1", "f2").limit(100).distinct())
    assert len(found.collect()) == 100
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_votes_of_long_texts(spark):
    """Fingerprints of texts of several stretches, and of one term alone, against a count of each bit's votes; a term costs 49 sums."""
    texts = [" ".join(f"{w % 997}{'y' * (w % 15)}" for w in range(n)) for n in (300, 10_001, 25_000)] + ["internationalization " * 30_000]
    got = {r["doc_id"]: [r["f0"], r["f1"], r["f2"]] for r in simhash.printed(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        votes = [0] * simhash.BITS
        for term, n in collections.Counter(map(" ".join, zip(words, words[1:], strict=False))).items():
            weight = n * (3 if len(term) >= 12 else 2 if len(term) >= 8 else 1)
            for k in range(3):
                h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(term, 42))
                for b in range(62):
                    votes[62 * k + b] += weight if h >> b & 1 else -weight
        assert got[i] == [sum(1 << b for b in range(62) if votes[62 * k + b] > 0) for k in range(3)]
    assert len(simhash._votes()) == 49


def test_only_sets_with_entries_are_read(spark, monkeypatch):
    """The product of a turn reads the rows of its pairs' sets alone, and a turn without pairs reads none."""
    seen, plain = [], ngram_join._overlapping

    def watched(pairs, matrix, *more):
        sets = {s for r in pairs.select("a", "b").collect() for s in r}
        seen.append((sorted(sets), sorted(r["s"] for r in matrix.select("s").collect())))
        return plain(pairs, matrix, *more)

    monkeypatch.setattr(ngram_join, "_overlapping", watched)
    near = [prose(1, 80), prose(1, 80) + " end"]
    passage = prose(77, 70)
    others = [passage + " " + prose(50 + k, 10) + " " + prose(90 + k, 2) for k in range(3)]
    assert ngram_join.joined(documents(spark, [*near, *others, *(prose(k, 60) for k in range(10, 14))])).count() == 9
    assert seen and all(sets == read for sets, read in seen)
    seen.clear()
    assert ngram_join.joined(documents(spark, [prose(k, 60) for k in range(5)])).count() == 5
    assert not seen
