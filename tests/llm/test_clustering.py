"""Sort-means against a plain exact k-means."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from emberline.llm import clustering


def brute(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    chosen = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in chosen]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, of, strict=True) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    per = {j: sum(d for _, d, a in last if a == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, a, d, per[a], sum(per.values()), digest[a]) for i, d, a in last)


def vectors(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, v int, n long, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("k", "dims", "n"), [(8, 4, 300), (1, 3, 20), (17, 2, 400), (8, 64, 60), (30, 1, 25)])
def test_sort_means_matches_plain_means(spark, k, dims, n):
    rows = vectors(n, dims, k)
    got = clustering.report(frame(spark, rows).repartition(5), k=k, rounds=6, dims=dims).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, 6, dims)


def test_ties_repeats_and_vectors_left_out(spark):
    grid = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(75)]  # whole coordinates: many ties, each point three times
    odd = [(900, None), (901, [1.0]), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 1.0]), (905, [])]
    rows = grid + odd + [(7, [3.0, 3.0])] * 40
    got = clustering.report(frame(spark, rows), k=6, rounds=10, dims=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6, 10, 2)


def test_null_ids_few_vectors_and_empty_tables(spark):
    got = clustering.report(frame(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0])]), dims=2).collect()
    assert {(r["vec_id"], r["distance"]) for r in got} == {(None, 0), (1, 0)}
    assert clustering.report(frame(spark, []).filter("1 = 0"), dims=2).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clustering.report(frame(spark, [(1, [1e30, 0.0])]), dims=2).collect()


def test_scan_stops_early_and_never_too_early():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (40, 3))
    v = rng.integers(-1000, 1000, (2000, 3))
    scan = clustering.Scan.of(centroids)
    all_d = ((v[:, None] - centroids[None]) ** 2).sum(2)
    best, near = scan.assigned(v, rng.integers(0, 40, 2000))
    assert (best == all_d.argmin(1)).all() and (near == all_d.min(1)).all()
    again, _ = scan.assigned(v, best)
    assert (again == best).all()
    own = all_d[np.arange(2000), best]
    assert sum((own > scan.reach[b][2]).sum() for b, own in ((b, own[best == b]) for b in range(40))) < 2000  # most stop within three
