"""Packing, classifiers, mixing and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import mixing, packing, quality_classifier, toxicity

from .helpers import AWKWARD, SF, documents, every_row, prose


def best_fit(lengths, capacity=1024):
    free = []
    for size in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(free) if room >= size]
        k = min(fits, key=lambda k: free[k], default=None)
        if k is None:
            free.append(capacity - size)
        else:
            free[k] -= size
    return len(free)


@pytest.mark.parametrize(("n", "high"), [(0, 1), (1, 5), (300, 1200), (2000, 400), (2000, 1024), (500, 60)])
def test_plan(n, high):
    rng = np.random.default_rng(n + high)
    lengths = np.minimum(1024, rng.integers(1, high + 1, n))
    counts = np.bincount(lengths, minlength=1025)
    runs = packing.plan(counts)
    placed = np.zeros(1025, int)
    for run in runs:
        assert run.used <= 1024 and run.count > 0
        for size in run.sizes:
            placed[size] += run.count
    assert (placed == counts).all()
    assert sum(r.count for r in runs) <= best_fit(lengths.tolist()) * 1.02 + 1


def test_packing_is_an_exact_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*AWKWARD, "a  b\n\nc", " lead", "trail ", "it's  <|endoftext|> x", "tab\tand\r\nline", "a b  c", "<p>1234567</p> don't", *[prose(i, 40 * i) for i in range(1, 12)]]
    docs = documents(spark, texts)
    rows = packing.packed(docs.union(docs.filter("doc_id = 3"))).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        if i == 3:
            assert len(own) == 2
            own = own[:1]
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part))
            assert r["length"] == 1024 or r["piece"] == 0
            at += r["length"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in sequences.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.packed(docs.filter("1 = 0")).count() == 0


def labelled(spark):
    rng = random.Random(1)
    texts, quality, toxic = [], [], []
    for i in range(300):
        good, bad = rng.random() < 0.7, rng.random() < 0.25
        text = prose(i, 60)
        if not good:
            text = " | ".join(text.upper().split()[:40])
        if bad:
            found = text.split(" ")
            for _ in range(3):
                found.insert(rng.randrange(len(found)), rng.choice(["vilzar", "gronkish", "blarty"]))
            text = " ".join(found)
        texts.append(text)
        quality.append(int(good))
        toxic.append(int(bad))
    rows = [(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic, strict=True))]
    return texts, spark.createDataFrame([*rows, (None, 1, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    texts, labels = labelled(spark)
    docs = documents(spark, [*texts, *AWKWARD])
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(docs, model)
    assert set(docs.columns) < set(scored.columns)
    got = every_row(spark, scored, len(texts) + len(AWKWARD))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(got[i]["quality_kept"] == bool(truth[i]) for i in range(300)) >= 294
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("text_score", "page_score", "quality_score")) and got[0]["t"] == "extra t"
    one = quality_classifier.score(docs, quality_classifier.train(docs, labels.filter("quality = 1")))
    assert one.filter("quality_kept and quality_score = 0.5").count() == len(texts) + len(AWKWARD)


def test_mixing_meets_targets(spark):
    texts, labels = labelled(spark)
    docs = documents(spark, [*texts, *AWKWARD, "junk"])
    model = mixing.train(docs, labels)
    assert {"vilzar", "gronkish", "blarty"} <= set(model.lexicon)
    for targets in (mixing.TARGETS, {"clean": 0.5, "junk": 0.2, "toxic": 0.3}):
        rows = mixing.mix(docs, model, targets).collect()
        assert len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
        total = sum(r["n_tokens"] for r in rows)
        for d in mixing.DOMAINS:
            got = sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) / total
            assert got == pytest.approx(targets[d], abs=0.01)
        assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)
        assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in rows)
    again = mixing.resampled(docs, model)
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, model).collect()}
    counts = {r["doc_id"]: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert again.columns == docs.columns and counts == {k: v for k, v in wanted.items() if v}
    assert mixing.mix(docs.filter("1 = 0"), model).count() == 0
    assert mixing.mix(docs, mixing.train(docs, labels.filter("1 = 0"))).count() == docs.count()


def test_toxicity_on_held_out_labels(spark):
    texts, labels = labelled(spark)
    docs = documents(spark, [*texts, *AWKWARD])
    got = every_row(spark, toxicity.score(docs, toxicity.train(docs, labels)), len(texts) + len(AWKWARD))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert toxicity.score(docs, 0.25).filter("score = 0.25").count() == len(got)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(toxicity.Reader({"bad": 0}))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids = rng.integers(-1, 5, (6, toxicity.SPAN))
    ids[:, 20:] = -1
    y = np.array([1, 0, 1, 0, 1, 0.0])
    names = ["bad", "x", "yy", "zzz", "idle"]
    grad = net.step(ids, y, np.array([net.reader.word(w) for w in names]), [np.array(net.reader.grams(w)) for w in names])

    def loss():
        p = toxicity._sigmoid(net.logits(net.gates(net.embed(names)), ids))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = net.w[name][at]
        net.w[name][at] = was + 1e-3
        up = loss()
        net.w[name][at] = was - 1e-3
        assert g[at] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=2e-5)
        net.w[name][at] = was


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 100, 1000):
        cut = toxicity.windows(np.arange(n))
        assert set(cut[cut >= 0].tolist()) == set(range(n)) and cut.shape[1] == toxicity.SPAN


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert last.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
