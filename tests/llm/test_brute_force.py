"""Models and fingerprints against plain implementations, and awkward tables through every operator."""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import features, licenses, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, simhash, toxicity

from .helpers import AWKWARD, documents, every_row, prose
from .test_joins import brute, edited
from .test_models import labelled


def hashed(*parts):
    """Spark's 64-bit hash of strings and ints, as an unsigned number."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else int(p).to_bytes(4, "little"), seed)
    return seed


def fingerprint(text):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    terms = [f"{a} {b}" for a, b in zip(words, words[1:])] if len(words) > 1 else words
    weights = [3 if len(t) >= 12 else 2 if len(t) >= 8 else 1 for t in terms]
    out = []
    for k in range(3):
        bits = 0
        for b in range(62):
            votes = sum(w for t, w in zip(terms, weights) if hashed(t, k) >> b & 1)
            bits |= (2 * votes > sum(weights)) << b
        out.append(bits)
    return out


def test_fingerprints_and_neighbours(spark):
    base = [prose(k, 60) for k in range(5)]
    texts = [t for t in AWKWARD if len(t or "") < 6000] + [edited(base[k % 5], 0.01 * (k % 4), k) for k in range(50)] + base
    got = every_row(spark, simhash.report(documents(spark, texts)), len(texts))
    prints = [fingerprint(t) for t in texts]
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    order = sorted(range(len(texts)), reverse=True)
    for place, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(place + 1) % len(order)]] or ""
        new = fingerprint(own[: len(own) - len(own) // 2] + following[: len(own) // 2])
        assert got[i]["fingerprint"] == "".join(f"{p:016x}" for p in prints[i]) and got[i]["edited_fingerprint"] == "".join(f"{p:016x}" for p in new)
        assert got[i]["near_edited"] == pytest.approx(1 - apart(prints[i], new) / simhash.BITS)
        near = sum(apart(prints[i], p) <= simhash.RADIUS for p in prints) - 1
        assert got[i]["n_near"] == (near if i % 20 == 0 else None)
    assert max(r["n_near"] or 0 for r in got.values()) >= 2


def test_crowded_keys_are_split(spark):
    base = prose(9, 80)
    prints = simhash.fingerprints(documents(spark, [edited(base, 0.02, k) for k in range(40)]).select("doc_id", simhash.words_of(F.col("text")).alias("words")), ["doc_id"])
    prints = prints.groupBy("f0", "f1", "f2").agg(F.count("*").alias("n"))
    asked = prints.select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), F.col("f2").alias("q2"))
    whole, parts = (simhash._met(prints, asked, 11, together=t) for t in (5000, 3))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0 and whole.count() > 40


def test_one_id_may_fill_ranges(spark):
    rows = [(5, prose(k, 8)) for k in range(300)] + [(k, prose(500 + k, 8)) for k in range(100, 160)] + [(None, prose(900 + k, 8)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one = simhash.with_next(docs).filter("not _guest")
    many = simhash.with_next(docs, per_range=10, coarse=8).filter("not _guest")
    assert one.select("doc_id", "text", "_next").exceptAll(many.select("doc_id", "text", "_next")).count() == 0
    assert many.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 120


def test_many_copies_of_one_row_are_spread(spark):
    rows = [(5, "the same text")] * 400 + [(5, prose(k, 8)) for k in range(60)] + [(9, "again and again")] * 150 + [(k, prose(500 + k, 8)) for k in range(100, 290)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, many = simhash.with_next(docs), simhash.with_next(docs, per_range=20, coarse=16)
    for placed in (one, many):
        assert placed.filter("not _guest").count() == len(rows) and placed.filter("_guest").count() == placed.select("_bucket").distinct().count()
    pick = lambda rows: rows.filter("not _guest").select("doc_id", "text", "_next")
    assert pick(one).exceptAll(pick(many)).count() == 0
    sizes = [r["count"] for r in many.groupBy("_bucket").count().collect()]
    assert max(sizes) < 120 and len(sizes) > 20
    assert simhash.report(docs).count() == len(rows)


def text_view(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    size, n = max(1, len(text)), max(1, len(words))
    share = [
        sum(unicodedata.category(c) == "Lu" for c in text) / size, sum(c in "#*$%&|<>" for c in text) / size, text.count("!") / size, sum(c in "0123456789" for c in text) / size,
        len(set(words)) / n, min(size / n, 30.0) / 10, text.count(".") / n, text.count(",") / n, (len(text.encode()) - len(text)) / size, sum(len(w) == 1 for w in words) / n,
    ]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    slots = [signed(hashed(w)) % quality_classifier.SLOTS for w in words] + [signed(hashed(a, b)) % quality_classifier.SLOTS for a, b in zip(words, words[1:])]
    return np.r_[share, np.bincount(slots, minlength=quality_classifier.SLOTS) / max(1, len(slots))]


def page_view(text, lang, source):
    lines = text.count("\n") + 1
    size = max(1, len(text))
    slot = hashed(source)
    slot = (slot - 2**64 if slot >= 2**63 else slot) % features.SOURCES
    return np.r_[math.log1p(size), math.log1p(lines), math.log1p(size / lines), [lang == c for c in features.LANGUAGES], [slot == k for k in range(features.SOURCES)]]


def test_quality_scores_are_the_models(spark):
    texts, labels = labelled(spark)
    texts += AWKWARD
    docs = documents(spark, texts)
    model = quality_classifier.train(docs, labels)
    got = every_row(spark, quality_classifier.score(docs, model), len(texts))
    odds = lambda m, x: (((x - m.mean) / m.scale) @ (m.w[:-1, 1] - m.w[:-1, 0]) + m.w[-1, 1] - m.w[-1, 0]).item()
    for i, text in enumerate(texts):
        t = odds(model.text, text_view(text or "")) * model.text_scale[0] + model.text_scale[1]
        p = odds(model.page, page_view(text or "", "en", f"src{i % 3}")) * model.page_scale[0] + model.page_scale[1]
        assert got[i]["quality_score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, t + p - model.prior)))), abs=1e-4)


def test_quality_hears_words_alone(spark):
    """Good and bad texts alike in all ratios: only their words differ."""
    texts = [prose(i, 50) + (" tanko milo " if i % 2 else " tonka limo ") * 3 for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts).drop("source")
    got = every_row(spark, quality_classifier.score(docs, quality_classifier.train(docs, labels)), 200)
    assert sum(got[i]["quality_kept"] == bool(i % 2) for i in range(200)) >= 180


def test_toxicity_forward_pass(spark):
    texts, labels = labelled(spark)
    net = toxicity.fit(texts[:80], np.array([float(i % 3 == 0) for i in range(80)]), epochs=1, least_steps=1)
    scorer, w, hidden = toxicity.Scorer(net), net.w, toxicity._H
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    cases = ["", "one", texts[0], texts[1] + " " + prose(3, 100), "x" * 200]
    for text, got in zip(cases, scorer(cases), strict=True):
        found, best = toxicity.words_of(text), -np.inf
        rows = [np.r_[w["words"][net.reader.word(x)], w["grams"][net.reader.grams(x)].mean(0)] for x in found]
        starts = range(0, max(1, len(rows) - toxicity.SPAN + toxicity.STRIDE), toxicity.STRIDE)
        for start in starts:
            part, both = rows[start : start + toxicity.SPAN], []
            for side, order in (("f", 1), ("b", -1)):
                h, out = np.zeros(hidden), []
                for x in part[::order]:
                    g, a = x @ w[f"W{side}"] + w[f"c{side}"], h @ w[f"U{side}"]
                    z, r = sigmoid(g[:hidden] + a[:hidden]), sigmoid(g[hidden : 2 * hidden] + a[hidden : 2 * hidden])
                    n = np.tanh(g[2 * hidden :] + r * a[2 * hidden :])
                    h = (1 - z) * n + z * h
                    out.append(h)
                both.append(np.array(out[::order]).reshape(-1, hidden))
            states = np.concatenate(both, 1)
            weight = np.exp(np.tanh(states @ w["a"]) @ w["v"])
            pooled = (weight[:, None] * states).sum(0) / weight.sum() if len(states) else np.zeros(2 * hidden)
            best = max(best, float(pooled @ w["o"] + w["b"][0]))
        assert got == pytest.approx(sigmoid(net.slope * best + net.offset), abs=2e-4)


def test_toxicity_reads_long_runs_and_trains_without_words(spark):
    assert "".join(dict.fromkeys(toxicity.words_of("a" * 30 + "b" * 30))).startswith("a" * 30) and any("b" * 30 in x for x in toxicity.words_of("a" * 30 + "b" * 30))
    assert all(len(x) <= toxicity._RUN for x in toxicity.words_of("语" * 500 + " word"))
    docs = spark.createDataFrame([(i, "... !!") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).filter("score between 0 and 1").count() == 40


def test_mixing_reaches_the_least_error(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([2.0, 0.7, 0.3], 400)
    tokens = rng.integers(1, 300, 400)
    rows = [(int(n), *map(float, q)) for n, q in zip(tokens, p, strict=True)]
    table = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
    total = tokens.sum()
    mass = p * tokens[:, None] / total
    for targets in ({"clean": 0.7, "junk": 0.2, "toxic": 0.1}, {"clean": 0.97, "junk": 0.0, "toxic": 0.03}):
        wanted = np.array([targets[d] for d in mixing.DOMAINS])
        fitted = mixing.fit(table, targets)
        rates = np.ones(400)
        for step in fitted.steps:
            rates = np.maximum(0, rates + p @ step)
        assert np.allclose(wanted - rates @ mass, [fitted.short[d] for d in mixing.DOMAINS], atol=1e-9)
        plain = np.ones(400)  # unscaled projected gradient, very many small steps
        for _ in range(20_000):
            plain = np.maximum(0, plain + mass @ (wanted - plain @ mass) / (mass**2).sum())
        best = ((wanted - plain @ mass) ** 2).sum()
        if targets["junk"]:
            assert max(abs(v) for v in fitted.short.values()) <= 1e-4
        else:  # out of reach: most of the error is gone, without heaping all tokens on few documents
            assert ((wanted - rates @ mass) ** 2).sum() <= best + 0.1 * ((wanted - mass.sum(0)) ** 2).sum() and rates.max() < 60
    many = mixing.with_rates(table.withColumn("_h", F.lit(1)), [np.array([0.01, -0.01, 0.0])] * 24).filter("copies > 0")
    assert len(many._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_samples_are_bounded_by_rows(spark):
    rows = [(1, f"t{k}") for k in range(500)] + [(2, "u"), (None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, _y int")
    got = features.sampled(docs, ids, 10).collect()
    assert sorted((r["doc_id"], r["_y"]) for r in got) == [(1, 0), (2, 1)]
    assert features.sampled(docs, ids, 10).collect() == got and features.sampled(docs, ids, 1).count() <= 1


def test_best_mix_is_optimal_on_small_cases():
    for sizes, numbers, least in (([600, 400], [100, 100], 100), ([500, 300, 200], [120, 120, 120], 120), ([700, 350, 340], [50, 90, 60], 115)):
        out = packing.configurations(np.array(sizes), np.array(numbers), 1024)
        used = np.zeros(len(sizes), int)
        for times, chosen in out:
            assert sum(sizes[k] for k in chosen) <= 1024
            np.add.at(used, chosen, times)
        assert used.tolist() == numbers and sum(t for t, _ in out) <= least + 1


def test_awkward_tables(spark):
    """Empty tables and rows without an id through the operators that other tests don't show them."""
    texts, labels = labelled(spark)
    docs = documents(spark, texts)
    nothing, nameless = docs.filter("1 = 0"), documents(spark, AWKWARD).withColumn("doc_id", F.lit(None).cast("long"))
    quality, network, members, selector = quality_classifier.train(docs, labels), toxicity.train(docs, labels), mixing.train(docs, labels), pii.train(spark)
    for one, n in ((nothing, 0), (nameless, len(AWKWARD))):
        assert quality_rules.clean(one).count() == n and licenses.scan(one).count() == n and secrets.scan(one).count() == n
        assert quality_classifier.score(one, quality).count() == n and toxicity.score(one, network).count() == n
        assert mixing.mix(one, members).count() == n and pii.report(one, selector).count() == n and simhash.report(one).count() == n
        assert ngram_join.joined(one).count() == n and packing.packed(one).select("sequence_id", "offset").distinct().count() >= n
    assert quality_classifier.train(nothing, labels) is None and isinstance(toxicity.train(nothing, labels), float)


def test_pipeline_through_run(spark, tmp_path):
    texts, labels = labelled(spark)
    base = [*texts, *AWKWARD, texts[0], edited(texts[2], 0.02, 1), "Mail a@b.cd or +1 (222) 333-4444. " + prose(77, 80)]
    docs = documents(spark, base)
    docs = docs.union(docs.filter("doc_id = 5")).union(docs.filter("doc_id in (7, 8)").withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(used.values()) <= 1024 and {r["doc_id"] for r in rows} <= {*range(len(base)), None}
    good = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()}
    root = {i: c for i, (_, c) in brute(texts).items()}
    left = {r["doc_id"] for r in rows}
    assert len(good & left) >= 0.8 * len({root[i] for i in good if i in root})
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.deduplicated(spark, stage, str(tmp_path))
    assert kept.columns == docs.columns
    found = [r["text"] for r in kept.collect()]
    components = brute(found)
    worded = [c for n, c in components.values() if n]
    assert len(worded) == len(set(worded)) == len({c for n, c in brute([r["text"] for r in docs.collect()]).values() if n})


def test_pipeline_on_empty_tables_and_without_labels(spark, tmp_path):
    docs = documents(spark, [*AWKWARD, prose(3, 90)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, frame, least in (("some", docs, 1), ("none", docs.filter("1 = 0"), 0)):
        folder = tmp_path / name
        frame.write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(rows) >= least and (least or not rows)
        if least:  # without labels all stay but copies
            assert {r["doc_id"] for r in rows} >= {0, 1, 2, 3, len(AWKWARD)} and len({r["doc_id"] for r in rows}) == len(AWKWARD) + 1 - 3


def test_pipeline_clears_what_it_no_longer_reads(spark, tmp_path):
    texts, labels = labelled(spark)
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    from pathlib import Path

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = corpus_pipeline._worked.get(corpus_pipeline.STAGES[k - 1][1].__name__, []) if k else []
        made = stage(spark, docs, str(tmp_path))
        assert not [f for f in before if Path(f).exists()] and (not k or not corpus_pipeline._worked.get(corpus_pipeline.STAGES[k - 1][1].__name__))
        made.write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
