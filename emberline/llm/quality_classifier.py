"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

Each view has a logistic regression: the text view over character and word ratios and the shares of hashed words and pairs of
neighbouring words (`SLOTS`), the page view over length, layout, language and source. Both start from labelled rows. In each round each view labels
the rows of an unlabelled pool that it is surest of, and the other view learns from them too. At the
end each view is calibrated on labelled rows that neither has seen (Platt scaling), and the two
log-odds are combined, less the prior that both hold.

Fitting uses bounded samples (`most_labelled`, `most_pool`, chosen by a hash of doc_id). Scoring is
one projection of Spark expressions over all documents, without a shuffle.

Cases: a document counts as good in training if its mean label is at least one half; null labels and
labels without a document are ignored. With no labels of one of the two classes every document
scores 0.5 and is kept. Null text counts as empty. Repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import packed_rows
from emberline.llm.features import PAGE_VIEW, TEXT_VIEW, Linear, sampled, with_features

#: Slots for hashed words and pairs, and how much more than the ratios their weights are held back.
SLOTS = 256
_RIDGE = np.r_[np.full(len(TEXT_VIEW), 1e-2), np.full(SLOTS, 0.5)]


@dataclass
class CoTrained:
    text: Linear
    page: Linear
    text_scale: tuple[float, float]
    page_scale: tuple[float, float]
    prior: float

    def columns(self) -> tuple[Column, Column, Column]:
        """Calibrated log-odds of the text view, of the page view, and combined."""
        t = self.text.odds_column([F.col(f"t.{c}") for c in TEXT_VIEW], F.col("terms")) * self.text_scale[0] + self.text_scale[1]
        p = self.page.odds_column([F.col(f"p.{c}") for c in PAGE_VIEW]) * self.page_scale[0] + self.page_scale[1]
        return t, p, t + p - self.prior


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset that make log-odds fit labels."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        g = np.array([((p - y) * odds).mean() + 1e-3 * (a - 1), (p - y).mean()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * odds * odds).mean() + 1e-3, (w * odds).mean()], [(w * odds).mean(), w.mean()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return max(float(a), 0.0), float(b)


def co_train(xt: np.ndarray, xp: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_p: np.ndarray, rounds: int = 4, share: float = 0.1, sure: float = 0.95) -> CoTrained:
    """Fit both views. y: 0 or 1. Every third labelled row calibrates only."""
    hold = np.arange(len(y)) % 3 == 2
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold[:] = False
    held = hold if hold.any() else ~hold
    given = {"t": {}, "p": {}}  # pool rows labelled for each view by the other
    views = {"t": (xt, pool_t), "p": (xp, pool_p)}

    def fit(view: str) -> Linear:
        x, pool = views[view]
        rows = list(given[view])
        ridge, steps = (_RIDGE, 150) if x.shape[1] == len(_RIDGE) else (1e-2, 300)
        return Linear(np.r_[x[~hold], pool[rows]] if rows else x[~hold], np.r_[y[~hold], [given[view][r] for r in rows]].astype(int), 2, ridge, steps)

    models = {v: fit(v) for v in views}
    for _ in range(rounds if len(pool_t) else 0):
        for teacher, pupil in (("t", "p"), ("p", "t")):
            p = models[teacher].probabilities(views[teacher][1])[:, 1]
            for label, certainty in ((1, p), (0, 1 - p)):
                order = np.argsort(-certainty, kind="stable")[: max(1, int(share * len(p) * (y.mean() if label else 1 - y.mean())))]
                for r in order:
                    if certainty[r] >= sure:
                        given[pupil].setdefault(int(r), label)
        models = {v: fit(v) for v in views}
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    return CoTrained(
        models["t"], models["p"], _platt(models["t"].odds(xt[held]), y[held]), _platt(models["p"].odds(xp[held]), y[held]), float(np.log(prior / (1 - prior)))
    )


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, most_pool: int = 8000, rounds: int = 4) -> CoTrained | None:
    """Fit on bounded samples of labelled and of all documents; None if a class is missing."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    columns = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    slim = docs.select(*columns).filter("doc_id is not null")

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [np.bincount(terms, minlength=SLOTS) / max(1, len(terms)) for terms in batch["terms"]]
            yield batch.assign(terms=[c.astype(np.float32).tobytes() for c in counts])

    def gathered(rows: DataFrame, *more: str) -> tuple[pd.DataFrame, np.ndarray]:
        """The rows without their content, in order of doc_id, and the inputs of the text view."""
        flat = with_features(rows, slots=SLOTS).select("doc_id", *more, "t.*", "p.*", "terms")
        kinds = ", ".join(f"{c} {t}" for c, t in flat.dtypes[:-1])
        found = flat.mapInPandas(shares, f"{kinds}, terms binary").toPandas().sort_values(["doc_id", *TEXT_VIEW], ignore_index=True)
        content = np.frombuffer(b"".join(found.pop("terms")), np.float32).reshape(-1, SLOTS)
        return found, np.c_[found[list(TEXT_VIEW)].to_numpy(np.float32), content]

    known, known_text = gathered(sampled(slim, marks, most_labelled), "_y")
    if known["_y"].nunique() < 2:
        return None
    pool, pool_text = gathered(sampled(slim, slim.select("doc_id").distinct(), most_pool, seed=1))
    fresh = ~pool["doc_id"].isin(known["doc_id"]).to_numpy()
    # in a fixed arbitrary order, so that the held-out third is an arbitrary one
    order = np.random.default_rng(5).permutation(len(known))
    page = lambda f: f[list(PAGE_VIEW)].to_numpy(float)
    return co_train(known_text[order], page(known)[order], known["_y"].to_numpy()[order], pool_text[fresh], page(pool)[fresh], rounds)


def score(docs: DataFrame, model: CoTrained | None, least: float = 0.5) -> DataFrame:
    """docs, all columns kept, with text_score, page_score, quality_score (0 to 1) and quality_kept (replacing columns so named)."""
    new = ("text_score", "page_score", "quality_score", "quality_kept")
    rows = packed_rows(docs, "doc_id", "text", "lang", "source")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    if model is None:
        return rows.select(*kept, *(F.lit(0.5).alias(c) for c in new[:3]), F.lit(True).alias("quality_kept"))
    p = lambda odds: 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))
    text, page, both = model.columns()
    scored = with_features(rows, slots=SLOTS).withColumn("_both", p(both))
    return scored.select(*kept, p(text).alias("text_score"), p(page).alias("page_score"), F.col("_both").alias("quality_score"), (F.col("_both") >= least).alias("quality_kept"))
