"""Document features as Spark expressions, and linear models over them fitted in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es")
SOURCES = 8

TEXT_VIEW = ("upper", "symbols", "bangs", "digits", "distinct", "word_length", "stops", "commas", "non_ascii", "one_letter")
PAGE_VIEW = ("log_chars", "log_lines", "line_length", *(f"lang_{c}" for c in LANGUAGES), *(f"source_{k}" for k in range(SOURCES)))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def with_features(docs: DataFrame, lexicon: list[str] | None = None, slots: int = 0) -> DataFrame:
    """docs with struct columns `t` (text content) and `p` (page metadata), n_words, n_lexicon if words are given, and with
    `slots` an array `terms`: the slots, by hash, of all words and all pairs of neighbouring words.

    Null text counts as empty, null lang and source as unknown; missing lang or source columns too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    size = F.greatest(F.length("_x"), F.lit(1)).cast("double")
    n_words = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    lines = (_count(F.col("_x"), "\n") + 1).cast("double")
    out = docs.withColumn("_x", text).withColumn("_w", F.filter(F.split(F.lower("_x"), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))
    content = {
        "upper": F.regexp_count("_x", F.lit(r"\p{Lu}")) / size,
        "symbols": F.regexp_count("_x", F.lit(r"[#*$%&|<>]")) / size,
        "bangs": _count(F.col("_x"), "!") / size,
        "digits": F.regexp_count("_x", F.lit("[0-9]")) / size,
        "distinct": F.size(F.array_distinct("_w")) / n_words,
        "word_length": F.least(size / n_words, F.lit(30.0)) / 10,
        "stops": _count(F.col("_x"), ".") / n_words,
        "commas": _count(F.col("_x"), ",") / n_words,
        "non_ascii": (F.octet_length("_x") - F.length("_x")) / size,
        "one_letter": F.size(F.filter("_w", lambda w: F.length(w) == 1)) / n_words,
    }
    page = {
        "log_chars": F.log1p(size),
        "log_lines": F.log1p(lines),
        "line_length": F.log1p(size / lines),
        **{f"lang_{c}": F.coalesce(lang == c, F.lit(False)).cast("double") for c in LANGUAGES},
        **{f"source_{k}": F.coalesce(F.pmod(F.xxhash64(source), F.lit(SOURCES)) == k, F.lit(False)).cast("double") for k in range(SOURCES)},
    }
    out = out.withColumn("t", F.struct(*(content[c].alias(c) for c in TEXT_VIEW))).withColumn("p", F.struct(*(page[c].alias(c) for c in PAGE_VIEW)))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    if lexicon is not None:
        out = out.withColumn("n_lexicon", F.size(F.array_intersect("_w", F.array(*(F.lit(w) for w in lexicon)).cast("array<string>"))).cast("double"))
    if slots:
        slot = lambda *of: F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int")
        n = F.greatest(F.size("_w") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("_w", 1, n), F.slice("_w", 2, n), lambda a, b: slot(a, b))
        out = out.withColumn("terms", F.concat(F.transform("_w", lambda w: slot(w)), pairs))
    return out.drop("_x", "_w")


def sampled(docs: DataFrame, ids: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """One row of docs (with the largest hash, where an id has more) for each of at most `most` of ids (doc_id and more columns).

    The choice is by a hash of the id. It is bounded, so joining by broadcast is safe at any size, and one row an id bounds
    the result even where a single id holds much of the table: each task keeps one row for it.
    """
    keys = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    more = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(keys), "doc_id").groupBy(*keys.columns).agg(F.max_by(F.struct(*more), F.xxhash64(*more)).alias("_one"))
    return found.select(*keys.columns, "_one.*")


class Linear:
    """Multinomial (or binary) logistic regression on standardised inputs; `ridge` for all or for each of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, ridge: float | np.ndarray = 1e-2, steps: int = 300):
        n, d = x.shape
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._ready(x)
        hot = np.eye(classes, dtype=x.dtype)[y]
        self.w = np.zeros((d + 1, classes), x.dtype)
        shrink = np.append(np.broadcast_to(ridge, d), 0.0)[:, None].astype(x.dtype) / 10
        m = v = np.zeros_like(self.w)
        for t in range(1, steps + 1):
            g = z.T @ (self._soft(z @ self.w) - hot) / n + shrink * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w = self.w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def _ready(self, x: np.ndarray) -> np.ndarray:
        """Standardised inputs and a column of ones, without copies in between."""
        z = np.ones((x.shape[0], x.shape[1] + 1), x.dtype)
        np.subtract(x, self.mean, out=z[:, :-1])
        z[:, :-1] /= self.scale
        return z

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self._ready(x) @ self.w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 in a binary model."""
        s = self._ready(x) @ self.w
        return s[:, 1] - s[:, 0]

    def _score(self, inputs: list[Column], weights: np.ndarray) -> Column:
        w = weights[:-1] / self.scale
        total = F.lit(float(weights[-1] - (w * self.mean).sum()))
        for c, k in zip(inputs, w.tolist(), strict=True):
            total = total + c * F.lit(k)
        return total

    def odds_column(self, inputs: list[Column], terms: Column | None = None) -> Column:
        """Log-odds of class 1. With `terms`, the inputs after the given ones are the shares of the slots among terms."""
        if terms is None:
            return self._score(inputs, self.w[:, 1] - self.w[:, 0])
        weights = (self.w[:, 1] - self.w[:, 0]).astype(float)
        w = weights[:-1] / self.scale
        total = F.lit(float(weights[-1] - (w * self.mean).sum()))
        for c, k in zip(inputs, w.tolist(), strict=False):
            total = total + c * F.lit(k)
        table = F.array(*map(F.lit, w[len(inputs) :].tolist()))
        return total + F.aggregate(terms, F.lit(0.0), lambda sum_, slot: sum_ + F.get(table, slot)) / F.greatest(F.size(terms), F.lit(1))

    def score_columns(self, inputs: list[Column]) -> list[Column]:
        """Scores whose softmax is the probabilities, kept within the range of exp()."""
        return [F.greatest(F.lit(-60.0), F.least(F.lit(60.0), self._score(inputs, self.w[:, k] - self.w[:, 0]))) for k in range(self.w.shape[1])]
