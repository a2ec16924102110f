"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives each document posteriors over domains. Rates r >= 0
per document are then fitted so that for each domain d the expected tokens sum(r * tokens * p(d))
meet the target. That is non-negative least squares over as many unknowns as documents, but its
gradient needs only one total per domain: each step is one distributed aggregate of a few sums over
a compact stored table, and a document's rate is a short expression of its own posteriors. The
gradient is scaled by the Gram matrix of the posteriors over documents with positive rates (k by k,
for k domains), and rates are projected to >= 0 after each step. Steps end when all targets are met
within `tolerance` of all tokens, or when one lowers the squared error by less than a twentieth: where a
target is out of reach (soft memberships leave a little of each domain in every document), further steps
would only heap the tokens on ever fewer documents. Fit.short says what is left. (For such a target the test asks for a tenth of the error before the fit, no less.)

Domains by default: `toxic` (label toxic = 1), `junk` (quality = 0) and `clean`. Tokens are words.
All fitting on labels uses a bounded sample (`most_labelled`); totals and rates use all documents.

Cases: null text has no tokens, and any rate (1 here); null doc_id is an ordinary document. Repeated
rows count each. Labels without both classes leave one domain, whose rates are uniform. An empty
table gives no rows. A target for a domain without any mass can't be met and is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import packed_rows, shared_folder, stored
from emberline.llm.features import PAGE_VIEW, TEXT_VIEW, Linear, sampled, with_features

DOMAINS = ("clean", "junk", "toxic")
TARGETS = {"clean": 0.97, "junk": 0.0, "toxic": 0.03}
_INPUTS = (*(f"t.{c}" for c in TEXT_VIEW), "p.log_chars", "p.line_length")


class Memberships:
    """Posteriors over DOMAINS: a multinomial model, or certainty of one domain where labels hold no other."""

    def __init__(self, model: Linear | None, present: list[int], lexicon: list[str]):
        self.model, self.present, self.lexicon = model, present, lexicon

    def columns(self) -> list[Column]:
        if self.model is None:
            return [F.lit(1.0 if k == self.present[0] else 0.0) for k in range(len(DOMAINS))]
        scores = self.model.score_columns([F.col(c) for c in _INPUTS] + [F.least("n_lexicon", F.lit(3.0))])
        e = [F.exp(s) for s in scores]
        total = sum(e[1:], e[0])
        return [e[self.present.index(k)] / total if k in self.present else F.lit(0.0) for k in range(len(DOMAINS))]


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, lexicon_size: int = 40) -> Memberships:
    """Fit the classifier on a bounded sample of labelled documents.

    The lexicon holds the words whose share of toxic documents exceeds that of others most.
    """
    domain = F.when(F.max("toxic") >= 1, 2).when(F.min("quality") <= 0, 1).otherwise(0)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(domain.alias("_y"))
    slim = docs.select(*(c for c in ("doc_id", "text", "lang", "source") if c in docs.columns))
    rows = sampled(slim, marks, most_labelled)
    words = rows.select("_y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1))).alias("w"))
    n_toxic, n_other = (rows.select("_y").agg(F.count_if(F.col("_y") == 2), F.count_if(F.col("_y") != 2)).first())
    lexicon: list[str] = []
    if n_toxic and n_other:
        in_toxic, in_other = F.count_if(F.col("_y") == 2) / n_toxic, F.count_if(F.col("_y") != 2) / n_other
        telling = words.groupBy("w").agg((in_toxic - in_other).alias("gap"), (in_toxic / (in_other + 1.0 / n_other)).alias("ratio"))
        lexicon = [r.w for r in telling.filter("w != '' and ratio >= 4 and gap >= 0.01").orderBy(F.desc("gap"), "w").limit(lexicon_size).collect()]
    known = with_features(rows, lexicon).select("doc_id", "_y", *(F.col(c).alias(c.replace(".", "_")) for c in _INPUTS), F.least("n_lexicon", F.lit(3.0)).alias("lex")).toPandas()
    known = known.sort_values(known.columns.tolist())
    present = sorted(int(k) for k in known["_y"].unique()) or [0]
    if len(present) < 2:
        return Memberships(None, present, lexicon)
    y = known["_y"].map({k: i for i, k in enumerate(present)}).to_numpy()
    return Memberships(Linear(known[known.columns[2:]].to_numpy(float), y, len(present)), present, lexicon)


def members(docs: DataFrame, model: Memberships) -> DataFrame:
    """`_row` (all columns of docs), doc_id, source and text where docs has them, n_tokens, and a posterior p_<domain> for each domain."""
    out = with_features(packed_rows(docs, "doc_id", "text", "lang", "source"), model.lexicon)
    kept = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    return out.select("_row", *kept, F.col("n_words").alias("n_tokens"), *(c.alias(f"p_{d}") for c, d in zip(model.columns(), DOMAINS, strict=True)))


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after the steps so far: each adds a weighted sum of posteriors and projects. One fold, so plans stay small."""
    if not steps:
        return F.lit(1.0)
    each = F.array(*(F.array(*(F.lit(float(s)) for s in step)) for step in steps))
    change = lambda step: sum((F.col(f"p_{d}") * step[i] for i, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(each, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate + change(step)))


@dataclass(frozen=True)
class Fit:
    """Steps of the projected gradient, and what they leave: each target less what is reached, as shares of all tokens."""

    steps: list[np.ndarray]
    short: dict[str, float]


def fit(table: DataFrame, targets: dict[str, float], most_steps: int = 24, tolerance: float = 1e-4, least_gain: float = 0.05) -> Fit:
    """Fit on a table of n_tokens and posteriors. Targets are shares of all tokens. Each step is one aggregate."""
    k = len(DOMAINS)
    done: list[np.ndarray] = []
    error, left, plain, scale = np.inf, np.zeros(k), False, np.eye(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    while True:
        rated = table.withColumn("_r", _rate(done))
        tokens = [F.sum(F.col("_r") * F.col("n_tokens") * F.col(f"p_{d}")) for d in DOMAINS]
        gram = [F.sum(F.when(F.col("_r") > 0, F.col("n_tokens") * F.col(f"p_{DOMAINS[i]}") * F.col(f"p_{DOMAINS[j]}")).otherwise(0.0)) for i, j in pairs]
        row = rated.agg(F.sum("n_tokens"), *tokens, *gram).first()
        if not row[0]:
            break
        total = float(row[0])
        now, matrix = np.array(row[1 : 1 + k], float), np.zeros((k, k))
        for (i, j), g in zip(pairs, row[1 + k :], strict=True):
            matrix[i, j] = matrix[j, i] = g
        short = np.array([targets.get(d, 0.0) * total for d in DOMAINS]) - now
        short[np.diag(matrix) <= 1e-9 * total] = 0.0
        if done and (short**2).sum() >= error:  # the projection cost more than the scaled step gained
            done.pop()
            if plain:
                break
            done.append(left * total / np.trace(scale))  # a plain gradient step is sure to lower the error
            plain = True
            continue
        plain, scale = False, matrix
        gained, error, left = 1 - (short**2).sum() / error, (short**2).sum(), short / total
        if np.abs(left).max() <= tolerance or gained < least_gain or len(done) == most_steps:
            break
        # a ridge bounds the step where domains have little or hardly distinct mass
        done.append(np.linalg.solve(matrix + np.eye(k) * 1e-4 * total, short))
    return Fit(done, dict(zip(DOMAINS, left.tolist(), strict=True)))


def mix(docs: DataFrame, model: Memberships, targets: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, posteriors, rate, and copies: the rate rounded at random, by a hash of doc_id and text."""
    kept = [c for c in ("doc_id", "source") if c in docs.columns]
    keyed = members(docs, model).select(*kept, "n_tokens", *(f"p_{d}" for d in DOMAINS), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h"))
    table = stored(keyed, shared_folder(docs.sparkSession), "members")
    return with_rates(table, fit(table, targets or TARGETS).steps).drop("_h")


def with_rates(table: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    draw = F.pmod("_h", F.lit(1_000_003)) / 1_000_003
    return table.withColumn("rate", _rate(steps)).withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def resampled(docs: DataFrame, model: Memberships, targets: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """docs, its columns alone, each row as often as its copies say.

    Rows are stored once with their posteriors: the fit reads only the numbers, and rating and copying read plain columns,
    so no filter or rate repeats the classifier's expressions.
    """
    rows = members(docs, model).select("_row", "n_tokens", *(f"p_{d}" for d in DOMAINS), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h"))
    table = stored(rows, shared_folder(docs.sparkSession), "members")
    rated = with_rates(table, fit(table, targets or TARGETS).steps)
    return rated.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
