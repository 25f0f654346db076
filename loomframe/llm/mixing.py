"""Document rates that bring the expected token totals of soft domains to target weights.

All of it is DataFrame functions. A labelled table trains two naive Bayes models on
hashed words, of quality and of toxicity; a document belongs to each of the four
domains that they span with a posterior probability. With r documents' rates, t
their tokens and p their posteriors, r >= 0 is sought with sum r t p_d nearest to the
targets T_d. A ridge, the sum of r^2 t times a small number, makes the rates unique:
they are the posteriors' sums by four weights, cut off at 0, and Newton steps find the
weights. A step is one aggregate of the posterior table, the totals and the 4 x 4
second moments of the documents with positive rates. Weights also bound how near any
rates can come, so the ridge is lowered until no others come noticeably nearer.
"""

from __future__ import annotations

import warnings
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.shared import written

BUCKETS = 4096
DOMAINS = ("good_clean", "good_toxic", "poor_clean", "poor_toxic")
#: Shares of all tokens.
TARGETS = {"good_clean": 0.9, "good_toxic": 0.03, "poor_clean": 0.06, "poor_toxic": 0.01}
#: Words whose evidence counts in full; that of longer texts is averaged to so many.
EVIDENCE = 64


def word_list(text: str) -> Column:
    """Words parted by 0x20 and 0x09-0x0D; null has none."""
    return F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def _summed(weights: list[float]) -> Column:
    """Sum of the weights of a document's buckets. The table is one constant, which the optimiser folds."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate("_buckets", F.lit(0.0), lambda s, b: s + F.get(table, b))


class Classifier:
    """Weights of each hashed word for quality and toxicity, and the log odds before any word."""

    def __init__(self, weights: dict[str, list[float]], priors: dict[str, float]):
        self.weights, self.priors = weights, priors

    def posteriors(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """``docs`` with _tokens and _p0 to _p3, the posteriors of DOMAINS."""
        words = docs.withColumn("_buckets", F.transform(word_list(text_column), _bucket)).withColumn("_tokens", F.size("_buckets").cast("long"))
        chance = {}
        for name in ("quality", "toxic"):
            total = _summed(self.weights[name])
            odds = F.lit(self.priors[name]) + total / F.greatest(F.lit(1.0), F.col("_tokens") / EVIDENCE)
            chance[name] = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
        q, t = F.col("_q"), F.col("_t")
        split = words.withColumns({"_q": chance["quality"], "_t": chance["toxic"]}).drop("_buckets")
        return split.withColumns({"_p0": q * (1 - t), "_p1": q * t, "_p2": (1 - q) * (1 - t), "_p3": (1 - q) * t}).drop("_q", "_t")


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = 20000, id_column: str = "doc_id", text_column: str = "text") -> Classifier:
    """Naive Bayes on at most about ``sample`` labelled documents, drawn by a hash of the id.

    The sample of labels is bounded, so it is broadcast to the scan of the texts, which doesn't move them; counts are
    combined before they are shuffled, to ``BUCKETS`` rows. Labels that are null teach nothing; of several rows of a
    document the highest labels count. Without labels every posterior is one in four.
    """
    known = labels.filter(F.col("doc_id").isNotNull())
    n = known.count()
    part = int(min(1.0, sample / max(1, n)) * (1 << 40))
    drawn = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), F.lit(1 << 40)) < part).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("_quality"), F.max("toxic").cast("int").alias("_toxic")).limit(2 * sample)
    words = docs.select(F.col(id_column).cast("long").alias("_id"), F.transform(word_list(text_column), _bucket).alias("_words")).join(F.broadcast(drawn), "_id").select("_quality", "_toxic", F.explode("_words").alias("bucket"))
    number = lambda name, value: F.sum((F.col(name) == value).cast("long")).alias(f"{name}{value}")
    counts = words.groupBy("bucket").agg(*[number(f"_{x}", v) for x in ("quality", "toxic") for v in (0, 1)]).collect()
    seen = drawn.agg(*[number(f"_{x}", v) for x in ("quality", "toxic") for v in (0, 1)]).first()
    weights, priors = {}, {}
    for name in ("quality", "toxic"):
        table = np.zeros((BUCKETS, 2))
        for row in counts:
            table[row["bucket"]] = row[f"_{name}0"] or 0, row[f"_{name}1"] or 0
        smooth = table + 1.0
        share = np.log(smooth / smooth.sum(axis=0))
        weights[name] = (share[:, 1] - share[:, 0]).round(9).tolist() if table.sum(axis=0).min() > 0 else [0.0] * BUCKETS
        priors[name] = round(log(((seen[f"_{name}1"] or 0) + 1) / ((seen[f"_{name}0"] or 0) + 1)), 9)
    return Classifier(weights, priors)


def rate_column(steps: list[list[float]], start: list[float]) -> Column:
    """The rate: the sum of a row's posteriors by the weights to which the steps lead from the start, cut off at 0."""
    weights = [sum(x) for x in zip(start, *steps)]
    return F.greatest(F.lit(0.0), sum((F.col(f"_p{d}") * F.lit(float(x)) for d, x in enumerate(weights)), F.lit(0.0)))


def solve_rates(rows: DataFrame, targets: list[float], iterations: int = 400, close: float = 1e-6) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps, start and the totals reached; ``rows`` has _tokens and _p0, _p1, ...

    The ridge is lowered until the totals miss the targets by at most ``close`` of their sum more than those of any
    rates would. If they don't after ``iterations`` aggregates, or doubles can't tell more, that is warned of.
    """
    n = len(targets)
    p = [F.col(f"_p{d}") for d in range(n)]

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        got = rows.withColumn("_r", rate_column(steps, start)).agg(
            *[F.sum(F.col("_r") * F.col("_tokens") * p[d]).alias(f"s{d}") for d in range(n)],
            *[F.sum(F.when(F.col("_r") > 0, F.col("_tokens") * p[d] * p[e])).alias(f"m{d}_{e}") for d in range(n) for e in range(d, n)],
            F.max(F.when(F.col("_tokens") > 0, F.col("_r"))).alias("top"),
        ).first()
        second = np.array([[got[f"m{min(d, e)}_{max(d, e)}"] or 0.0 for e in range(n)] for d in range(n)])
        return np.array([got[f"s{d}"] or 0.0 for d in range(n)]), second, got["top"] or 0.0

    start = [1.0] * n
    steps: list[list[float]] = []
    target = np.array(targets, float)
    now, second, top = totals(steps)
    scans, scale, unit = 1, max(1.0, float(np.abs(target).sum())), float(np.trace(second))
    if not unit:
        return steps, start, now.tolist()
    ridge, best = 1e-4 * unit, (steps, now, np.inf)
    while True:
        weights = np.array([sum(x) for x in zip(start, *steps)])
        slope = now + ridge * weights - target
        off, miss = float(np.linalg.norm(slope)), now - target
        # miss + lift isn't negative along any row's posteriors, so no rates bring the totals nearer than along it
        along = miss + max(0.0, ridge * top) + off
        size = float(np.linalg.norm(along))
        excess = float(np.linalg.norm(miss)) - (max(0.0, -float(along @ target)) / size if size else 0.0)
        if excess < best[2]:
            best = steps, now, excess
        if excess <= close * scale:
            break
        if off <= max(1e-12 * scale, 1e-3 * ridge * float(np.linalg.norm(weights))):
            ridge /= 100
            if ridge < 1e-18 * unit:
                break
            continue
        step = np.linalg.solve(second + ridge * np.eye(n), -slope)
        # along the step the slope only grows: a point where at most half of it is left is found by bracketing
        first, low, high, pace = float(slope @ step), (0.0, float(slope @ step)), None, 1.0
        while scans < iterations:
            further = [*steps, (pace * step).tolist()]
            after, moved, highest = totals(further)
            scans += 1
            left = float((after + ridge * (weights + pace * step) - target) @ step)
            if abs(left) <= 0.5 * abs(first) or (high and high[0] - low[0] < 1e-9 * high[0]):
                break
            low, high = ((pace, left), high) if left < 0 else (low, (pace, left))
            pace = 2 * pace if high is None else low[0] + (high[0] - low[0]) * min(0.9, max(0.1, -low[1] / (high[1] - low[1])))
        else:
            break
        steps, now, second, top = further, after, moved, highest
    steps, now, excess = best
    if excess > close * scale:
        warnings.warn(f"mixing rates: after {scans} aggregates the totals miss the targets by up to {excess / scale:.3g} of their sum more than they need to", stacklevel=2)
    return steps, start, now.tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens (words), the four posteriors and rate, the copies to take on average.

    Targets are shares of the corpus's own token total. Null or empty texts have no tokens and the posteriors of no
    evidence. Null ids and repeated rows are rated like all others. If targets can't be reached with rates of 0 or
    more, the totals are as near as any rates bring them, within 1e-6 of the targets' sum; else a warning says what is missing.
    An empty table gives no rows.
    """
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    classifier = fit_classifier(slim, labels)
    rows = written(classifier.posteriors(slim).drop("text"), "mixing-posteriors")
    steps, start, _ = rates_for(rows, targets)
    return rows.select("doc_id", F.col("_tokens").alias("n_tokens"), *[F.col(f"_p{d}").alias(name) for d, name in enumerate(DOMAINS)], rate_column(steps, start).alias("rate"))


def rates_for(rows: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], list[float], list[float]]:
    total = rows.agg(F.sum("_tokens").alias("n")).first()["n"] or 0
    return solve_rates(rows, [targets.get(d, 0.0) * total for d in DOMAINS])


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_column: str = "doc_id", text_column: str = "text", seed: int = 11) -> DataFrame:
    """``docs`` with each row as often as its rate says, and the same columns.

    A rate's whole part is taken as it is and the rest by a number between 0 and 1 that a hash of the id and the text
    gives, so the expected number of copies is the rate and every run gives the same rows. Rows that agree in both
    have the same number.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"))
    packed = packed.withColumn("_chance", F.pmod(F.xxhash64(F.coalesce("_id", F.lit(-1)), F.col("_text"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    classifier = fit_classifier(packed, labels, id_column="_id", text_column="_text")
    # written once with the rows, so that neither the solver nor the copying reads a text for its posteriors again
    rows = written(classifier.posteriors(packed, "_text").drop("_text"), "mixing-rows")
    steps, start, _ = rates_for(rows, targets)
    copies = F.floor(rate_column(steps, start) + F.col("_chance")).cast("int")
    out = rows.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_k")).select("_row.*")
