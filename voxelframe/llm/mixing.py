"""Mixing sources to target weights, with soft membership.

A classifier fitted on the labelled table predicts every document's posterior over domains (good, poor, toxic).
Distributed projected gradients then fit one nonnegative rate a document so that the expected domain token totals,
sum(rate * tokens * posterior), come as near as possible to the targets in the least-squares sense. A gradient step needs only the domain
totals, a handful of sums, so each iteration is one aggregation; rates are recomputed from the short list of steps and
nothing else is kept. Each iteration tries a few step lengths at once, so the squared distance never rises.

Defined cases: a null or empty text has no tokens and keeps rate 1; a null doc_id is kept; labels of absent documents
and null labels are not used; repeated label rows count once (the largest values); without labelled rows every
posterior is even; repeated documents get equal rates; an empty table gives no row; other columns pass through
``apply_rates``. Targets that are not met, because no rates can or the iterations end, are told by the column ``met``
and by a warning with the totals that are reached. In the metric of the second moments the first step often meets them:
with no rate at its bound the problem is a linear one; more steps are for rates that the bound stops.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise

from .common import mapped, slices, unused

DOMAINS = ("good", "poor", "toxic")
SYMBOLS = "#*$%&|<>!?@"
#: Shares of the words, as bounds of the bins of each counted ratio.
BINS = (0.0, 0.02, 0.1, 0.5)
#: Lengths of a step that are tried at once: shares of the whole scaled step, and multiples of the safe plain step.
LENGTHS, PLAIN = (1.0, 0.5, 0.1), (1.0, 10.0, 100.0)


def features(text: str) -> tuple[set[str], int]:
    """Distinct lower-cased words and the bins of a few ratios, and the number of words."""
    words = text.lower().split()
    n = len(words)
    found = set(words)
    if n:
        counted = {c: text.count(c) for c in SYMBOLS}
        counted["all"] = sum(counted.values())
        counted["again"] = sum(a == b for a, b in zip(words, words[1:], strict=False))
        counted["distinct"] = n - len(found)
        for name, x in counted.items():
            found.add(f" {name}:{sum(x / n > b for b in BINS)}")
        found.add(f" length:{n.bit_length()}")
    return found, n


@dataclass
class Classifier:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, found: set[str]) -> np.ndarray:
        rows = [self.vocabulary[w] for w in self.vocabulary.keys() & found]
        score = self.bias + self.weights[rows].sum(axis=0)
        p = np.exp(score - score.max())
        return p / p.sum()


def fit(vocabulary: list[str], rows: list[tuple[list[int], int]], epochs: int = 200) -> Classifier:
    """Multinomial logistic regression; a row is the places of its features in ``vocabulary`` and its domain."""
    k = len(DOMAINS)
    if not rows:
        return Classifier({}, np.zeros((0, k)), np.zeros(k))
    y = np.array([d for _, d in rows])
    totals = np.bincount(y, minlength=k)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (places, _) in enumerate(rows):
        x[i, places] = 1
    weights, bias = np.zeros((len(vocabulary), k)), np.log((totals + 1) / (totals.sum() + k))
    seen, seen_b = np.full_like(weights, 1e-6), np.full(k, 1e-6)
    gold = np.eye(k)[y]
    for _ in range(epochs):
        score = x @ weights.astype(np.float32) + bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g, b = x.T @ (gold - p).astype(np.float32) / len(rows) - 2e-4 * weights, (gold - p).mean(axis=0)
        seen += g**2
        seen_b += b**2
        weights += 0.5 * g / np.sqrt(seen)
        bias += 0.1 * b / np.sqrt(seen_b)
    return Classifier({w: i for i, w in enumerate(vocabulary)}, weights, bias)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, size: int = 1000) -> Classifier:
    """Fit on at most ``train_rows`` labelled documents, the first in hash order of doc_id (a documented bound).

    The ``size`` features that separate the domains most are chosen by counts over that sample.
    """
    usable = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    by = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    first = by.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows rows: small enough for every task.
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(first), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sorted(features(t or "")[0]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["found", "domain"])

    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    sample = mapped(chosen.select("text", domain.cast("int").alias("domain")), run, "found array<string>, domain int")
    sample = materialise(sample, "mix-sample")
    k = len(DOMAINS)
    totals = np.zeros(k)
    for r in sample.groupBy("domain").count().collect():
        totals[r["domain"]] = r["count"]
    counts = sample.select("domain", F.explode("found").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"c{d}") for d in range(k))
    )
    share = F.col("n") / float(max(1.0, totals.sum()))
    scores = [F.abs(F.col(f"c{d}") - share * float(t)) / F.sqrt(share * (1 - share) * float(t) + 1) for d, t in enumerate(totals)]
    best = counts.where("n >= 5").orderBy(F.greatest(*scores).desc(), "word").limit(size)
    vocabulary = [r["word"] for r in best.select("word").collect()]
    known = F.array(*(F.lit(w) for w in vocabulary)) if vocabulary else F.array().cast("array<string>")
    held = sample.select("domain", F.array_intersect("found", known).alias("found")).collect()
    place = {w: i for i, w in enumerate(vocabulary)}
    return fit(vocabulary, sorted((sorted(place[w] for w in r["found"]), r["domain"]) for r in held))


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens (words of the whole text) and one posterior a domain. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # a bounded number of features

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            both = [features(t or "") for t in batch.column(1).to_pylist()]
            p = np.array([shared.value.posterior(f) for f, _ in both])
            columns = [batch.column(0), pa.array([n for _, n in both], pa.int64()), *(pa.array(p[:, j]) for j in range(len(DOMAINS)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    schema = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


Steps = list[tuple[np.ndarray, np.ndarray]]


def rate(steps: Steps) -> Column:
    """The rate after the projected steps, from 1; documents without tokens keep 1.

    A step is the gradient by domain, g, and the move, s: a rate becomes max(0, rate - posterior . s), but one at zero
    whose gradient keeps it there stays.
    """
    moved = F.lit(1.0)
    if steps:
        told = lambda v: "array(" + ", ".join(f"{float(x)!r}D" for x in v) + ")"
        pairs = ", ".join(f"struct({told(g)} as g, {told(s)} as s)" for g, s in steps)
        dot = lambda v: " + ".join(f"p_{d} * x.{v}[{j}]" for j, d in enumerate(DOMAINS))
        moved = F.expr(f"aggregate(array({pairs}), 1.0D, (w, x) -> if(w <= 0 and {dot('g')} >= 0, 0.0D, greatest(0.0D, w - ({dot('s')}))))")
    return F.when(F.col("n_tokens") > 0, moved).otherwise(F.lit(1.0))


@dataclass
class Fit:
    """Steps of the descent, the targets and the expected totals after the last step, and whether these meet."""

    steps: Steps
    target: np.ndarray
    totals: np.ndarray
    met: bool


def fit_rates(
    members: DataFrame, weights: dict[str, float], total: float | None = None, iterations: int = 25, tolerance: float = 1e-4
) -> Fit:
    """Fit the rates by projected gradients.

    ``weights`` are multiples of the domains' expected totals; with ``total`` their tokens are scaled to that sum. A
    step is the projected gradient, plain or in the metric of the second moments of the documents that are free to move;
    of several lengths the one that leaves the least distance is taken, and the plain step always brings it nearer.
    The fit ends when every total is within ``tolerance`` of its target, when no step brings it nearer, or after
    ``iterations``.
    """
    members = members.where("n_tokens > 0")
    k = len(DOMAINS)
    n, p = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in DOMAINS]

    def asked(sums: list[Column], rows: DataFrame = members) -> list[float]:
        return [x or 0.0 for x in rows.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()]

    def totals_of(tried: list[Steps]) -> np.ndarray:
        rates = members.select("n_tokens", *p, *(rate(steps).alias(f"w{c}") for c, steps in enumerate(tried)))
        return np.array(asked([F.sum(F.col(f"w{c}") * n * x) for c in range(len(tried)) for x in p], rates)).reshape(len(tried), k)

    def moments(steps: Steps, off: np.ndarray) -> np.ndarray:
        """Second moments of the documents that a step may move."""
        push = sum((x * float(g) for x, g in zip(p, off, strict=True)), F.lit(0.0))
        free = (rate(steps) > 0) | (push < 0)
        weight = F.when(free, n).otherwise(0.0)
        found = dict(zip([(i, j) for i in range(k) for j in range(i, k)], asked([F.sum(weight * p[i] * p[j]) for i in range(k) for j in range(i, k)]), strict=True))
        return np.array([[found[min(i, j), max(i, j)] for j in range(k)] for i in range(k)])

    steps: Steps = []
    totals = totals_of([steps])[0]
    target = np.array([weights.get(d, 1.0) for d in DOMAINS]) * totals
    if total is not None and target.sum() > 0:
        target = target * (total / target.sum())
    scale = max(1.0, target.sum())
    steepest = None
    for _ in range(iterations):
        off = totals - target
        if np.abs(off).max() <= tolerance * scale:
            break
        h = moments(steps, off)
        if steepest is None:
            # With every document free the moments are largest, and this length is safe for all later steps.
            steepest = max(1e-9, float(np.linalg.eigvalsh(h).max()))
        whole = np.linalg.solve(h + np.eye(k) * max(1e-9, 1e-6 * np.trace(h)), off)
        tried = [[*steps, (off, x * whole)] for x in LENGTHS] + [[*steps, (off, x * off / steepest)] for x in PLAIN]
        found = totals_of(tried)
        left = np.square(found - target).sum(axis=1)
        best = int(left.argmin())
        if left[best] >= (1 - 1e-6) * np.square(off).sum():
            break
        steps, totals = tried[best], found[best]
    met = bool(np.abs(totals - target).max() <= tolerance * scale)
    if not met:
        warnings.warn(f"mixing targets {target.tolist()} are not met: the totals are {totals.tolist()}", stacklevel=2)
    return Fit(steps, target, totals, met)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors and rate of every document, and whether the targets are ``met``."""
    members = materialise(posteriors(docs, train(docs, labels)), "mix-members")
    fitted = fit_rates(members, weights, total)
    return members.withColumn("rate", rate(fitted.steps)).withColumn("met", F.lit(fitted.met))


def apply_rates(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each document as often as its rate says: whole copies, and one more by a hash of its id, so the
    expected totals are those that were fitted. Rows whose doc_id is null stay once.
    """
    copies, again = unused(docs.columns, "_copies"), unused(docs.columns, "_again")
    # 30 bits of a hash: a share in [0, 1).
    rest = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    many = mixed.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.col("rate") + rest)).alias(copies))
    joined = docs.join(many.where(F.col(copies) != 1), "doc_id", "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    out = joined.where(F.col(copies) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*(f"`{c}`" for c in docs.columns))
