"""Quality classifier (operator 1): document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Evidence: a logistic regression over ratios of the exact measurements of ``measures``, fitted on labelled documents by penalised Newton steps.
A document's host is its ``source``, its path ``source``/``lang``. Grouped aggregation gives each path and host its number of documents and
the sum of their classifier probabilities, over the whole corpus. Beta priors are estimated from the groups themselves by the method of moments: hosts shrink toward
the global mean, paths toward their host, the more the sparser they are and the less such groups differ. A document's own
probability is taken out of its groups before they count for it. Its posterior log-odds are the classifier's plus
the path posterior's, relative to the global mean. It is kept at a posterior of at least ``KEEP_AT``.

Defined cases: NULL and empty texts measure as zero words and get what the classifier says of those; NULL source or lang is a group of its own (an empty
name); repeated rows count each; NULL ids pass through; extra columns are ignored; without labelled documents of both classes the evidence is 0
for all, and all are kept; an empty table gives no rows. The fit uses at most about ``BOUND`` labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._job import arrow_map, fitted, labelled_sample, materialize
from .measures import measure

BOUND = 8_000
KEEP_AT = 0.5


def features(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    m = {k: v.astype(np.float64) for k, v in measure(texts).items()}
    words, size, letters, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_bytes"], 1), np.maximum(m["n_upper"] + m["n_lower"], 1), np.maximum(m["n_lines"], 1)
    ratios = [
        m["n_symbols"] / size, m["n_upper"] / letters, m["n_bangs"] / words, m["n_bars"] / words, m["n_repeats"] / words, 1 - m["n_distinct"] / words, 1 - m["n_pairs"] / words,
        1 - m["n_distinct_lines"] / lines, m["n_digits"] / size, m["word_bytes"] / words / 10, np.minimum(m["longest_word"], 200) / 50,
    ]
    x = np.stack(ratios, axis=1)
    length = np.log1p(m["n_words"])[:, None] / 5
    # of short texts ratios say less: each also counts with the length
    return np.concatenate([x, np.minimum(x, 0.1) * 10, x[:, :8] * length, length], axis=1)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.bias)
        z = (features(texts) - self.mean) / self.scale @ self.weights + self.bias
        return np.clip(z, -12, 12)


def fit(texts: list[str], good: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
    none = np.zeros(0)
    y = np.asarray(good).astype(float)
    if not len(y) or y.min() == y.max():
        return Logistic(none, none, none, 0.0)
    x = features(pa.array(texts, pa.large_string()))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Logistic:
    def run(rows: pd.DataFrame) -> Logistic:
        rows = rows.sort_values("doc_id")
        return fit(rows["text"].tolist(), rows["quality"].to_numpy())

    return fitted(labelled_sample(docs, labels, ["quality"], bound), run)


def evidence(docs: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, host, path, log_odds and p of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.log_odds(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(z), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "host", "path", "log_odds", "p"])

    host = F.coalesce("source", F.lit(""))
    source = docs.select("doc_id", "text", host.alias("host"), F.concat_ws("/", host, F.coalesce("lang", F.lit(""))).alias("path"))
    return arrow_map(source, run, "doc_id long, host string, path string, log_odds double, p double")


def strength(groups: int, n: float, squares: float, spread: float, variance: float) -> float:
    """Prior weight, in documents, of groups with mean-square ``spread`` = sum n_g (rate_g - centre_g)^2, by the method of moments.

    ``n`` is sum n_g, ``squares`` sum n_g^2, ``variance`` that of one document around its group. Bounded to 1 .. 10^6.
    """
    if groups < 2 or n <= groups or variance <= 0:
        return 1e6
    between = (spread - (groups - 1) * variance) / max(n - squares / n, 1e-9)
    return float(np.clip(variance / between, 1.0, 1e6)) if between > 0 else 1e6


def combine(scores: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Posterior of each row of ``scores`` (doc_id, host, path, log_odds, p), from grouped aggregates of all rows."""
    paths = materialize(scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("y"), F.sum(F.col("p") * F.col("p")).alias("yy")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("y").alias("hy")), "hosts")
    t = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), F.sum(F.col("yy") - F.col("y") * F.col("y") / F.col("n")).alias("within")).first()
    mean = min(max(t["y"] / max(t["n"], 1), 1e-4), 1 - 1e-4)
    variance = max((t["within"] or 0.0) / max(t["n"], 1), 1e-9)
    h = hosts.agg(F.count("*").alias("g"), F.sum(F.col("hn").cast("double") * F.col("hn")).alias("s"), F.sum(F.col("hn") * F.pow(F.col("hy") / F.col("hn") - mean, 2)).alias("d")).first()
    both = paths.join(hosts, "host")
    p = both.agg(F.count("*").alias("g"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s"), F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("hy") / F.col("hn"), 2)).alias("d")).first()
    mh, mp = strength(h["g"], t["n"], h["s"] or 0, h["d"] or 0, variance), strength(p["g"] - h["g"] + 1, t["n"], p["s"] or 0, p["d"] or 0, variance)
    host = (F.col("hy") - F.col("p") + mh * mean) / (F.col("hn") - 1 + mh)
    path = (F.col("y") - F.col("p") + mp * F.col("host_posterior")) / (F.col("n") - 1 + mp)
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = scores.join(both.select("path", "host", "n", "y", "hn", "hy"), ["host", "path"])
    out = joined.withColumn("host_posterior", bounded(host)).withColumn("path_posterior", bounded(path))
    logit = lambda c: F.log(c / (1 - c))
    out = out.withColumn("quality", 1 / (1 + F.exp(-(F.col("log_odds") + logit(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))))))
    return out.select("doc_id", "host", "path", "log_odds", "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep_at).alias("keep"))


def classify(docs: DataFrame, model: Logistic, keep_at: float = KEEP_AT) -> DataFrame:
    return combine(materialize(evidence(docs, model), "evidence"), keep_at)
