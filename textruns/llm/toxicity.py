"""Toxicity (operator 3): cumulative-link ordinal regression over sparse word features.

Model: P(grade <= k | x) = sigmoid(theta_k - w.x) with one weight vector w shared by the ordered thresholds theta_1 <= ... <= theta_K.
x holds the presence of each word of the document and of each word beginning of ``STEMS`` bytes (inflected words share one); the whole text counts. The expected severity is sum_k P(grade > k), from 0 to K.

Training labels are binary. A document labelled 0 has grade 0. A document labelled 1 is graded 1 to ``GRADES`` by how many of its
features are *marked*, that is at least ``lift`` times as frequent among documents labelled 1: a grade for each ``len(STEMS)`` of them begun.

Defined cases: a NULL or empty text has no features and gets the severity of the bias alone, grade 0 unless most training documents are
toxic; it is kept. Repeated rows are scored one by one, alike. Extra columns pass through ``filter_toxic`` and are ignored by
``score``. NULL labels, ids and texts are left out of training. Without labelled documents of both classes nothing is rejected (severity 0).
The fit uses at most about ``bound`` labelled documents, chosen by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ._job import arrow_map, fitted, labelled_sample
from ._text import WORD_BYTE, Piece, distinct_per_owner, lookup, pieces, runs, span_hashes

#: At most about so many labelled documents are used to fit.
BOUND = 4_000
GRADES = 3
FOLDS = 3
#: A document is rejected when its expected severity reaches the model's ``cut``, fitted within these bounds.
CUTS = (0.1, 0.5)
#: Weight of the share of clean documents spared against the share of toxic ones caught.
SPARE = 2.0


#: Lengths in bytes of the word beginnings that are features.
STEMS = range(3, 10)


def stems(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and of its beginnings, in text order of each kind in turn, texts ascending."""
    lower = WORD_BYTE[p.data]
    starts, ends = runs(lower > 0, p.offsets)
    owner = np.repeat(np.arange(p.hi - p.lo), np.diff(np.searchsorted(starts, p.offsets)))
    size = ends - starts
    owners, begins, stops = [owner], [starts], [ends]
    for k in STEMS:
        # a beginning that ends within a character is as good as any
        on = np.flatnonzero(size > k)
        owners.append(owner[on])
        begins.append(starts[on])
        stops.append(starts[on] + k)
    return np.concatenate(owners), span_hashes(lower, np.concatenate(begins), np.concatenate(stops))


@dataclass
class OrdinalModel:
    keys: np.ndarray
    weights: np.ndarray
    theta: np.ndarray
    cut: float = CUTS[1]

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, from the linear scores."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.theta[None, :] - z[:, None]))

    def linear(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        out = np.zeros(len(texts))
        for p in pieces(texts):
            owner, found = stems(p)
            at = lookup(self.keys, found)
            hit = np.flatnonzero(at >= 0)
            owner, key, _ = distinct_per_owner(owner[hit], at[hit], p.hi - p.lo)
            out[p.lo : p.hi] = np.bincount(owner, weights=self.weights[key] if len(key) else None, minlength=p.hi - p.lo)
        return out

    def severity(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and most probable grade of each text."""
        if not len(self.theta):
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        above = self.above(self.linear(texts))
        full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        return above.sum(axis=1), np.argmax(full[:, :-1] - full[:, 1:], axis=1).astype(np.int32)


GAP = 0.05


def ordered(theta: np.ndarray) -> np.ndarray:
    """The nearest thresholds that rise by at least ``GAP``: averages of adjacent violators."""
    shift = GAP * np.arange(len(theta))
    blocks: list[list[float]] = []
    for x in theta - shift:
        blocks.append([x, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, n), (b, m) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return np.concatenate([np.full(int(n), x) for x, n in blocks]) + shift


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, n: int, d: int, grade: np.ndarray, levels: int, l1: float = 2e-3, steps: int = 150, most_weight: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal gradient with momentum (FISTA) on the mean log-loss plus an L1 penalty on the weights.

    The loss is convex in weights and thresholds together; thresholds are projected onto ordered ones, ``GAP`` apart, after each step.
    """
    top = np.arange(1, levels + 1)
    share = np.clip([(grade >= k).mean() for k in top], 1e-4, 1 - 1e-4)
    theta = ordered(np.log((1 - share) / share))
    w = np.zeros(d)
    weight = np.ones(n)
    weight[grade > 0] = np.clip((grade == 0).sum() / max(1, (grade > 0).sum()), 1, most_weight)
    weight /= weight.sum()
    # the step follows the largest curvature that the features allow: row norm squared / 4, by power iteration
    v = np.random.default_rng(0).random(d)
    for _ in range(15):
        u = np.bincount(rows, weights=v[cols], minlength=n) * weight
        v = np.bincount(cols, weights=u[rows], minlength=d)
        big = np.linalg.norm(v)
        v /= max(big, 1e-12)
    step = 1 / (0.5 * max(big, 1e-9) + 0.5)
    vw, vtheta, t = w.copy(), theta.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(rows, weights=vw[cols], minlength=n)
        cum = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(z[:, None] - vtheta, -500, 500))), np.ones((n, 1))], axis=1)  # P(grade <= k)
        hi, lo = cum[np.arange(n), grade + 1], cum[np.arange(n), grade]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gz = weight * (dhi - dlo) / p  # of -log p by z
        gtheta = np.zeros(levels)
        inner = grade < levels
        np.add.at(gtheta, grade[inner], -(weight * dhi / p)[inner])
        inner = grade > 0
        np.add.at(gtheta, grade[inner] - 1, (weight * dlo / p)[inner])
        gw = np.bincount(cols, weights=gz[rows], minlength=d)
        nw = vw - step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        ntheta = ordered(vtheta - step * gtheta)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        vw, vtheta = nw + m * (nw - w), ordered(ntheta + m * (ntheta - theta))
        w, theta, t = nw, ntheta, nt
    return w, theta


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of best weighted accuracy, within ``CUTS``; of equally good ones the middle (geometric)."""
    order = np.argsort(severity, kind="stable")
    s, y = severity[order], toxic[order]
    caught = 1 - np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    spared = np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum())
    score = caught + SPARE * spared
    at = np.flatnonzero(score >= score.max() - 1e-12)
    low = s[at[0] - 1] if at[0] else 1e-6
    high = s[at[-1]] if at[-1] < len(s) else max(s[-1], 1.0)
    return float(np.clip(np.sqrt(max(low, 1e-6) * max(high, 1e-6)), *CUTS))


def fit(texts: list[str], toxic: np.ndarray, grades: int = GRADES) -> OrdinalModel:
    """Fit from labelled texts, repeated ones counted once. The cut is chosen on severities of texts left out of the fit, in ``FOLDS`` parts."""
    frame = pd.DataFrame({"t": texts, "y": np.asarray(toxic).astype(int)}).drop_duplicates("t")
    column, y = frame["t"].tolist(), frame["y"].to_numpy()
    model = fit_once(column, y, grades)
    if len(model.theta) and len(y) >= 10 * FOLDS:
        left_out, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
        for k in range(FOLDS):
            here = np.flatnonzero(fold == k)
            other = fit_once([t for t, f in zip(column, fold, strict=True) if f != k], y[fold != k], grades)
            left_out[here] = other.severity(pa.array([column[i] for i in here], pa.large_string()))[0]
        model.cut = best_cut(left_out, y)
    return model


def fit_once(texts: list[str], y: np.ndarray, grades: int, lift: float = 20.0, features: int = 4096) -> OrdinalModel:
    """Weights and thresholds from distinct labelled texts.

    Features are the ``features`` words whose presence tells most about the label (chi-square) among those of 5 distinct training texts
    (2 if there are under 2,000 texts). An L1 fit with balanced classes chooses the support; a second fit on it undoes the shrinkage.
    """
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return none
    owners, keys, n = [], [], len(y)
    for p in pieces(pa.array(texts, pa.large_string())):
        o, k, _ = distinct_per_owner(*stems(p), p.hi - p.lo)
        owners.append((o + p.lo).astype(np.int32))
        keys.append(k)
    # most features are of one text: a count by a part of the hash drops those before anything is sorted
    least = 5 if n >= 2000 else 2
    counts = np.zeros(1 << 20, np.int32)
    for k in keys:
        counts += np.bincount(k >> np.uint64(44), minlength=1 << 20).astype(np.int32)
    often = [counts[k >> np.uint64(44)] >= least for k in keys]
    owner, key = np.concatenate([o[x] for o, x in zip(owners, often, strict=True)]), np.concatenate([k[x] for k, x in zip(keys, often, strict=True)])
    del owners, keys
    vocab, cols, df = np.unique(key, return_inverse=True, return_counts=True)
    of_toxic = np.bincount(cols, weights=y[owner].astype(float), minlength=len(vocab))
    expected = df * y.mean()
    chi = np.where(df >= least, (of_toxic - expected) ** 2 / (expected * (1 - y.mean())), -1.0)
    told = np.zeros(len(vocab), bool)
    told[np.argsort(-chi, kind="stable")[:features]] = True
    keep = (told & (chi >= 0))[cols]
    owner, cols = owner[keep], cols[keep]
    used, cols = np.unique(cols, return_inverse=True)
    vocab = vocab[used]
    if not len(vocab):
        return none
    of_toxic = np.bincount(cols, weights=y[owner].astype(float), minlength=len(vocab))
    of_clean = np.bincount(cols, minlength=len(vocab)) - of_toxic
    marked = (of_toxic + 0.5) / (y.sum() + 1) > lift * (of_clean + 0.5) / (n - y.sum() + 1)
    hits = np.bincount(owner, weights=marked[cols].astype(float), minlength=n)
    grade = np.where(y > 0, np.clip(np.ceil(hits / len(STEMS)), 1, grades), 0).astype(int)
    w, theta = fit_ordinal(owner, cols, n, len(vocab), grade, grades)
    on = np.flatnonzero(w)
    if not len(on):
        return OrdinalModel(vocab[on], w[on], theta)
    keep = w[cols] != 0
    w, theta = fit_ordinal(owner[keep], np.searchsorted(on, cols[keep]), n, len(on), grade, grades, l1=1e-4, steps=400, most_weight=1.0)
    return OrdinalModel(vocab[on], w, theta)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> OrdinalModel:
    def run(rows: pd.DataFrame) -> OrdinalModel:
        rows = rows.sort_values("doc_id")
        return fit(rows["text"].tolist(), rows["toxic"].to_numpy())

    return fitted(labelled_sample(docs, labels, ["toxic"], bound), run)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected severity, most probable grade, and whether the document is rejected; one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            severity, grade = model.severity(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(severity), pa.array(grade), pa.array(severity >= model.cut)], ["doc_id", "severity", "grade", "rejected"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, severity double, grade int, rejected boolean")


def filter_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that are not rejected, with all their columns; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            severity, _ = model.severity(b.column("text"))
            yield b.filter(pa.array(severity < model.cut))

    return arrow_map(docs, run, docs.schema)
