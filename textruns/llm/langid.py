"""Language identification (operator 7): averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased; its subwords are all byte 3- and 4-grams inside a word of two bytes or more, padded with one boundary byte on either side, hashed into
``BUCKETS``. Their embeddings are averaged (each occurrence counts) and go through a linear softmax; both are trained by stochastic
gradient descent in numpy. A temperature fitted on held-out lines calibrates the softmax. A text is rejected if its calibrated
confidence is under a threshold, or if the share of its subwords seen in training falls under another one; both are set on held-out
texts and lines so that no more than ``LOSS`` of those rightly classified is lost to each, within fixed bounds (so a text in two languages passes).

Defined cases: a text without a subword (NULL, empty, only digits, punctuation or spaces) has language NULL, confidence 0 and is
rejected. Whole texts count, of any length. Repeated rows are scored alike. Extra columns pass through ``filter_language``.
NULL languages, ids and texts are left out of training; of rows that repeat a doc_id and language the smallest text is used. Without any labelled document every text is rejected; with one language only,
the seen share alone decides. The fit uses at most about ``bound`` documents, spread evenly over the languages by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._job import arrow_map, fitted
from ._text import pieces

BUCKETS = 1 << 15
DIM = 16
#: At most about so many documents are used to fit.
BOUND = 1_600
LOSS = 0.0005
SPARSE_STEP = 20.0

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword and the text that it belongs to, as counts a text: (buckets in text order, subwords of each text)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    # two padding bytes before each text, so that no subword crosses a border
    counts = np.diff(offsets)
    pad = np.zeros(n + 2 * len(counts) + 2, np.uint8)
    place = np.arange(n) + 2 * (np.repeat(np.arange(len(counts)), counts) + 1)
    pad[place] = np.where(_LETTER[data], data, 0)
    on = pad > 0
    x = pad.astype(np.uint32)
    inner = on[1:-2]
    h3 = ((x[:-3] * np.uint32(2654435761)) ^ (x[1:-2] * np.uint32(2246822519)) ^ (x[2:-1] * np.uint32(3266489917))) * np.uint32(668265263)
    h4 = (h3 ^ (x[3:] * np.uint32(374761393))) * np.uint32(2654435761)
    ok3 = inner & (on[:-3] | on[2:-1])
    ok4 = inner & on[2:-1]
    out = np.empty((len(h3), 2), np.int64)
    out[:, 0] = h3 >> np.uint32(17)
    out[:, 1] = (h4 ^ np.uint32(0x5BD1E995)) >> np.uint32(17)
    ok = np.stack([ok3, ok4], axis=1)
    begins = offsets[:-1] + 2 * np.arange(len(counts))  # of each text's padding; a subword belongs to the text of its second byte
    sums = np.zeros(len(h3) + 1, np.int64)
    np.cumsum(ok.sum(axis=1), out=sums[1:])
    edges = np.append(np.minimum(begins, len(h3)), len(h3))
    return out[ok], np.diff(sums[edges])


def _lower(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    return pc.utf8_lower(texts)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    seen: np.ndarray
    temperature: float
    least_confidence: float
    least_seen: float

    def logits(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, number of subwords, share of subwords seen in training."""
        logits, number, share = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for p in pieces(_lower(texts), 1 << 19):
            buckets, counts = subwords(p.data, p.offsets)
            some = np.flatnonzero(counts)
            at = np.concatenate([[0], np.cumsum(counts)])[:-1][some]
            if len(some):
                for j in range(len(self.languages)):
                    logits[p.lo + some, j] = np.add.reduceat(self.table[:, j][buckets], at) / counts[some]
                share[p.lo + some] = np.add.reduceat(self.seen[buckets].astype(np.float64), at) / counts[some]
            number[p.lo : p.hi] = counts
        return logits + self.bias, number, share

    def predict(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: none), calibrated confidence, rejected."""
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, number, share = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = np.where(number > 0, p.argmax(axis=1), -1)
        confidence = np.where(number > 0, p.max(axis=1), 0.0)
        return best, confidence, (number == 0) | (confidence < self.least_confidence) | (share < self.least_seen)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 3, seed: int = 0, rate: float = 0.2) -> LanguageModel:
    """Train on the lines of the texts and on the whole texts; every tenth text is held out for calibration."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS, bool), 1.0, 1.0, 1.0)
    label = np.array([names.index(x) for x in langs])
    held = np.arange(len(texts)) % 10 == 9
    if len(texts) < 40:
        held[:] = False
    rng = np.random.default_rng(seed)
    rows, ys = [], []
    for t, y, h in zip(texts, label, held, strict=True):
        if not h:
            parts = [t, *(x for x in t.split("\n") if x.strip())]
            rows += parts
            ys += [y] * len(parts)
    data, ptr, cnt = [], [0], []
    for p in pieces(_lower(pa.array(rows, pa.large_string()))):
        buckets, counts = subwords(p.data, p.offsets)
        at = 0
        for c in counts.tolist():
            u, k = np.unique(buckets[at : at + c], return_counts=True)
            at += c
            data.append(u.astype(np.int32))
            cnt.append((k / max(c, 1)).astype(np.float32))
            ptr.append(ptr[-1] + len(u))
    y = np.array(ys)
    idx, val, ptr = np.concatenate(data), np.concatenate(cnt), np.array(ptr)
    seen = np.zeros(BUCKETS, bool)
    seen[idx] = True
    # each language weighs the same
    per = np.bincount(y, minlength=len(names))
    weight = (len(y) / (len(names) * np.maximum(per, 1)))[y]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    order, total, done = np.arange(len(y)), epochs * len(y), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order.tolist():
            done += 1
            if ptr[r] == ptr[r + 1]:
                continue
            i, v = idx[ptr[r] : ptr[r + 1]], val[ptr[r] : ptr[r + 1], None]  # distinct buckets, so the update has no clashes
            mean = (v * emb[i]).sum(axis=0)
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[r]] -= 1
            g *= rate * weight[r] * (1 - done / total)
            back = out @ g
            out -= mean[:, None] * g
            bias -= 0.1 * g
            emb[i] -= SPARSE_STEP * v * back  # the averages of one bucket are small: embeddings get a larger step
    model = LanguageModel(names, emb @ out, bias, seen, 1.0, 0.0, 0.0)
    # calibrated on whole texts and on their lines, which are harder
    which = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    parts = [(x, label[i]) for i in which for x in (texts[i], *(x for x in texts[i].split("\n") if x.strip()))]
    truth = np.array([y_ for _, y_ in parts])
    logits, number, share = model.logits(pa.array([x for x, _ in parts], pa.large_string()))
    some = number > 0
    if some.any():
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(softmax(logits[some] / t)[np.arange(some.sum()), truth[some]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits[some] / model.temperature)
        right = p.argmax(axis=1) == truth[some]
        if right.any():
            model.least_confidence = float(np.clip(np.quantile(p.max(axis=1)[right], LOSS) * 0.9, 1.1 / max(len(names), 2), 0.45))
            model.least_seen = float(np.clip(np.quantile(share[some][right], LOSS) * 0.9, 0.2, 0.6))
    return model


def train(docs: DataFrame, bound: int = BOUND) -> LanguageModel:
    """Fit from ``docs`` (doc_id, text, lang)."""
    known = docs.select("doc_id", "text", "lang").dropna()
    counts = {r["lang"]: r["count"] for r in docs.select("doc_id", "lang").dropna().groupBy("lang").count().collect()}
    if not counts:
        return fit([], [])
    each = bound / len(counts)
    hashed, admitted = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), F.lit(False)
    for lang, n in sorted(counts.items()):
        admitted = admitted | ((F.col("lang") == lang) & (hashed < int((1 << 30) * min(1.0, each / n))))

    def run(rows: pd.DataFrame) -> LanguageModel:
        rows = rows.sort_values(["doc_id", "lang", "text"]).drop_duplicates(["doc_id", "lang"])
        return fit(rows["text"].tolist(), rows["lang"].tolist())

    return fitted(known.where(admitted).distinct(), run)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, predicted language (NULL where there is nothing to go by), calibrated confidence, rejected."""
    names = np.array([*model.languages, None], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, confidence, rejected = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(confidence), pa.array(rejected)], ["doc_id", "predicted", "confidence", "rejected"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, predicted string, confidence double, rejected boolean")


def filter_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language is recognised, with all their columns; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~model.predict(b.column("text"))[2]))

    return arrow_map(docs, run, docs.schema)
