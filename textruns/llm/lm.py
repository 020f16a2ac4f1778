"""Language-model scoring (operator 4): a log-bilinear model trained in numpy with noise-contrastive estimation.

Tokens are words, and each *known* word, one that the corpus has ``KNOWN`` times or more, has a probability of its own. The model's units are the ``HEADS`` most
frequent of them (ties: smaller hash), ``ENDINGS`` classes of the others by a hash of their last three bytes, one unit for all rarer words and one that pads
the start of a document. The score of unit u after (c1, c2) is s = (C1 r[c1] + C2 r[c2]) . q[u] + b[u], with context and target embeddings r and q and one
matrix for each context position. A word's probability is its unit's times its share within the unit: 1 for a head, its count in that of the class, or
for a rarer word the probability of its spelling by byte trigrams, learnt from the rare words and normalised over all byte strings. (Spellings of
known words keep their part of that, so all words together have slightly less than 1.)

Training covers all documents. Words are counted over the whole corpus. Every document belongs to a chunk of about ``CHUNK`` tokens by a hash of its id and
text; in ``ROUNDS`` rounds a copy of the model is trained on each chunk (NCE with noise from the unigram distribution, shared in a
minibatch) and the copies, one binary vector each, are averaged in a tree, weighted by tokens. So the model depends on the rows alone, not on
how they are partitioned. The counts are a table as large as the corpus's vocabulary. What is broadcast is the known words, at 12 bytes
each: if there are over ``MOST_KNOWN`` of them, ``KNOWN`` is doubled for this corpus until there are not, and the words under it are spelled.

Scoring is normalised exactly. As s is a sum over the two context positions, Z(c1, c2) = sum_u exp(A[c1, u]) exp(B[c2, u]): one product of two
V x V matrices holds the normaliser of every context, and a unit's log-probability is A[c1, u] + B[c2, u] - log Z[c1, c2].

Defined cases: a document without words (NULL, empty) has no tokens, log-probability 0, and NULL mean and perplexity; NULL ids pass through; repeated
rows are scored alike (and count in training as often as they stand); ties are by hash; extra columns are ignored; an empty corpus gives a model
that spells every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._job import arrow_map, discard, materialize, release, ship
from ._text import WORD_BYTE, Piece, Words, lookup, lookup_hashes, mix, pieces, together, words

HEADS = 1022
ENDINGS = 256
KNOWN = 2
MOST_KNOWN = 1 << 23
DIM = 16
ROUNDS = 2
NOISE = 128
BATCH = 2048
#: Tokens whose noise scores are made at once; the sums differ by rounding only.
BLOCK = 256
HEAVY = 8
RATE = 0.05
#: Tokens of a chunk, about.
CHUNK = 1 << 21
#: Vectors averaged by one task, or at last by the driver.
TOGETHER = 64
UNKNOWN, START = 0, 1
EDGE = 256  # symbol before and after a word's bytes
SMOOTH = 5


def endings(piece: Piece, w: Words) -> np.ndarray:
    """The class of each word by its last three bytes."""
    x = np.zeros(len(w.ends), np.uint64)
    for k in (1, 2, 3):
        x = x << np.uint64(8) | np.where(w.ends - k >= w.starts, WORD_BYTE[piece.data[np.maximum(w.ends - k, 0)]], 0).astype(np.uint64)
    return (mix(x) % np.uint64(ENDINGS)).astype(np.int16)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, its class, occurrences) over all documents; each partition sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w.hashes, endings(p, w)) for p in pieces(b.column("text")) for w in [words(p)]]
            keys = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            kind = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int16)
            order, first = together(keys)
            n, first = np.diff(np.append(first, len(keys))), order[first]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(kind[first]), pa.array(n)], ["word", "ending", "n"])

    return arrow_map(docs.select("text"), run, "word long, ending short, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def trigrams(piece: Piece, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte trigrams of words, each closed by ``EDGE``, and the first one of each word."""
    n = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(n)])
    c = np.full(at[-1], EDGE, np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    where = np.repeat(starts - at[:-1], n) + np.arange(at[-1])
    c[inner] = WORD_BYTE[piece.data[where[inner]]]
    p1, p2 = np.append(EDGE, c[:-1])[: len(c)], np.append([EDGE, EDGE], c[:-2])[: len(c)]
    p1[at[:-1]] = p2[at[:-1]] = p2[at[:-1] + 1] = EDGE
    return (p2 * 257 + p1) * 257 + c, at[:-1]


class Spelling:
    """Byte trigrams, smoothed by bigrams, and these by single bytes; the counts are of ``trigrams``."""

    def __init__(self, codes: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.n = codes[order], n[order].astype(float)
        self.pairs = np.bincount(self.codes % 257**2, weights=self.n, minlength=257**2)
        self.contexts = np.bincount(self.codes // 257, weights=self.n, minlength=257**2)
        self.singles = (np.bincount(self.codes % 257, weights=self.n, minlength=257) + 1) / (self.n.sum() + 257)

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        at = lookup(self.codes, codes)
        seen = np.where(at >= 0, self.n[at] if len(self.n) else 0.0, 0.0)
        pair = codes % 257**2
        two = (self.pairs[pair] + SMOOTH * self.singles[codes % 257]) / (self.pairs.reshape(257, 257).sum(axis=1)[pair // 257] + SMOOTH)
        return np.log((seen + SMOOTH * two) / (self.contexts[codes // 257] + SMOOTH))


@dataclass
class LogBilinear:
    words: np.ndarray  # sorted hashes of the known words
    ids: np.ndarray  # their units
    context: np.ndarray  # V x d
    first: np.ndarray  # d x d, for the word before the last
    second: np.ndarray  # d x d, for the last word
    target: np.ndarray  # V x d
    bias: np.ndarray
    share: np.ndarray  # log of each known word's share of its unit
    spelling: Spelling  # of the words that are not known

    @property
    def size(self) -> int:
        return len(self.bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.first, self.second, self.target, self.bias)]).astype(np.float32)

    def replaced(self, flat: np.ndarray) -> LogBilinear:
        parts, at = [], 0
        for x in (self.context, self.first, self.second, self.target, self.bias):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float64))
            at += x.size
        return replace(self, **dict(zip(("context", "first", "second", "target", "bias"), parts, strict=True)))

    def within(self, piece: Piece, w: Words, at: np.ndarray) -> np.ndarray:
        """Log-probability of each word within its unit."""
        out = np.where(at >= 0, self.share[at] if len(self.share) else 0.0, 0.0).astype(np.float64)
        rare = np.flatnonzero(at < 0)
        if len(rare):
            codes, first = trigrams(piece, w.starts[rare], w.ends[rare])
            out[rare] = np.add.reduceat(self.spelling.log_probs(codes), first)
        return out

    def units(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, last and last but one of every position; ``at`` is each word's place among the known ones."""
        t = np.where(at >= 0, self.ids[at] if len(self.ids) else UNKNOWN, UNKNOWN).astype(np.int64)
        c2, c1 = np.append(START, t[:-1])[: len(t)], np.append([START, START], t[:-2])[: len(t)]
        heads = w.at[:-1][np.diff(w.at) > 0]
        c2[heads] = c1[heads] = START
        c1[w.at[:-1][np.diff(w.at) > 1] + 1] = START
        return t, c2, c1

    def code(self, t: np.ndarray, c2: np.ndarray, c1: np.ndarray) -> np.ndarray:
        """(c1, c2, t) as one number."""
        return ((c1 * self.size + c2) * self.size + t).astype(np.int32 if self.size**3 < 1 << 31 else np.int64)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A, B and log Z over all contexts, float32. Words that start no prediction (START) get no probability."""
        a = self.context @ self.first @ self.target.T
        b = self.context @ self.second @ self.target.T + self.bias
        b[:, START] = -np.inf
        top = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.exp(a - top[0]) @ np.exp(b - top[1]).T
        return a.astype(np.float32), b.astype(np.float32), (np.log(z) + top[0] + top[1].T).astype(np.float32)


def initial(hashes: np.ndarray, ids: np.ndarray, share: np.ndarray, counts: np.ndarray, spelling: Spelling, dim: int = DIM, seed: int = 0) -> tuple[LogBilinear, np.ndarray]:
    """The model before training, with unigram biases, and the noise distribution, from the tokens of each unit."""
    n = np.maximum(counts.astype(float), 1)
    n[START] = 0
    noise = n / n.sum()
    size, rng, order = len(n), np.random.default_rng(seed), np.argsort(hashes)
    bias = np.log(np.maximum(noise, 1e-9))
    return LogBilinear(hashes[order], ids[order], rng.normal(0, 0.3, (size, dim)), np.eye(dim) * 0.5, np.eye(dim), rng.normal(0, 0.05, (size, dim)), bias, share[order], spelling), noise


class Trainer:
    """NCE by Adagrad on minibatches.

    Embeddings pass through the two matrices once a step and not once a token, a unit's bias is the last number of its target embedding, and the
    scores of noise words are made ``BLOCK`` tokens at a time, within the cache. As the logistic function of s is (1 + tanh(s / 2)) / 2, its
    sums are taken over the hyperbolic tangents alone.
    """

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: Any, rate: float = RATE, k: int = NOISE) -> None:
        self.m, self.rate, self.k = model, rate, k
        self.p = [np.array(x, np.float32, order="C") for x in (model.context, model.first, model.second, np.column_stack([model.target, model.bias]))]
        self.g2 = [np.full(x.shape, 1e-2, np.float32) for x in self.p]
        self.rng, self.cum, self.logn = np.random.default_rng(seed), np.cumsum(noise), np.log(np.maximum(noise * k, 1e-12)).astype(np.float32)

    def step(self, t: np.ndarray, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        r, m1, m2, q = self.p
        v, d = r.shape
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(self.k)), v - 1)
        h = np.ones((len(t), d + 1), np.float32)
        np.add((r @ m1).take(c1, axis=0), (r @ m2).take(c2, axis=0), out=h[:, :d])
        less = q.copy()
        less[:, d] -= self.logn
        qt, qn = less.take(t, axis=0), less.take(noise, axis=0)
        share = (w / w.sum()).astype(np.float32)[:, None]
        yes = share / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qt), -30, 30)))[:, None]  # 1 - P(data)
        # - P(data) of noise is -share / 2 times 1 + tanh
        half, by = share / -2, h * (share / -2)
        qh, qd = (qn / 2).T, np.ascontiguousarray(qn[:, :d])
        gh, gn = np.empty((len(t), d), np.float32), np.zeros((self.k, d + 1), np.float32)
        for a in range(0, len(t), BLOCK):
            s = h[a : a + BLOCK] @ qh
            np.tanh(s, out=s)
            np.matmul(s, qd, out=gh[a : a + BLOCK])
            gn += s.T @ by[a : a + BLOCK]
        gn += np.ones(len(t), np.float32) @ by
        gh += qd.sum(axis=0)
        gh *= half
        gh += yes * qt[:, :d]
        s1, s2 = self._rows(c1, gh, v), self._rows(c2, gh, v)
        grads = [s1 @ m1.T + s2 @ m2.T, r.T @ s1, r.T @ s2, self._rows(np.concatenate([t, noise]), np.concatenate([yes * h, gn]), v)]
        for p, g, a in zip(self.p, grads, self.g2, strict=True):
            g *= np.float32(100)
            a += g * g
            p += self.rate * g / np.sqrt(a)

    @staticmethod
    def _rows(at: np.ndarray, values: np.ndarray, v: int) -> np.ndarray:
        d = values.shape[1]
        cells = np.arange(v * d).reshape(v, d).take(at, axis=0)
        return np.bincount(cells.ravel(), weights=values.ravel(), minlength=v * d).reshape(v, d).astype(np.float32)

    def run(self, codes: np.ndarray, n: np.ndarray, batch: int = BATCH) -> None:
        """One pass over distinct coded (c1, c2, t) of ``n`` occurrences. Equal ones are trained together, with a weight; heavy ones in parts of at most ``HEAVY``."""
        times = -(-n // HEAVY)
        codes, weight = np.repeat(codes, times), np.repeat((n / times).astype(np.float32), times)
        v = self.m.size
        order = self.rng.permutation(np.arange(len(codes), dtype=np.int32))
        for a in range(0, len(order), batch):
            o = order[a : a + batch]
            c = codes.take(o)
            rest = c // v
            c1 = rest // v
            self.step(c - rest * v, rest - c1 * v, c1, weight.take(o))

    def flat(self) -> np.ndarray:
        *others, q = self.p
        return np.concatenate([x.ravel() for x in (*others, q[:, :-1], q[:, -1])])


def untrained(docs: DataFrame, dim: int = DIM, seed: int = 0) -> tuple[LogBilinear, np.ndarray, int]:
    """The model before training but for its spelling, the noise, and the number of tokens, from word counts over all documents."""
    counts = materialize(word_counts(docs), "words")
    n = F.col("n")
    power = counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("k")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).toPandas()
    total, least = int(power["tokens"].sum()), KNOWN
    while power["words"][power["k"] >= np.log2(least)].sum() > MOST_KNOWN:
        least *= 2
    known = counts.where(n >= least)
    top = known.orderBy(F.desc("n"), "word").limit(HEADS).toPandas()
    head, often = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    tail = known.where((n < int(often[-1])) | (n == int(often[-1])) & (F.col("word") > int(head[-1]))) if len(head) else known
    rest = tail.select("word", "ending", "n").toArrow()
    word, ending, times = (rest.column(c).to_numpy() for c in ("word", "ending", "n"))
    sums = np.bincount(ending, weights=times, minlength=ENDINGS).astype(np.int64)
    ids = np.concatenate([np.arange(len(head)) + 2, ending.astype(np.int64) + len(head) + 2]).astype(np.int16)
    share = np.concatenate([np.zeros(len(head)), np.log(times / sums[ending])]).astype(np.float32)
    tokens = np.concatenate([[total - often.sum() - sums.sum(), 0], often, sums])
    model, noise = initial(np.concatenate([head, word]).view(np.uint64), ids, share, tokens, Spelling(np.zeros(0, np.int64), np.zeros(0)), dim, seed)
    discard(counts)
    return model, noise, total


def gathered(docs: DataFrame, model: LogBilinear, chunks: int) -> DataFrame:
    """chunk, codes, n: a row for the distinct (c1, c2, t) of each chunk from 0 on, and rows of negative numbers for the trigrams of rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            chunk_of, spelled = b.column("chunk").to_numpy(), []
            for p in pieces(b.column("text")):
                w = words(p)
                at = lookup_hashes(own.words, w.hashes)
                rare = at < 0
                spelled.append(trigrams(p, w.starts[rare], w.ends[rare])[0])
                chunk = np.repeat(chunk_of[p.lo : p.hi], np.diff(w.at))
                order = np.argsort(chunk, kind="stable")
                codes = own.code(*own.units(w, at))[order]
                found, first = np.unique(chunk[order], return_index=True)
                offsets = pa.array(np.append(first, len(codes)).astype(np.int32))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(found) + 1, np.int32)), pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.ListArray.from_arrays(offsets, pa.array(codes)), none], ["chunk", "codes", "n"])
            codes, m = np.unique(np.concatenate(spelled) if spelled else np.zeros(0, np.int64), return_counts=True)
            if len(codes):
                ends = pa.array(np.array([0, len(codes)], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(-1 - chunk_of[:1]), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(m.astype(np.int32)))], ["chunk", "codes", "n"])

    def merge(t: pa.Table) -> pa.Table:
        try:
            return merged(t)
        finally:
            release()

    def merged(t: pa.Table) -> pa.Table:
        codes = np.concatenate([c.flatten().to_numpy() for c in t["codes"].chunks])
        if (chunk := t["chunk"][0].as_py()) >= 0:
            codes, n = np.unique(codes, return_counts=True)
        else:
            codes, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c.flatten().to_numpy() for c in t["n"].chunks]))
        ends = pa.array(np.array([0, len(codes)], np.int32))
        return pa.Table.from_arrays([pa.array([chunk]), pa.ListArray.from_arrays(ends, pa.array(codes)), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], ["chunk", "codes", "n"])

    rows = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    coded = arrow_map(rows, code, "chunk long, codes array<int>, n array<int>")
    return materialize(coded.groupBy("chunk").applyInArrow(merge, "chunk long, codes array<int>, n array<int>"), "coded")


def averaged(copies: DataFrame, name: str) -> np.ndarray:
    """The mean of vectors (chunk, n, x BINARY of float64), weighted by n: ``TOGETHER`` at a time, in order of chunks, until so few are left."""

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        n = t["n"].to_numpy().astype(np.float64)
        x = sum(w * np.frombuffer(v.as_py(), np.float64) for w, v in zip(n, t["x"], strict=True)) / n.sum()
        return pa.table({"chunk": [t["chunk"][0].as_py() // TOGETHER], "n": [int(n.sum())], "x": pa.array([x.tobytes()], pa.binary())})

    copies = materialize(copies, name)
    while copies.count() > TOGETHER:
        copies = materialize(copies.groupBy(F.floor(F.col("chunk") / TOGETHER)).applyInArrow(mean, "chunk long, n long, x binary"), name, copies)
    last = copies.toArrow()
    discard(copies)
    return np.frombuffer(mean(last)["x"][0].as_py(), np.float64)


def train(docs: DataFrame, rounds: int = ROUNDS, dim: int = DIM, seed: int = 0, chunk: int = CHUNK) -> LogBilinear:
    model, noise, total = untrained(docs, dim, seed)
    if not total:
        return model
    ship(docs.sparkSession)
    data = gathered(docs, model, max(1, round(total / chunk)))
    spelled = data.where("chunk < 0").select(F.explode(F.arrays_zip("codes", "n")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.n").alias("n")).toArrow()  # at most 257^3
    model = replace(model, spelling=Spelling(spelled.column("code").to_numpy().astype(np.int64), spelled.column("n").to_numpy()))
    sc = docs.sparkSession.sparkContext
    for k in range(rounds):
        shared = sc.broadcast((replace(model, words=np.zeros(0, np.uint64), ids=np.zeros(0, np.int16), share=np.zeros(0)), noise))

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared: Any = shared) -> Iterator[pa.RecordBatch]:
            own, noise_ = shared.value
            for b in batches:
                for at, codes, n in zip(b.column("chunk").to_pylist(), b.column("codes"), b.column("n"), strict=True):
                    trainer = Trainer(own, noise_, [seed, k, at], RATE / (1 + 2 * k))
                    trainer.run(codes.values.to_numpy(), times := n.values.to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([int(times.sum())]), pa.array([trainer.flat().astype(np.float64).tobytes()], pa.binary())], ["chunk", "n", "x"])

        model = model.replaced(averaged(arrow_map(data.where("chunk >= 0"), run, "chunk long, n long, x binary"), "copies"))
    discard(data)
    return model


_tables: dict[Any, Any] = {}


def score(docs: DataFrame, model: LogBilinear, per_token: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_unknown, log_prob, mean_log_prob, perplexity; with ``per_token`` also every token's log-probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hash(model.flat().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if key not in _tables:  # workers outlive tasks
            _tables.clear()
            _tables[key] = own.tables()
        a, b_, z = _tables[key]
        for b in batches:
            for p in pieces(b.column("text")):
                w = words(p)
                known = lookup_hashes(own.words, w.hashes)
                lo, n, (t, c2, c1) = p.lo, np.diff(w.at), own.units(w, known)
                lp = a.take(c1 * own.size + t)
                lp += b_.take(c2 * own.size + t)
                lp -= z.take(c1 * own.size + c2)
                lp = lp.astype(np.float64) + own.within(p, w, known)
                sums = np.concatenate([[0.0], np.cumsum(lp)])
                at = np.concatenate([[0], np.cumsum(n)])
                total = sums[at[1:]] - sums[at[:-1]]
                unknown = np.diff(np.concatenate([[0], np.cumsum(t == UNKNOWN)])[at])
                mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
                columns = [b.column("doc_id").slice(lo, len(n)), pa.array(n.astype(np.int64)), pa.array(unknown.astype(np.int64)), pa.array(np.where(n > 0, total, 0.0)), pa.array(mean, mask=n == 0), pa.array(np.exp(-mean), mask=n == 0)]
                names = ["doc_id", "n_tokens", "n_unknown", "log_prob", "mean_log_prob", "perplexity"]
                if per_token:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(lp.astype(np.float32))))
                    names.append("token_log_probs")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, n_unknown long, log_prob double, mean_log_prob double, perplexity double" + ", token_log_probs array<float>" * per_token
    return arrow_map(docs.select("doc_id", "text"), run, schema)
