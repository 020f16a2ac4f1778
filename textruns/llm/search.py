"""Exact top-k search (operator 5): BM25 with quantised impacts, by MaxScore.

Terms are words (see ``_text``). The impact of a term in a document is round(1024 * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)))
with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a document's score is the sum over the query's words, repeated ones counting again. Impacts
are integers, so scores are exact whatever the order of summation. N, df and the mean length are of all documents.

The corpus is cut into shards. In each, a query's terms are taken by falling upper bound (the shard's largest impact). While the
bounds of the terms left sum to at least the k-th best score so far, the terms are essential: their postings are traversed and bring in new
candidates. The others are non-essential: they are probed only for candidates that can still reach the k-th best. The shards' lists are merged.

Every row of ``queries`` is a query. Queries go in blocks of at most ``BLOCK`` rows, so what is broadcast stays bounded.

Defined cases: a document needs one common word to be a result, and one is enough, even of impact 0; ties go to the smaller doc_id; a NULL or empty query has no results; NULL
or empty documents count in N but match nothing; documents of NULL doc_id likewise; rows that repeat a doc_id or an item_id are separate and
all appear; extra columns are ignored; an empty corpus gives no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._job import arrow_map, materialize
from ._text import distinct_per_owner, lookup, pieces, words

K = 10
K1, B = 1.2, 0.75
SCALE = 1024
BLOCK = 20_000
SHARD = 20_000


def _postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, length, and which of the ``terms`` (sorted hashes) stand in each document how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column("text")):
                w = words(p)
                at = lookup(terms, w.hashes)
                hit = np.flatnonzero(at >= 0)
                owner, term, tf = distinct_per_owner(w.owner()[hit], at[hit], p.hi - p.lo)
                offsets = pa.array(np.searchsorted(owner, np.arange(p.hi - p.lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(p.lo, p.hi - p.lo), pa.array(np.diff(w.at)), *lists], ["doc_id", "length", "terms", "tf"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, length long, terms array<int>, tf array<int>")


def maxscore(query: list[tuple[int, int]], ptr: np.ndarray, docs: np.ndarray, impacts: np.ndarray, bounds: np.ndarray, ids: np.ndarray, k: int, scratch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard for a query [(term, times)]: numbers and scores, best first. Postings of term t: ``ptr[t]:ptr[t+1]``, by document. ``scratch``: zeros, one a document, left as zeros."""
    terms = sorted((t for t in query if ptr[t[0] + 1] > ptr[t[0]]), key=lambda t: -bounds[t[0]] * t[1])
    left = np.cumsum([bounds[t] * n for t, n in terms][::-1])[::-1] if terms else np.zeros(0, np.int64)
    # scores of documents met: one more than their sum of impacts, so that one of zero impact counts as met
    score = np.zeros(len(ids), np.int64) if scratch is None else scratch
    met: list[np.ndarray] = []
    least, i = -1, 0  # the k-th best score so far: a lower bound of the final one
    while i < len(terms) and (least < 0 or left[i] >= least):
        t, n = terms[i]
        at = slice(ptr[t], ptr[t + 1])
        own = docs[at]
        fresh = own[score[own] == 0]
        score[fresh] = 1
        met.append(fresh)
        score[own] += impacts[at] * n
        i += 1
        if i < len(terms):
            some = np.concatenate([score[m] for m in met])
            if len(some) >= k:
                least = int(np.partition(some, len(some) - k)[len(some) - k]) - 1
    candidates = np.sort(np.concatenate(met)) if met else np.zeros(0, np.int64)
    touched = candidates
    while i < len(terms) and len(candidates):
        candidates = candidates[score[candidates] - 1 + left[i] >= least]
        t, n = terms[i]
        own = docs[ptr[t] : ptr[t + 1]]
        at = np.minimum(np.searchsorted(own, candidates), len(own) - 1)
        hit = own[at] == candidates
        score[candidates[hit]] += impacts[ptr[t] + at[hit]] * n
        i += 1
        if len(candidates) >= k:
            s = score[candidates]
            least = max(least, int(np.partition(s, len(s) - k)[len(s) - k]) - 1)
    order = np.lexsort((ids[candidates], -score[candidates]))[:k]
    best = candidates[order], score[candidates][order] - 1
    score[touched] = 0
    return best


def _block(docs: DataFrame, first: int, queries: list[tuple[int | None, str]], k: int) -> DataFrame:
    parsed = []
    for number, (item, text) in enumerate(queries, first):
        found = [words(p).hashes for p in pieces(pa.array([text], pa.string()))]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        parsed.append(((number, item), h, n))
    terms = np.unique(np.concatenate([h for _, h, _ in parsed])) if parsed else np.zeros(0, np.uint64)
    coded = [(item, list(zip(np.searchsorted(terms, h).tolist(), n.tolist(), strict=True))) for item, h, n in parsed]
    postings = materialize(_postings(docs, terms), "postings")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=len(terms))
            n, length = n + b.num_rows, length + int(b.column("length").to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, length]))], ["term", "n"])

    stats = arrow_map(postings.select("length", "terms"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    n_docs, total = int(stats.get(-1, 0)), int(stats.get(-2, 0))
    df = stats.reindex(range(len(terms)), fill_value=0).to_numpy(np.int64)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    mean = max(total, 1) / max(n_docs, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                t = t.filter(t["doc_id"].is_valid())
                ids, length = t["doc_id"].to_numpy(), t["length"].to_numpy()
                lists = [c.chunk(0) if c.num_chunks else pa.array([], pa.list_(pa.int32())) for c in (t["terms"], t["tf"])]
                owner = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
                term, tf = (x.flatten().to_numpy() for x in lists)
                order = np.argsort(term, kind="stable")
                term, tf, owner = term[order], tf[order].astype(np.float64), owner[order]
                impact = np.floor(SCALE * (idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length[owner] / mean))))) + 0.5).astype(np.int64)
                ptr = np.searchsorted(term, np.arange(len(terms) + 1))
                bounds = np.zeros(len(terms), np.int64)
                np.maximum.at(bounds, term, impact)
                scratch = np.zeros(len(ids), np.int64)
                out: list[list] = [[], [], [], []]
                for (number, item), query in coded:
                    at, s = maxscore(query, ptr, owner, impact, bounds, ids, k, scratch)
                    out[0] += [number] * len(at)
                    out[1] += [item] * len(at)
                    out[2] += ids[at].tolist()
                    out[3] += s.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query", "item_id", "doc_id", "score"])

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= SHARD:
                yield from flush()
                rows = 0
        yield from flush()

    return arrow_map(postings, run, "query long, item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of ``queries`` (item_id, text)."""
    rows = queries.select("item_id", "text")
    block: list[tuple[int | None, str]] = []
    done, lists = 0, []
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == BLOCK:
            lists.append(_block(docs, done, block, k))
            done, block = done + len(block), []
    if block or not lists:
        lists.append(_block(docs, done, block, k))
    best = reduce(DataFrame.union, lists)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: Words as ``_text`` defines them, in DuckDB.
WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10ffff}}]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
corpus AS (SELECT count(*) AS n, sum(len(ws))::DOUBLE / count(*) AS mean FROM d),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({WORDS_SQL.format("coalesce(text, '')")}) AS w FROM benchmark) GROUP BY ALL),
terms AS (SELECT DISTINCT w FROM q),
tf AS (SELECT doc_id, length, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS w FROM d) SEMI JOIN terms USING (w) GROUP BY ALL),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
impact AS (SELECT doc_id, w, floor({SCALE}.0::DOUBLE * (ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * (length / mean))))) + 0.5::DOUBLE)::BIGINT AS impact
           FROM tf JOIN df USING (w), corpus WHERE doc_id IS NOT NULL),
scored AS (SELECT item_id, doc_id, sum(impact * times)::BIGINT AS score FROM q JOIN impact USING (w) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
