"""Near-duplicate search (operator 9): BagMinHash signatures of word-shingle multisets, banding, verified multiset overlap.

A document is the multiset of its ``SHINGLE``-word shingles (a shorter one is a single shingle of all its words). For each shingle of
multiplicity w, Poisson processes run over the discretised weights 0..w: one for each dyadic interval (0,1], (1,2], (2,4], (4,8] ... , of a rate
equal to its length, so heavy shingles cost a logarithmic number of processes. Each point has a time, a register and a level within its
interval, all hashes of (shingle, interval, number of the point), thus alike in all documents; it counts where its level is within w. A
register keeps the earliest time of its points. Two documents agree in a register with probability equal to their weighted Jaccard overlap
sum min / sum max. A process ends as soon as its next point is later than the latest register, which keeps the work near n + m log m.

Registers are grouped into ``BANDS`` of ``ROWS``; documents that agree in a whole band are candidates. Equal multisets hang on their smallest
doc_id. Of the others, each is verified on the multisets themselves, against ``THRESHOLD``, with the smallest document of its buckets, and
where these verified pairs leave it in another component than the smallest documents of its other buckets, with those too: at most one
pair a document and band. What then shares a bucket but not a component is compared by a join of prefixes, which is exact: two multisets of
a and b items overlap by t only if they have o = (a + b) t / (1 + t) in common, so, in an order of all items, they share one within the first a - o + 1
and b - o + 1. Items that stand in one component only come first, then rare ones before frequent ones; so documents that have no more than a
template in common are never paired, however many they are, and the pairs verified grow with the documents. (Pairs just under the
threshold remain pairs to verify.) Groups are thus the connected components of the graph of all candidate pairs that overlap enough.

Defined cases: documents without words (NULL, empty, punctuation only) are in no group; a NULL doc_id is in no group; rows that repeat a
doc_id count as one document in groups (of different texts that with the smallest items is verified), and ``deduplicate`` keeps the one of the smallest
text; extra columns pass through ``deduplicate``, whatever their names. Of a group the smallest doc_id stays. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._job import arrow_map, discard, free_name, materialize
from ._text import Words, distinct_per_owner, mix, pieces, uniform, words
from .components import components

SHINGLE = 3
BANDS, ROWS = 48, 4
THRESHOLD = 0.5

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle, in text order."""
    counts = np.diff(w.at)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(w.at[:-1], number)
    length = np.minimum(counts, k)[owner]
    h = np.zeros(len(owner), np.uint64)
    for j in range(k):
        on = length > j
        h[on] = mix(h[on] + _GOLDEN) ^ w.hashes[at[on] + j]
    return owner, mix(h)


def signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures: float32 times, n x m; infinite for an empty multiset. Rows are distinct (owner, key) of integer weights."""
    best = np.full((n, m), np.inf)
    flat = best.reshape(-1)
    nodes = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    node = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
    own, w = np.repeat(owner, nodes), np.repeat(weights, nodes)
    low = np.where(node > 0, 1 << np.maximum(node - 1, 0), 0)
    rate = np.maximum(low, 1)
    state = mix(np.repeat(keys, nodes) + node.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = np.zeros(len(own))
    step, block = 0, 1
    while len(own):
        block = min(block, max(1, 400_000 // len(own)))
        points = mix(state[:, None] + (np.arange(step + 1, step + block + 1, dtype=np.uint64) * _GOLDEN)[None, :])
        times = np.cumsum(np.concatenate([x[:, None], -np.log(uniform(points)) / rate[:, None]], axis=1), axis=1)
        draw = mix(points ^ np.uint64(0xA0761D6478BD642F))
        register = ((draw >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        ok = times[:, 1:] <= best.max(axis=1)[own][:, None]
        wide = rate > 1
        if wide.any():
            level = low[wide, None] + 1 + (((draw[wide] & np.uint64(0xFFFFFFFF)) * rate[wide, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            ok[wide] &= level <= w[wide, None]
        r, c = np.nonzero(ok)
        np.minimum.at(flat, own[r] * m + register[r, c], times[r, c + 1])
        step += block
        x = times[:, -1]
        live = x <= best.max(axis=1)[own]
        own, w, low, rate, state, x = own[live], w[live], low[live], rate[live], state[live], x[live]
        block *= 2 if step >= 2 else 1
    return best.astype(np.float32)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band: n x bands."""
    bits = signature.view(np.uint32).reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2])
    for j in range(rows):
        h = mix((h * _GOLDEN) ^ bits[:, :, j])
    return h.view(np.int64)


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a 128-bit fingerprint of the multiset, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for p in pieces(b.column("text")):
                n = p.hi - p.lo
                owner, keys, counts = distinct_per_owner(*shingles(words(p), shingle), n)
                has = np.flatnonzero(np.bincount(owner, minlength=n))
                at = np.searchsorted(owner, has)
                c = counts.astype(np.uint64)
                one, two = (np.add.reduceat(mix(keys ^ np.uint64(s)) * c, at) if len(has) else np.zeros(0, np.uint64) for s in (0x1234567, 0x89ABCDEF))
                keyed = band_keys(signatures(owner, keys, counts, n, bands * rows)[has], bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keyed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p.lo + has)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "f1", "f2", "bands"])

    return arrow_map(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), run, "doc_id long, f1 long, f2 long, bands array<long>")


#: Bits of the filter that limits which texts are shingled again, at most (32 MB). Past it more texts pass; results are the same.
FILTER_BITS = 1 << 28


def _bit_filter(ids: DataFrame) -> tuple[Any, int]:
    """A broadcast bit array of hashed ``ids`` (doc_id), 16 bits an id up to ``FILTER_BITS``, and its size: a set bit may be another id's."""
    bits = min(FILTER_BITS, max(64, 1 << max(1, 16 * ids.count() - 1).bit_length()))
    on = ids.select(F.expr(f"pmod(xxhash64(doc_id), {bits}L) div 32").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 32L) as int))").alias("bit"))
    got = on.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    mask = np.zeros(bits // 32, np.uint32)
    mask[got["word"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(mask), bits


def _hit(mask: np.ndarray, at: pa.Array) -> np.ndarray:
    """Which places are set; a NULL place is not."""
    place = at.fill_null(0).to_numpy(zero_copy_only=False)
    return ((mask[place >> 5] >> (place & 31).astype(np.uint32)) & 1 > 0) & at.is_valid().to_numpy(zero_copy_only=False)


def _features(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its multiset as distinct 64-bit numbers, one for each occurrence of a shingle; for at least the documents of ``ids`` (doc_id)."""
    shared, bits = _bit_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            b = b.filter(pa.array(_hit(m, b.column("at"))))
            ids = b.column("doc_id")
            for p in pieces(b.column("text")):
                owner, keys = shingles(words(p), shingle)
                order = np.lexsort((keys, owner))
                owner, keys = owner[order], keys[order]
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(first)
                nth = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))
                items = mix(keys + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
                offsets = np.searchsorted(owner, np.arange(p.hi - p.lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(p.lo, p.hi - p.lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))], ["doc_id", "items"])

    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id), {bits}L)").alias("at"))
    return arrow_map(source, run, "doc_id long, items array<long>")


def _verified(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by at least ``threshold``, with the overlap."""
    fa = features.select(F.col("doc_id").alias("a"), F.col("items").alias("ia"))
    fb = features.select(F.col("doc_id").alias("b"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    overlap = common / (F.size("ia") + F.size("ib") - common)
    return pairs.join(fa, "a").join(fb, "b").select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= threshold)


#: Sizes within a factor of this are probed together in the join of prefixes.
CLASS = 1.1


def _size_class(n: Any) -> Any:
    return F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")


def prefix_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of documents of different components that may overlap by ``threshold``: all that do, and few others.

    ``items`` has doc_id, c (its component) and items, an array of distinct numbers; each doc_id once.
    """
    share = threshold / (1 + threshold)
    one = materialize(items.where(F.size("items") > 0).select("doc_id", "c", F.size("items").alias("n"), F.explode("items").alias("item")), "items")
    met = one.groupBy("item").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("item", "df")
    # place of each item that components share among its document's items, those of one component being first
    shared = one.join(met, "item")
    w = Window.partitionBy("doc_id").orderBy("df", "item")
    placed = shared.withColumn("k", F.row_number().over(w) + F.col("n") - F.count("*").over(Window.partitionBy("doc_id")))
    common = lambda a, b: F.ceil((a + b) * share - 1e-9)
    n = F.col("n")
    small = placed.where(F.col("k") <= n - common(n, n) + 1).select("item", _size_class(n).alias("class"), F.col("doc_id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    classes = F.sequence(_size_class(F.greatest(F.ceil(n * threshold - 1e-9), F.lit(1))), _size_class(n))
    probe = placed.where(F.col("k") <= n - common(n, F.ceil(n * threshold - 1e-9)) + 1).select("item", "doc_id", "c", "n", "k", F.explode(classes).alias("class"))
    least = F.greatest(F.ceil(n * threshold - 1e-9), F.ceil(F.pow(F.lit(CLASS), F.col("class")) - 1e-9))
    large = probe.where(F.col("k") <= n - common(n, least) + 1).select("item", "class", F.col("doc_id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("k").alias("ka"))
    na, nb, o = F.col("na"), F.col("nb"), common(F.col("na"), F.col("nb"))
    both = large.join(small, ["item", "class"]).where((F.col("ca") != F.col("cb")) & ((nb < na) | ((nb == na) & (F.col("b") < F.col("a")))) & (F.col("ka") <= na - o + 1) & (F.col("kb") <= nb - o + 1))
    return both.select("a", "b").distinct()


def edges(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, verified: list[int] | None = None) -> DataFrame:
    """Verified pairs (a, b, overlap), enough to connect every group. To ``verified`` the number of pairs compared in each step is added, if given."""
    signed = materialize(_signed(docs, shingle, bands, rows), "signed")
    # equal multisets first: each hangs on its smallest doc_id, which alone goes on
    best = signed.groupBy("f1", "f2").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("s")).select("f1", "f2", "s.*")
    best = materialize(best, "distinct")
    same = signed.select("doc_id", "f1", "f2").join(best.select("f1", "f2", F.col("doc_id").alias("b")), ["f1", "f2"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b", F.lit(1.0).alias("overlap")).distinct()
    same = materialize(same, "same", signed)
    # no bucket is ever held in one row
    bucket = Window.partitionBy("band", "key")
    keyed = best.select("doc_id", F.posexplode("bands").alias("band", "key"))
    members = keyed.withColumns({"leader": F.min("doc_id").over(bucket), "last": F.max("doc_id").over(bucket)}).where("leader <> last").select("band", "key", "leader", "doc_id")
    members = materialize(members, "buckets", best)
    stars = materialize(members.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    ids = stars.select(F.col("a").alias("doc_id")).union(stars.select(F.col("b").alias("doc_id"))).distinct()
    features = materialize(_features(docs, ids, shingle), "features").groupBy("doc_id").agg(F.min("items").alias("items"))

    def verify(pairs: DataFrame, *spent: DataFrame) -> DataFrame:
        if verified is not None:
            verified.append(pairs.count())
        return materialize(_verified(pairs, features, threshold), "found", *spent)

    # each document with the smallest of its leaders
    tried = stars.groupBy("a").agg(F.min("b").alias("b"))
    found = verify(tried)
    while True:
        group = materialize(components(found), "groups")

        def named(df: DataFrame, node: str, to: str, group: DataFrame = group) -> DataFrame:
            return df.join(group.select(F.col("node").alias(node), F.col("component").alias(to)), node, "left").withColumn(to, F.coalesce(to, node))

        # stars that join two components, then, when none is left, whatever else shares a bucket and is in two components
        open_ = named(named(stars.join(tried, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        open_ = materialize(open_, "open")
        if open_.isEmpty():
            split = named(members, "doc_id", "c")
            mixed = split.withColumns({"lo": F.min("c").over(bucket), "hi": F.max("c").over(bucket)}).where("lo <> hi").select("doc_id", "c").distinct()
            rest = prefix_pairs(mixed.join(features, "doc_id"), threshold)
            rest = rest.join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti")
            return found.union(verify(materialize(rest, "rest"), group)).union(same)
        found, tried = found.union(verify(open_, open_, group)), stars


def groups(docs: DataFrame, threshold: float = THRESHOLD, **kw: int) -> DataFrame:
    """One row a group of near duplicates: its smallest doc_id, all its doc_ids in order, how many they are."""
    member = components(edges(docs, threshold, **kw).select("a", "b"))
    return member.groupBy(F.col("component").alias("group_id")).agg(F.sort_array(F.collect_set("node")).alias("doc_ids")).withColumn("size", F.size("doc_ids"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, **kw: int) -> DataFrame:
    """``docs`` with one document of each group, all columns kept.

    Rows to be dropped, and rows that repeat a doc_id, are few: a bit filter of their ids lets all other rows pass where they lie, and only
    those that it holds back are joined and shuffled.
    """
    member = components(edges(docs, threshold, **kw).select("a", "b"))
    drop = materialize(member.where("node <> component").select(F.col("node").alias("doc_id")), "drop")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    shared, bits = _bit_filter(materialize(drop.union(repeated), "suspects"))
    at, nth = free_name(docs, "at"), free_name(docs, "nth")
    placed = docs.withColumn(at, F.expr(f"if(doc_id IS NULL, NULL, pmod(xxhash64(doc_id), {bits}L))"))

    def part(held_back: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = _hit(shared.value, b.column(at))
                yield b.drop_columns([at]).filter(pa.array(hit == held_back))

        return arrow_map(placed, run, docs.schema)

    # of rows that repeat a doc_id the smallest text stays, of equal ones the one that sorts first in its other columns
    order = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *order))
    kept = part(True).join(drop, "doc_id", "left_anti").select(docs.columns).withColumn(nth, first).where(F.col(f"`{nth}`") == 1)
    return part(False).union(kept.select([F.col(f"`{c}`") for c in docs.columns]))
