"""Best-two-fit packing (operator 6).

A document's length is its number of words. One longer than ``capacity`` is cut into pieces of that length, each a bin of its own, and a rest.
The rests are packed: a bin is filled greedily with the longest piece that fits, again and again; if a gap is left, the bin's shortest
piece is then replaced by the two unpacked pieces that fit the gap plus that piece most tightly, where those fill it better
(of equal pairs, the one with the longer first piece). The piece taken out goes back to the unpacked ones. Among pieces of equal length the
smallest (doc_id, start) goes first.

Packing runs in shards of about ``SHARD`` documents, by a hash of doc_id; a shard that comes out at over twice that (one id on very many rows)
is packed in parts of twice ``SHARD``, in the order of ids and lengths. So no shard grows with the input, only their number.

Defined cases: a document without words (NULL, empty) has no tokens and stands in no bin; a NULL doc_id is packed like any other id (of
equal pieces it goes first), and ids next to it keep all their digits; repeated rows are separate documents; extra columns are ignored; an empty
table gives no bins. Shards are numbered from 0 with gaps, bins within a shard.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._job import arrow_map, ship
from ._text import pieces, runs, WORD_BYTE

CAPACITY = 2048
SHARD = 20_000


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id and number of words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for p in pieces(b.column("text")):
                starts, _ = runs(WORD_BYTE[p.data] > 0, p.offsets)
                n[p.lo : p.hi] = np.diff(np.searchsorted(starts, p.offsets))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes`` (1 to capacity each; equal sizes are used in index order)."""
    stacks: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    for i, s in enumerate(np.asarray(sizes).tolist()):
        stacks[s].append(i)
    have = np.array([len(s) for s in stacks])
    span = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(have > 0, span, 0))  # the largest size at hand of at most x, 0: none

    def take(s: int) -> int:
        have[s] -= 1
        if not have[s]:
            prev, s2 = below[s - 1], s
            part = below[s2:]
            part[part == s] = prev
        return stacks[s].popleft()

    def give(s: int, i: int) -> None:
        stacks[s].appendleft(i)
        have[s] += 1
        if have[s] == 1:
            part = below[s:]
            part[part < s] = s

    out = []
    while below[capacity]:
        gap, items = capacity, []
        while gap and (s := int(below[gap])):
            items.append((s, take(s)))
            gap -= s
        if gap:
            s, i = items[-1]  # the shortest: sizes fall as the gap does
            room = gap + s
            firsts = span[1:room]
            firsts = firsts[have[1:room] > 0]
            if len(firsts):
                seconds = below[np.minimum(room - firsts, firsts)]
                # the second may be of the same size only if there are two of it
                same = (seconds == firsts) & (have[firsts] < 2)
                seconds[same] = below[firsts[same] - 1]
                total = np.where(seconds > 0, firsts + seconds, 0)
                best = len(total) - 1 - int(np.argmax(total[::-1]))
                if total[best] > s:
                    a, b = int(firsts[best]), int(seconds[best])
                    items[-1:] = [(a, take(a)), (b, take(b))]
                    give(s, i)
        out.append([i for _, i in items])
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row a bin: shard, bin, lists of doc_ids, starts (in words) and lengths in bin order, used and capacity."""
    n = docs.count()
    shards = max(1, -(-n // shard))
    schema = "shard long, bin long, doc_ids array<long>, starts array<long>, lengths array<long>, used long, capacity long"

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = t["doc_id"].combine_chunks() if t.num_rows else pa.array([], pa.int64())
        null = ~column.is_valid().to_numpy(zero_copy_only=False)
        ids, n = column.fill_null(0).to_numpy(zero_copy_only=False), t["n_tokens"].to_numpy()
        order = np.lexsort((n, ids, ~null))
        null, ids, n = null[order], ids[order], n[order]
        full, rest = n // capacity, n % capacity
        # pieces of all bins in bin order: the row that each comes from, and where in it the piece starts
        whole = np.repeat(np.arange(len(n)), full)
        begun = (np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)) * capacity
        left = np.flatnonzero(rest)
        bins = best_two_fit(rest[left], capacity)
        packed = left[np.array([i for b in bins for i in b], np.int64)]
        at, start = np.concatenate([whole, packed]), np.concatenate([begun, full[packed] * capacity])
        length = np.concatenate([np.full(len(whole), capacity), rest[packed]])
        offsets = np.concatenate([np.arange(len(whole) + 1), len(whole) + np.cumsum([len(b) for b in bins])]).astype(np.int32)
        used = np.add.reduceat(length, offsets[:-1]) if len(length) else length
        lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (pa.array(ids[at], mask=null[at]), pa.array(start), pa.array(length))]
        bins_n = len(offsets) - 1
        fixed = [pa.array(np.full(bins_n, t["shard"][0].as_py() if t.num_rows else 0)), pa.array(np.arange(bins_n))]
        return pa.Table.from_arrays([*fixed, *lists, pa.array(used), pa.array(np.full(bins_n, capacity))], ["shard", "bin", "doc_ids", "starts", "lengths", "used", "capacity"])

    hashed = lengths(docs).where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    # parts of a shard are cut by a window over ids and lengths: where shards are even, all are part 0
    nth = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "n_tokens")) - 1
    sized = hashed.withColumn("part", F.floor(nth / (2 * shard)).cast("long")).withColumn("shard", F.col("shard") + F.col("part") * shards)
    ship(docs.sparkSession)
    return sized.select("doc_id", "n_tokens", "shard").groupBy("shard").applyInArrow(run, schema)
