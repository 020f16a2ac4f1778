"""Array kernels over a batch of texts: suffix arrays, runs, marks and samples, and their sub-sampling.

The texts of a batch lie end to end, each with its sentinel: text t has rows and positions ``base[t]`` to ``base[t + 1] - 1``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


def sorted_suffixes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``base``, and the suffix arrays of all texts end to end, by prefix doubling over all of them at once; settled suffixes drop out.

    The first sort is by as many symbols as a key of 62 bits holds beside the text's number; what follows a sentinel in it decides nothing.
    """
    lengths = np.array([len(b) + 1 for b in bodies], np.int64)
    total = int(lengths.sum())
    base = np.concatenate([[0], np.cumsum(lengths)])
    if not total:
        return base, np.zeros(0, np.int64)
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
    data[base[1:] - 1] = 0
    present = np.zeros(257, bool)
    present[data] = True
    code = (np.cumsum(present) - 1)[data]
    bits = max(1, int(present.sum() - 1).bit_length())
    step = max(1, min((62 - (len(bodies) - 1).bit_length()) // bits, int(lengths.max())))
    code = np.concatenate([code, np.zeros(step, np.int64)])
    key = np.repeat(np.arange(len(bodies)), lengths)
    for k in range(step):
        key <<= bits
        key |= code[k : k + total]
    order = np.argsort(key)
    rank = np.empty(total, np.int64)
    slots = np.arange(total)
    keys = key[order]
    while True:
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        start = np.maximum.accumulate(np.where(first, slots, 0))
        rank[order[slots]] = start
        # slots of groups of one are settled
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if not len(slots):
            break
        open_ = order[slots]
        keys = rank[open_] * (total + 1) + rank[np.minimum(open_ + step, total - 1)]
        by = np.argsort(keys)
        order[slots] = open_[by]
        keys = keys[by]
        step *= 2
    return base, order


def by_position(at: np.ndarray, total: int) -> np.ndarray:
    """The order of distinct positions under ``total``, without a sort."""
    place = np.full(total, -1, np.int64)
    place[at] = np.arange(len(at))
    return place[place >= 0]


def by_text_and_symbol(text: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """The order by text, symbol (-1 to 255) and place of what comes by text: a stable sort of short numbers, which numpy does by digits."""
    order = np.argsort((sym + 1).astype(np.uint16), kind="stable")
    narrow = text.astype(np.uint16) if len(text) and text[-1] < 1 << 16 else text
    return order[np.argsort(narrow[order], kind="stable")]


def suffix_arrays(bodies: list[bytes]) -> list[np.ndarray]:
    """Suffix array of each text with its sentinel."""
    base, order = sorted_suffixes(bodies)
    return [order[a:b] - a for a, b in zip(base[:-1], base[1:], strict=True)]


def _greedy(at: np.ndarray, end: np.ndarray, heads: np.ndarray, stops: np.ndarray, s: int) -> np.ndarray:
    """Indices kept of ascending ``at``: of each head, and from a kept one the last within ``s``, or the next if that is farther, but never past the next of ``stops``.

    ``end`` is the last index of each one's text; ``stops`` ascend and hold the last index of every text.
    """
    reach = np.minimum(np.searchsorted(at, at + s, side="right") - 1, end)
    index = np.arange(len(at))
    stop = np.append(np.repeat(stops, np.diff(stops, prepend=0)), np.full(len(at) - stops[-1], stops[-1]))  # the next one after each index
    jump = np.minimum(np.maximum(reach, index + 1), stop).tolist()
    kept: list[int] = []
    for k, last in zip(heads.tolist(), end[heads].tolist(), strict=True):
        kept.append(k)
        while k < last:
            kept.append(k := jump[k])
    return np.array(kept, np.int64)


def greedy_sample(values: np.ndarray, order: np.ndarray, s: int, required: np.ndarray | tuple[int, ...] = ()) -> np.ndarray:
    """Indices kept of ``values`` walked in ``order`` (rising or falling): the first, the last, the required ones, and as few others as leave no kept gap over ``s`` where values allow."""
    walk = np.asarray(order)
    if not len(walk):
        return np.zeros(0, np.int64)
    at = np.asarray(values)[walk]
    last = len(walk) - 1
    stops = np.unique([*(np.flatnonzero(walk == x)[0] for x in required), last])
    return walk[_greedy(at if at[-1] >= at[0] else -at, np.full(len(walk), last), np.zeros(1, np.int64), stops, s)].astype(np.int64)


@dataclass
class Runs:
    """The equal-letter runs of the BWTs of a batch, by text and row; symbols are bytes, the sentinel is -1; rows and positions are the batch's."""

    base: np.ndarray
    text: np.ndarray
    sym: np.ndarray
    start: np.ndarray
    head_tpos: np.ndarray
    tail_tpos: np.ndarray

    @classmethod
    def of(cls, bodies: list[bytes], base: np.ndarray, sa: np.ndarray) -> Runs:
        n = len(sa)
        ends = base[1:] - 1
        data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) if bodies else np.zeros(0, np.int64)
        data[ends] = -1
        before = np.arange(-1, n - 1)
        before[base[:-1]] = ends
        tpos = before[sa]
        bwt = data[tpos]
        first = np.ones(n, bool)
        first[1:] = bwt[1:] != bwt[:-1]
        first[base[:-1]] = True
        start = np.flatnonzero(first)
        return cls(base, np.searchsorted(base, start, side="right") - 1, bwt[start], start, tpos[start], tpos[np.append(start[1:], n) - 1] if n else tpos)

    @property
    def r(self) -> int:
        return len(self.start)

    @cached_property
    def first(self) -> np.ndarray:
        """The first run of each text, and their number."""
        return np.searchsorted(self.text, np.arange(len(self.base)), side="left")

    @cached_property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.start, self.base[-1]))

    @cached_property
    def by_symbol(self) -> np.ndarray:
        """Runs in Psi order: by text, symbol, row."""
        return by_text_and_symbol(self.text, self.sym)

    @cached_property
    def symbol_rank(self) -> np.ndarray:
        """Place of each run in Psi order."""
        out = np.empty(self.r, np.int64)
        out[self.by_symbol] = np.arange(self.r)
        return out


@dataclass
class Samples:
    """Marks and the samples that they lead to, for one direction; of the kept ones only, where sub-sampled.

    ``mark`` ascends. ``sample[k]`` belongs to ``mark[k]`` and is the end of run ``run[k]``. ``kept`` tells for each run, by row, whether its sample is
    stored. ``valid`` and ``area`` tell how far from a mark its sample may be trusted. ``first`` is the first mark of each text, and their number.
    """

    mark: np.ndarray
    sample: np.ndarray
    run: np.ndarray
    kept: np.ndarray
    valid: np.ndarray
    area: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, runs: Runs, backward: bool, s: int = 1) -> Samples:
        r, first = runs.r, runs.first
        # the neighbour of each run within its text, circular: by row the one before, in Psi order the one after
        shifted = np.arange(r) + (-1 if backward else 1)
        some = np.flatnonzero(np.diff(first))
        if backward:
            shifted[first[some]] = first[some + 1] - 1
            order, value, mark_of = np.arange(r), runs.tail_tpos, runs.head_tpos
        else:
            shifted[first[some + 1] - 1] = first[some]
            order, value, mark_of = runs.by_symbol, runs.head_tpos, runs.tail_tpos[runs.by_symbol]
        by_mark = by_position(mark_of, int(runs.base[-1]))
        mark, sample_run = mark_of[by_mark], order[shifted[by_mark]]
        kept = np.ones(r, bool)
        if s > 1 and r:
            kept[:] = False
            # each text's values ascend in the walk: positions, or positions counted from the text's end
            t = runs.text
            at = value if backward else runs.base[t] + runs.base[t + 1] - 1 - value
            walk = by_position(at, int(runs.base[-1]))
            place = np.empty(r, np.int64)
            place[walk] = np.arange(r)
            last = first[some + 1] - 1
            must = np.concatenate([sample_run[first[some]], sample_run[last]])
            kept[walk[_greedy(at[walk], (first[1:] - 1)[t], first[some], np.unique(np.concatenate([place[must], last])), s)]] = True
        stays = kept[sample_run]
        sub, full = mark[stays], np.flatnonzero(stays)
        text = np.searchsorted(runs.base, sub, side="right") - 1
        # a mark is trusted if no mark that was left out follows (backward) or precedes (forward) it before the next kept one
        next_full = full + (1 if backward else -1)
        outside = next_full >= first[text + 1] if backward else next_full < first[text]
        neighbour = mark[np.clip(next_full, 0, max(r - 1, 0))]
        kept_next = np.append(sub[1:], -1) if backward else np.append(-1, sub[:-1])
        ok = outside | (neighbour == kept_next)
        area = np.where(ok, np.iinfo(np.int64).max, np.abs(neighbour - sub))
        return cls(sub, value[sample_run[stays]], sample_run[stays], kept, ok, area, np.searchsorted(text, np.arange(len(runs.base)), side="left"))


@dataclass(frozen=True)
class Strategy:
    """How occurrences are enumerated, and from which structures.

    From a range's last row by predecessors (``backward``) or from its first by successors; with all run ends sampled or some (``sampled``), trusting
    marks (``valid_mark``) and areas around them (``valid_area``). Samples are looked up by place among the runs by row, or, of forward sub-samples, by
    the row itself; with ``psi_order`` by symbol and place among the symbol's runs. ``psi_runs`` says that navigation, too, reads runs in that order.
    """

    name: str
    backward: bool = True
    sampled: bool = False
    valid_mark: bool = False
    valid_area: bool = False
    slice: bool = False
    psi_order: bool = False
    psi_runs: bool = False


STRATEGIES: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("sa_slice", slice=True),
        Strategy("tails"),
        Strategy("tails_sampled", sampled=True),
        Strategy("tails_sampled_marks", sampled=True, valid_mark=True),
        Strategy("tails_sampled_areas", sampled=True, valid_mark=True, valid_area=True),
        Strategy("heads", backward=False),
        Strategy("heads_sampled", backward=False, sampled=True),
        Strategy("heads_sampled_marks", backward=False, sampled=True, valid_mark=True),
        Strategy("heads_sampled_areas", backward=False, sampled=True, valid_mark=True, valid_area=True),
        Strategy("heads_slim_sampled", backward=False, sampled=True, psi_order=True),
        Strategy("heads_slim_sampled_marks", backward=False, sampled=True, valid_mark=True, psi_order=True),
        Strategy("heads_slim_sampled_areas", backward=False, sampled=True, valid_mark=True, valid_area=True, psi_order=True),
        Strategy("heads_psi", backward=False, psi_order=True, psi_runs=True),
        Strategy("heads_psi_sampled", backward=False, sampled=True, psi_order=True, psi_runs=True),
        Strategy("heads_psi_sampled_marks", backward=False, sampled=True, valid_mark=True, psi_order=True, psi_runs=True),
        Strategy("heads_psi_sampled_areas", backward=False, sampled=True, valid_mark=True, valid_area=True, psi_order=True, psi_runs=True),
    )
}
