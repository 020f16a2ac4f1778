"""Search over a batch of texts at once: their runs lie end to end, so one array operation is a step of every pattern in every text.

Rows (of the suffix array) and text positions of text t are ``base[t]`` to ``base[t + 1] - 1``. Runs are held in symbol order, that is by text,
symbol and row: in this order each run of the BWT is also a run of the successor permutation, whose rows follow one another in the first column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from .kernels import Strategy, by_position, by_text_and_symbol

_NONE = np.zeros(0, np.int64)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Forest:
    base: np.ndarray
    group: np.ndarray  # of each run: text * 257 + symbol + 1; the sentinel's symbol is -1
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray = field(init=False)
    f_start: np.ndarray = field(init=False)
    f_bound: np.ndarray = field(init=False)  # f_start, and the end of all
    by_row: np.ndarray = field(init=False)  # runs in the order of rows
    place: np.ndarray = field(init=False)  # the place of each run in that order
    row_start: np.ndarray = field(init=False)
    row_end: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.key = self.group * (self.total + 1) + self.start
        self.f_start = np.cumsum(self.size) - self.size
        self.f_bound = np.append(self.f_start, self.total)
        self.by_row = by_position(self.start, self.total)
        self.place = np.empty(len(self.start), np.int64)
        self.place[self.by_row] = np.arange(len(self.start))
        self.row_start = self.start[self.by_row]
        self.row_end = np.append(self.row_start[1:], self.total)

    @classmethod
    def of_bwt_order(cls, lengths: np.ndarray, text: np.ndarray, sym: np.ndarray, start: np.ndarray) -> Forest:
        """From runs by text and row, ``start`` counting from each text's first row."""
        base = np.concatenate([[0], np.cumsum(lengths)])
        rows = base[text] + start
        group = text * 257 + sym + 1
        order = by_text_and_symbol(text, sym)
        return cls(base, group[order], rows[order], np.diff(np.append(rows, base[-1]))[order])

    @classmethod
    def of_symbol_order(cls, lengths: np.ndarray, text: np.ndarray, sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> Forest:
        base = np.concatenate([[0], np.cumsum(lengths)])
        return cls(base, text * 257 + sym + 1, base[text] + start, size)

    @cached_property
    def at_row(self) -> np.ndarray:
        """Of each row, the place of its run in the order of rows."""
        return np.repeat(np.arange(len(self.start), dtype=np.int32), self.row_end - self.row_start)

    @cached_property
    def at_first(self) -> np.ndarray:
        """Of each row of the first column, the run that stands there."""
        return np.repeat(np.arange(len(self.start), dtype=np.int32), self.size)

    @property
    def total(self) -> int:
        return int(self.base[-1])

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, side="right") - 1

    def before(self, group: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last run of a group that begins before row i, and whether there is one."""
        j = np.searchsorted(self.key, group * (self.total + 1) + i, side="left") - 1
        return j, (j >= 0) & (self.group[j] == group)

    def bound(self, group: np.ndarray, i: np.ndarray, j: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Row of the first column where the first symbol of the group at or after row i stands; ``j`` and ``has`` are ``before``."""
        first = np.searchsorted(self.group, group, side="left")
        return np.where(has, self.f_start[j] + np.minimum(i - self.start[j], self.size[j]), self.f_bound[first])

    def run_of(self, i: np.ndarray) -> np.ndarray:
        return self.by_row[self.at_row[i]]

    def lf(self, i: np.ndarray) -> np.ndarray:
        k = self.run_of(i)
        return self.f_start[k] + i - self.start[k]

    def psi(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row after each in its text, and the run that holds it."""
        k = self.at_first[i].astype(np.int64)
        return self.start[k] + i - self.f_start[k], k

    def split(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Non-empty intervals of rows cut at runs: number of the interval, run, begin, end."""
        x, y = self.at_row[a].astype(np.int64), self.at_row[b - 1]
        n = y - x + 1
        of = np.repeat(np.arange(len(a)), n)
        k = x[of] + _ramp(n)
        return of, self.by_row[k], np.maximum(a[of], self.row_start[k]), np.minimum(b[of], self.row_end[k])

    def split_forward(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of rows followed by Psi: number of the interval, run, and the rows of that run, in order."""
        x, y = self.at_first[a].astype(np.int64), self.at_first[b - 1]
        n = y - x + 1
        of = np.repeat(np.arange(len(a)), n)
        k = x[of] + _ramp(n)
        shift = self.start[k] - self.f_start[k]
        return of, k, np.maximum(a[of], self.f_start[k]) + shift, np.minimum(b[of], self.f_start[k] + self.size[k]) + shift


@dataclass
class Found:
    """Ranges of rows of the (text, pattern) pairs that occur, and, for a first value, the run end that backward search passed last and the steps since."""

    text: np.ndarray
    pattern: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray
    steps: np.ndarray


def search(f: Forest, patterns: list[bytes], backward: bool = True) -> Found:
    """Every pattern in every text. A first value is kept for a range's last row (``backward``) or its first: a step that keeps this row in a run of the
    pattern's symbol moves the value by one; any other begins anew at the end of a run."""
    texts, size = len(f.base) - 1, np.array([len(p) for p in patterns], np.int64)
    some = np.flatnonzero(size)
    wide = np.zeros((len(patterns), int(size.max(initial=0))), np.uint8)  # from the last symbol to the first
    for i in some.tolist():
        wide[i, : size[i]] = np.frombuffer(patterns[i][::-1], np.uint8)
    text, pattern = np.repeat(np.arange(texts), len(some)), np.tile(some, texts)
    lo, hi = f.base[text], f.base[text + 1]
    row, steps = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    done: list[tuple[np.ndarray, ...]] = []
    for step in range(wide.shape[1]):
        sym = wide[pattern, step].astype(np.int64)
        group = text * 257 + sym + 1
        (jl, hl), (jh, hh) = f.before(group, lo), f.before(group, hi)
        to_lo, to_hi = f.bound(group, lo, jl, hl), f.bound(group, hi, jh, hh)
        on = np.flatnonzero(to_lo < to_hi)
        edge = hi - 1 if backward else lo
        anew = on[(step == 0) | (f.group[f.run_of(edge[on])] != group[on])]
        if backward:
            row[anew] = np.minimum(hi[anew], f.start[jh[anew]] + f.size[jh[anew]]) - 1
        else:
            nxt = np.where(hl[anew], jl[anew] + 1, np.searchsorted(f.group, group[anew], side="left"))
            within = hl[anew] & (f.start[jl[anew]] + f.size[jl[anew]] > lo[anew])
            row[anew] = np.where(within, lo[anew], f.start[np.minimum(nxt, len(f.start) - 1)])
        steps[anew] = size[pattern[anew]] - step
        text, pattern, lo, hi, row, steps = text[on], pattern[on], to_lo[on], to_hi[on], row[on], steps[on]
        ended = size[pattern] == step + 1
        if ended.any():
            done.append(tuple(x[ended] for x in (text, pattern, lo, hi, row, steps)))
            text, pattern, lo, hi, row, steps = (x[~ended] for x in (text, pattern, lo, hi, row, steps))
        if not len(text):
            break
    return Found(*(np.concatenate([d[i] for d in done]) if done else _NONE for i in range(6)))


#: Whether each of some runs (with the row asked for) has a stored sample, and its text position.
Lookup = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def by_run(rank: np.ndarray | None, kept: np.ndarray, samples: np.ndarray, runs: int) -> Lookup:
    """Samples in an order of runs, ``kept`` ascending places within it; ``rank`` is the place of each of the ``runs``, None in symbol order itself."""

    held = np.full(runs, -1, np.int32)
    held[kept] = np.arange(len(kept))

    def get(run: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = run if rank is None else rank[run]
        at = held[place]
        return (at >= 0, samples[at]) if len(kept) else (np.zeros(len(run), bool), place)

    return get


def by_row(rows: np.ndarray, samples: np.ndarray) -> Lookup:
    """Samples at ascending rows."""

    def get(run: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(rows, row), max(len(rows) - 1, 0))
        return (rows[at] == row, samples[at]) if len(rows) else (np.zeros(len(row), bool), row)

    return get


@dataclass
class Marks:
    """Marks of a batch, ascending, the sample of each, and how far from a mark it is trusted (-1: everywhere)."""

    mark: np.ndarray
    sample: np.ndarray
    area: np.ndarray
    first: np.ndarray  # of each text, and the end

    def phi(self, f: Forest, text: np.ndarray, value: np.ndarray, backward: bool, by_area: bool) -> tuple[np.ndarray, np.ndarray]:
        """The suffix-array entry before (after) each one, and whether it is trusted."""
        n, base = f.base[text + 1] - f.base[text], f.base[text]
        at = np.searchsorted(self.mark, value, side="left") - int(backward)
        wrap = (at < self.first[text]) | (at >= self.first[text + 1])
        at = np.where(wrap, self.first[text + 1] - 1 if backward else self.first[text], at)
        delta = (value - self.mark[at] if backward else self.mark[at] - value) + np.where(wrap, n, 0)
        step = self.sample[at] - base + (delta if backward else -delta)
        return base + step % n, (self.area[at] < 0) | (by_area & (delta < self.area[at]))


@dataclass
class Access:
    """What a strategy reads: a lookup of samples at run ends, marks, and, where samples lie by row, those rows."""

    lookup: Lookup
    marks: Marks
    rows: np.ndarray | None = None


def _moved(f: Forest, text: np.ndarray, tpos: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    base = f.base[text]
    return base + (tpos - base + 1 + by) % (f.base[text + 1] - base)


def first_values(f: Forest, found: Found, access: Access, backward: bool, s: int) -> np.ndarray:
    """The suffix-array entry of each range's last (first) row: from the sample of the run end kept by the search, or of one at most ``s`` steps from it."""
    out = np.full(len(found.row), -1, np.int64)
    open_, row, run = np.arange(len(out)), found.row, f.run_of(found.row)
    for level in range(s + 1):
        edge = row == (f.start[run] + f.size[run] - 1 if backward else f.start[run])
        has, tpos = access.lookup(run, row)
        hit = edge & has
        at = open_[hit]
        out[at] = _moved(f, found.text[at], tpos[hit], (level if backward else -level) - found.steps[at])
        open_, row, run = open_[~hit], row[~hit], run[~hit]
        if not len(open_):
            return out
        if backward:
            row = f.f_start[run] + row - f.start[run]
            run = f.run_of(row)
        else:
            row, run = f.psi(row)
    raise AssertionError("a sample is more than s steps away")


def locate(f: Forest, found: Found, access: Access, how: Strategy, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and text position (within the batch) of every occurrence.

    A first value comes from the search. Without sampling its neighbours follow one another through the marks. With it, rows that are stored samples
    themselves are known first; trusted marks carry from known rows to their neighbours; what is left is followed as intervals, cut at
    runs, for at most ``s`` steps of LF or Psi to stored samples; rows that meet none there may take their neighbour's mark whether trusted or not.
    """
    back, step = how.backward, -1 if how.backward else 1
    size = found.hi - found.lo
    ends = np.cumsum(size)
    begins = ends - size
    owner = np.repeat(np.arange(len(size)), size)
    text = found.text[owner]
    out = np.full(len(owner), -1, np.int64)
    seed = ends - 1 if back else begins
    out[seed] = first_values(f, found, access, back, s if how.sampled else 0)

    def carry(from_: np.ndarray, trusted_only: bool) -> None:
        at = from_
        while len(at):
            nxt = at + step
            on = (nxt >= begins[owner[at]]) & (nxt < ends[owner[at]])
            at, nxt = at[on], nxt[on]
            on = out[nxt] < 0
            at, nxt = at[on], nxt[on]
            value, trusted = access.marks.phi(f, text[at], out[at], back, how.valid_area)
            if trusted_only:
                value, nxt = value[trusted], nxt[trusted]
            out[nxt] = value
            at = nxt

    if not how.sampled:
        carry(seed, False)
        return owner, out

    def settle(of: np.ndarray, run: np.ndarray, a: np.ndarray, b: np.ndarray, slot: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
        """Take samples at the ends of pieces; what is left of them: run, begin, end, slot of the first row."""
        at_edge = b == f.start[run] + f.size[run] if back else a == f.start[run]
        has, tpos = access.lookup(run, b - 1 if back else a)
        hit = np.flatnonzero(at_edge & has)
        to = slot[hit] + (b[hit] - 1 - a[hit] if back else 0)
        out[to] = _moved(f, text[to], tpos[hit], level if back else -level)
        a, b, slot = a.copy(), b.copy(), slot.copy()
        if back:
            b[hit] -= 1
        else:
            a[hit] += 1
            slot[hit] += 1
        on = a < b
        return run[on], a[on], b[on], slot[on]

    if access.rows is not None:  # the first cut is at stored rows
        x, y = (np.searchsorted(access.rows, v, side="left") for v in (found.lo, found.hi))
        of = np.repeat(np.arange(len(size)), y - x)
        rows = access.rows[x[of] + _ramp(y - x)]
        to = begins[of] + rows - found.lo[of]
        out[to] = _moved(f, text[to], access.lookup(f.run_of(rows), rows)[1], 0)
    else:
        of, run, a, b = f.split(found.lo, found.hi)
        settle(of, run, a, b, begins[of] + a - found.lo[of], 0)
    if how.valid_mark:
        carry(np.flatnonzero(out >= 0), True)
    gap = out < 0
    head = np.flatnonzero(gap & ~np.append(False, gap[:-1] & (owner[1:] == owner[:-1])))
    tail = np.flatnonzero(gap & ~np.append(gap[1:] & (owner[1:] == owner[:-1]), False))
    a = found.lo[owner[head]] + head - begins[owner[head]]
    of, run, a, b = f.split(a, a + tail - head + 1) if len(head) else (_NONE,) * 4
    slot = head[of] + a - (found.lo[owner[head[of]]] + head[of] - begins[owner[head[of]]]) if len(of) else _NONE
    for level in range(1, s + 1):
        if not len(a):
            break
        if back:
            to = f.f_start[run] + a - f.start[run]
            of, run, x, y = f.split(to, to + b - a)
            slot = slot[of] + x - to[of]
        else:
            width = b - a
            of, run, x, y = f.split_forward(a, b)
            wide = y - x
            # pieces of an interval stand in its order: each begins where those before it end
            done = np.cumsum(wide) - wide
            slot = slot[of] + done - done[np.searchsorted(of, of, side="left")]
            assert int(width.sum()) == int(wide.sum())
        run, a, b, slot = settle(of, run, x, y, slot, level)
    known = np.flatnonzero(out >= 0)
    carry(known, False)
    return owner, out


def batches_of(lengths: np.ndarray, patterns: int, cuts: np.ndarray = _NONE, pairs: int = 1 << 20, rows: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive texts of bounded pairs with patterns and bounded length, at least one at a time, none across ``cuts``."""
    lo, ends = 0, np.cumsum(lengths)
    most = max(1, pairs // max(patterns, 1))
    stops = np.append(cuts, len(lengths))
    while lo < len(lengths):
        hi = min(lo + most, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + rows, side="right")), int(stops[np.searchsorted(stops, lo, side="right")]))
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)
