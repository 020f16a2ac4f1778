"""Count and locate: many patterns over many texts, through an index or by a scan.

An index is one row a text (see ``textruns.plans.index``); patterns are broadcast to the indexes in blocks of a checked size, so neither side shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textruns.functions.cluster import map_batches
from textruns.functions.forest import Access, Forest, Found, Marks, batches_of, by_row, by_run, first_values, search
from textruns.functions.forest import locate as resolve
from textruns.functions.kernels import STRATEGIES, Strategy, by_position

from .deal import joined

#: Patterns that are broadcast at once, at most: rows, and bytes of them.
BLOCK_ROWS = 50_000
BLOCK_BYTES = 8 << 20

Pattern = tuple[int | None, bytes]


def blocks(patterns: DataFrame) -> Iterator[list[Pattern]]:
    """Patterns (pattern_id, pattern BINARY) in bounded blocks; NULL and empty ones have no occurrences and are left out."""
    block: list[Pattern] = []
    size = 0
    for row in patterns.select("pattern_id", "pattern").where("length(pattern) > 0").toLocalIterator():
        block.append((row["pattern_id"], bytes(row["pattern"])))
        size += len(row["pattern"])
        if len(block) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _over_blocks(patterns: DataFrame, one: Callable[[list[Pattern]], DataFrame]) -> DataFrame:
    parts = [one(b) for b in blocks(patterns)]
    return reduce(DataFrame.union, parts) if parts else one([])


def columns_of(how: Strategy) -> list[str]:
    """The index columns that a strategy reads, beside text_id, n and s."""
    if how.slice:
        return ["run_sym", "run_start", "sa"]
    if how.psi_runs:
        return ["p_sym", "p_start", "p_size", *(("f_places", "f_heads", "f_mark", "f_link", "f_area") if how.sampled else ("p_head", "p_tail"))]
    runs = ["run_sym", "run_start"]
    if not how.sampled:
        return [*runs, "head_tpos", "tail_tpos"]
    if how.backward:
        return [*runs, "b_kept", "tail_tpos", "b_mark", "b_sample", "b_area"]
    return [*runs, *(("f_places", "f_heads", "f_mark", "f_link", "f_area") if how.psi_order else ("f_rows", "f_kept", "head_tpos", "f_mark", "f_sample", "f_area"))]


class Rows:
    """Some index rows as arrays: lists end to end, and their offsets by text."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.batch = b
        self.known: dict[tuple, Any] = {}  # what several strategies have in common
        self.lengths = b.column("n").to_numpy()
        self.base = np.concatenate([[0], np.cumsum(self.lengths)])

    def list(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values and the text of each."""
        c = self.batch.column(name)
        offsets = c.offsets.to_numpy()
        return c.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(c)), np.diff(offsets))

    def placed(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows or positions of the batch, and the text of each."""
        x, text = self.list(name)
        return x + self.base[text], text

    def symbols(self, name: str) -> np.ndarray:
        sym = np.frombuffer(b"".join(self.batch.column(name).to_pylist()), np.uint8).astype(np.int64)
        return np.where(sym == 0, -1, sym)

    @property
    def rate(self) -> int:
        return int(self.batch.column("s")[0].as_py())

    def once(self, key: tuple, make: Callable[[], Any]) -> Any:
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def forest(self, psi_runs: bool) -> Forest:
        """The runs, from those stored by symbol or by row."""
        return self.once(("forest", psi_runs), lambda: self._forest(psi_runs))

    def _forest(self, psi_runs: bool) -> Forest:
        if psi_runs:
            start, text = self.list("p_start")
            return Forest.of_symbol_order(self.lengths, text, self.symbols("p_sym"), start, self.list("p_size")[0])
        start, text = self.list("run_start")
        return Forest.of_bwt_order(self.lengths, text, self.symbols("run_sym"), start)


def _first(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1), side="left")


def access_of(rows: Rows, f: Forest, how: Strategy) -> Access:
    """The samples and marks of a strategy, each by the strategy's own way."""
    n = len(rows.lengths)
    runs = _first(f.group // 257, n)
    trusted = lambda x: np.full(len(x), -1)
    if how.sampled and not len(rows.list("b_mark" if how.backward else "f_mark")[0]) or how.psi_runs and not how.sampled and not len(rows.list("p_head")[0]):
        raise ValueError("the index was built without samples")
    if not how.sampled:
        if how.psi_order:
            head, text = rows.placed("p_head")
            mark, after = rows.placed("p_tail")[0], np.arange(1, len(head) + 1)
            after[runs[1:] - 1] = runs[:-1]
            by = by_position(mark, f.total)
            return Access(by_run(None, np.arange(len(head)), head, len(head)), Marks(mark[by], head[after][by], trusted(mark), _first(text, n)))
        (head, text), (tail, _) = rows.placed("head_tpos"), rows.placed("tail_tpos")
        if how.backward:
            before = np.arange(-1, len(head) - 1)
            before[runs[:-1]] = runs[1:] - 1
            by = by_position(head, f.total)
            return Access(by_run(f.place, np.arange(len(tail)), tail, len(tail)), Marks(head[by], tail[before][by], trusted(head), _first(text, n)))
        # runs by row; their order by symbol is that of the forest
        after = np.empty(len(head), np.int64)
        nxt = np.arange(1, len(head) + 1)
        nxt[runs[1:] - 1] = runs[:-1]
        after[f.place] = f.place[nxt]
        by = by_position(tail, f.total)
        return Access(by_run(f.place, np.arange(len(head)), head, len(head)), Marks(tail[by], head[after][by], trusted(tail), _first(text, n)))
    side = "b" if how.backward else "f"
    mark, text = rows.placed(f"{side}_mark")
    area, first = rows.list(f"{side}_area")[0], _first(text, n)
    if how.psi_order:
        places, of = rows.list("f_places")
        heads = rows.placed("f_heads")[0]
        link = rows.list("f_link")[0] + _first(of, n)[text]
        return Access(by_run(None, places + runs[of], heads, len(f.start)), Marks(mark, heads[link], area, first))
    marks = Marks(mark, rows.placed(f"{side}_sample")[0], area, first)
    kept, of = rows.list(f"{side}_kept")
    ends = rows.placed("tail_tpos" if how.backward else "head_tpos")[0][kept + runs[of]]
    if how.backward:
        return Access(by_run(f.place, kept + runs[of], ends, len(f.start)), marks)
    at = rows.placed("f_rows")[0]
    return Access(by_row(at, ends), marks, at)


_FIXED = ["text_id", "n", "s"]


@dataclass
class Unsaved:
    """An index of texts that stands nowhere yet: ``make`` gives the rows of some texts, in the columns asked for, and each part of them is searched in the task that
    made it, so that no index is sent from task to task."""

    texts: DataFrame
    make: Callable[[pa.RecordBatch, list[str]], Iterator[pa.RecordBatch]]


Index = DataFrame | Unsaved
#: Numbers of text and pattern, and further columns.
Answer = Iterator[tuple[np.ndarray, np.ndarray, list[Any]]]
#: Occurrences resolved at once, about; one range is never cut.
RESOLVE = 1 << 22


def _searched(index: Index, patterns: DataFrame, columns: list[str], schema: str, answer: Callable[[Rows, list[bytes]], Answer]) -> DataFrame:
    """Rows (text_id, pattern_id, ...) of ``answer``: text and pattern numbers and further columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    source = index.texts.select("text_id", "body") if isinstance(index, Unsaved) else index.select(*_FIXED, *columns)
    make = index.make if isinstance(index, Unsaved) else None

    def one(block: list[Pattern]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, bodies = pa.array([i for i, _ in block], pa.int64()), [p for _, p in block]
            for b in (x for b in batches for x in (make(b, columns) if make else [b])):
                rates = b.column("s").to_numpy()
                for lo, hi in batches_of(b.column("n").to_numpy(), len(bodies), np.flatnonzero(rates[1:] != rates[:-1]) + 1):
                    rows = Rows(b.slice(lo, hi - lo))
                    for text, pattern, more in answer(rows, bodies):
                        yield pa.RecordBatch.from_arrays([rows.batch.column("text_id").take(pa.array(text)), ids.take(pa.array(pattern)), *map(pa.array, more)], names)

        return map_batches(source, run, schema)

    return _over_blocks(patterns, one)


def count(index: Index, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, occ, sa_start, sa_end of every pattern that occurs in a text; positions are not resolved."""

    def answer(rows: Rows, bodies: list[bytes]) -> Answer:
        f = rows.forest(False)
        x = search(f, bodies)
        yield x.text, x.pattern, [x.hi - x.lo, x.lo - f.base[x.text], x.hi - f.base[x.text]]

    return _searched(index, patterns, ["run_sym", "run_start"], "text_id long, pattern_id long, occ long, sa_start long, sa_end long", answer)


def _resolved(rows: Rows, how: Strategy, bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, pattern and position of occurrences, some ranges at a time."""
    f = rows.forest(how.psi_runs)
    whole = rows.once(("found", how.psi_runs, how.backward), lambda: search(f, bodies, how.backward))
    kind = ("access", how.backward, how.sampled, how.psi_order, how.psi_runs)
    access = None if how.slice or not len(whole.text) else rows.once(kind, lambda: access_of(rows, f, how))
    ends = np.cumsum(whole.hi - whole.lo)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + RESOLVE, RESOLVE)).clip(0, len(ends)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        x = Found(*(getattr(whole, k)[lo:hi] for k in ("text", "pattern", "lo", "hi", "row", "steps")))
        if how.slice:
            sa = rows.list("sa")[0]
            if len(sa) != f.total:
                raise ValueError("the index was built without its suffix array")
            size = x.hi - x.lo
            owner = np.repeat(np.arange(len(size)), size)
            pos = sa[np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + x.lo[owner]]
        else:
            owner, pos = resolve(f, x, access, how, rows.rate)
            pos = pos - f.base[x.text[owner]]
        yield x.text[owner], x.pattern[owner], pos


def locate(index: Index, patterns: DataFrame, strategy: str) -> DataFrame:
    """text_id, pattern_id, pos of every occurrence, overlapping ones too, in no order. All strategies give the same rows."""
    how = STRATEGIES[strategy]

    def answer(rows: Rows, bodies: list[bytes]) -> Answer:
        return ((text, pattern, [pos]) for text, pattern, pos in _resolved(rows, how, bodies))

    return _searched(index, patterns, columns_of(how), "text_id long, pattern_id long, pos long", answer)


def locate_by_each(index: Index, patterns: DataFrame, strategies: list[str]) -> DataFrame:
    """text_id, pattern_id, pos, strategy: what each strategy finds, in one pass over the index."""
    columns = list(dict.fromkeys(c for k in strategies for c in columns_of(STRATEGIES[k])))

    def answer(rows: Rows, bodies: list[bytes]) -> Answer:
        for k in strategies:
            for text, pattern, pos in _resolved(rows, STRATEGIES[k], bodies):
                yield text, pattern, [pos, pa.array([k]).take(pa.array(np.zeros(len(pos), np.int64)))]

    return _searched(index, patterns, columns, "text_id long, pattern_id long, pos long, strategy string", answer)


def sums_by_each(index: Index, patterns: DataFrame, strategies: list[str]) -> DataFrame:
    """text_id, pattern_id, strategy, occ, positions: how many occurrences each strategy finds in a text, and the sum of their positions, added up where they are found."""
    columns = list(dict.fromkeys(c for k in strategies for c in columns_of(STRATEGIES[k])))

    def answer(rows: Rows, bodies: list[bytes]) -> Answer:
        for k in strategies:
            for text, pattern, pos in _resolved(rows, STRATEGIES[k], bodies):
                # a range's occurrences stand together
                at = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pattern[1:] != pattern[:-1]))[: len(text)])
                if len(at):
                    yield text[at], pattern[at], [pa.array([k]).take(pa.array(np.zeros(len(at), np.int64))), np.diff(np.append(at, len(text))), np.add.reduceat(pos, at)]

    return _searched(index, patterns, columns, "text_id long, pattern_id long, strategy string, occ long, positions long", answer)


def first_occurrences(index: Index, patterns: DataFrame, strategy: str) -> DataFrame:
    """text_id, pattern_id, pos: the suffix-array entry at the end of each range (its start, for forward strategies), as backward search carries it."""
    how = STRATEGIES[strategy]

    def answer(rows: Rows, bodies: list[bytes]) -> Answer:
        f = rows.forest(how.psi_runs)
        x = search(f, bodies, how.backward)
        if len(x.text):
            value = first_values(f, x, access_of(rows, f, how), how.backward, rows.rate if how.sampled else 0)
            yield x.text, x.pattern, [value - f.base[x.text]]

    return _searched(index, patterns, columns_of(how), "text_id long, pattern_id long, pos long", answer)


def scan_locate(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, pos without an index: the choice for texts that are read once."""

    def one(block: list[Pattern]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], []]
                for t, body in zip(b.column("text_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                    for i, p in block if body is not None else ():
                        at = body.find(p)
                        while at >= 0:
                            out[0].append(t)
                            out[1].append(i)
                            out[2].append(at)
                            at = body.find(p, at + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["text_id", "pattern_id", "pos"])

        return map_batches(texts.select("text_id", "body"), run, "text_id long, pattern_id long, pos long")

    return _over_blocks(patterns, one)


def scan_count(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, occ of every pattern that occurs, without an index."""

    def one(block: list[Pattern]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], []]
                for t, body in zip(b.column("text_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                    for i, p in block if body is not None else ():
                        n = body.count(p)
                        if n and any(p.startswith(p[k:]) for k in range(1, len(p))):  # it may overlap itself
                            n, at = 0, body.find(p)
                            while at >= 0:
                                n, at = n + 1, body.find(p, at + 1)
                        if n:
                            out[0].append(t)
                            out[1].append(i)
                            out[2].append(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["text_id", "pattern_id", "occ"])

        return map_batches(texts.select("text_id", "body"), run, "text_id long, pattern_id long, occ long")

    return _over_blocks(patterns, one)


def slice_locate(sa: DataFrame, ranges: DataFrame) -> DataFrame:
    """text_id, pattern_id, pos by joining ranges (text_id, pattern_id, sa_start, sa_end) with a suffix-array relation."""
    return joined(ranges, sa.select("text_id", "i", "sa"), "text_id").where("i >= sa_start AND i < sa_end").select("text_id", "pattern_id", F.col("sa").alias("pos"))
