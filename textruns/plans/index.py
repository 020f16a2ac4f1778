"""A text index as a table, one row a text: its runs, and marks and samples of both directions at one sub-sampling rate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textruns.functions.cluster import map_batches
from textruns.functions.kernels import STRATEGIES, Runs, Samples, Strategy, sorted_suffixes
from textruns.operators import search
from textruns.operators.construct import by_size

#: Lists of a row. Runs by row: run_*, *_tpos; b_* and f_*: marks of the backward and forward direction, kept runs by row; f_rows: kept heads by row.
#: Runs by symbol: p_*, with the kept ones' places and samples (f_places, f_heads), and for each forward mark the place of its sample among these (f_link).
_LISTS = (
    "run_start", "head_tpos", "tail_tpos", "b_kept", "b_mark", "b_sample", "b_area", "f_kept", "f_mark", "f_sample", "f_area", "f_rows",
    "p_start", "p_size", "p_head", "p_tail", "f_places", "f_heads", "f_link", "sa",
)
#: Columns of every index.
_LEAN = {"run_sym", "run_start", "head_tpos", "tail_tpos", "p_sym", "p_start", "p_size", "sa"}
SCHEMA = "text_id long, n long, r long, s int, run_sym binary, p_sym binary, " + ", ".join(f"{k} array<int>" for k in _LISTS)


def register_strategy(strategy: Strategy) -> None:
    """Make a further combination of direction, sampling and validity known by name."""
    STRATEGIES[strategy.name] = strategy


def _symbols(sym: np.ndarray, at: np.ndarray) -> pa.Array:
    whole = np.maximum(sym, 0).astype(np.uint8).tobytes()
    return pa.array([whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def index_batch(ids: list[int], bodies: list[bytes], s: int, keep_suffix_array: bool, keep_samples: bool) -> pa.RecordBatch:
    """Index rows of some texts, built together."""
    base, sa = sorted_suffixes(bodies)
    runs = Runs.of(bodies, base, sa)
    psi, first, origin = runs.by_symbol, runs.first, base[runs.text]
    none = np.zeros(len(ids) + 1, np.int64), np.zeros(0, np.int64)
    lists: dict[str, tuple[np.ndarray, np.ndarray]] = dict.fromkeys(_LISTS, none)
    lists |= {"run_start": (first, runs.start - origin), "head_tpos": (first, runs.head_tpos - origin), "tail_tpos": (first, runs.tail_tpos - origin)}
    lists |= {"p_start": (first, (runs.start - origin)[psi]), "p_size": (first, runs.size[psi])}
    if keep_samples:
        lists |= {"p_head": (first, (runs.head_tpos - origin)[psi]), "p_tail": (first, (runs.tail_tpos - origin)[psi])}
        for side, backward in (("b", True), ("f", False)):
            x = Samples.of(runs, backward, s)
            kept = np.flatnonzero(x.kept)
            own, of = base[runs.text[x.run]], np.searchsorted(kept, first)
            lists |= {f"{side}_kept": (of, kept - first[runs.text[kept]]), f"{side}_mark": (x.first, x.mark - own), f"{side}_sample": (x.first, x.sample - own), f"{side}_area": (x.first, np.where(x.valid, -1, x.area))}
        lists["f_rows"] = of, (runs.start - origin)[kept]
        places = np.flatnonzero(x.kept[psi])
        heads = psi[places]
        lists |= {"f_places": (of, places - first[runs.text[heads]]), "f_heads": (of, (runs.head_tpos - origin)[heads])}
        lists["f_link"] = x.first, np.searchsorted(places, runs.symbol_rank[x.run]) - of[runs.text[x.run]]
    if keep_suffix_array:
        lists["sa"] = base, sa - np.repeat(base[:-1], np.diff(base))
    fixed = [pa.array(ids, pa.int64()), pa.array(np.diff(base)), pa.array(np.diff(first)), pa.array(np.full(len(ids), s, np.int32)), _symbols(runs.sym, first), _symbols(runs.sym[psi], first)]
    return pa.RecordBatch.from_arrays([*fixed, *(pa.ListArray.from_arrays(pa.array(a.astype(np.int32)), pa.array(v.astype(np.int32))) for a, v in lists.values())], ["text_id", "n", "r", "s", "run_sym", "p_sym", *lists])


@dataclass
class TextIndex:
    """Answers count and locate; built once, saved, loaded. ``data`` is read lazily and only in the columns that a strategy needs."""

    data: DataFrame
    unsaved: search.Unsaved | None = None

    @staticmethod
    def build(texts: DataFrame, s: int = 4, keep_suffix_array: bool = True, keep_samples: bool = True) -> TextIndex:
        """Index texts (text_id, body BINARY) where they lie: no shuffle. ``s`` is the sub-sampling rate, kept in the index.

        Counting and the strategies without sampling need the runs alone; ``sa_slice`` needs the suffix array, the sampled ones the samples. A row
        is an index of its own, whatever its text_id: NULL and repeated ones are kept as they are. A NULL body has no row.
        """
        if s < 1:
            raise ValueError("the sub-sampling rate is at least 1")

        def make(b: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
            for ids, bodies in by_size(b.column("text_id"), b.column("body")):
                yield index_batch(ids, bodies, s, keep_suffix_array and "sa" in columns, keep_samples and not _LEAN.issuperset(columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from make(b, list(_LISTS))

        return TextIndex(map_batches(texts.select("text_id", "body"), run, SCHEMA), search.Unsaved(texts, make))

    def save(self, path: str) -> None:
        self.data.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(spark.read.schema(SCHEMA).parquet(path))

    def count(self, patterns: DataFrame) -> DataFrame:
        return search.count(self.unsaved or self.data, patterns)

    def locate(self, patterns: DataFrame, strategy: str = "tails") -> DataFrame:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
        return search.locate(self.unsaved or self.data, patterns, strategy)

    def locate_by_each(self, patterns: DataFrame, strategies: list[str] | None = None) -> DataFrame:
        return search.locate_by_each(self.unsaved or self.data, patterns, strategies or list(STRATEGIES))

    def sums_by_each(self, patterns: DataFrame, strategies: list[str] | None = None) -> DataFrame:
        return search.sums_by_each(self.unsaved or self.data, patterns, strategies or list(STRATEGIES))

    def first_occurrences(self, patterns: DataFrame, strategy: str = "tails") -> DataFrame:
        return search.first_occurrences(self.unsaved or self.data, patterns, strategy)

    def sizes(self) -> DataFrame:
        """text_id, part, bytes: how large each part of the index is, at 4 bytes a number and 1 a symbol."""
        lists = [F.struct(F.lit(k).alias("part"), (F.size(k) * 4).cast("long").alias("bytes")) for k in _LISTS]
        symbols = [F.struct(F.lit(k).alias("part"), F.length(k).cast("long").alias("bytes")) for k in ("run_sym", "p_sym")]
        return self.data.select("text_id", F.explode(F.array(*lists, *symbols)).alias("x")).select("text_id", "x.part", "x.bytes")

    def bits_per_symbol(self, strategy: str) -> DataFrame:
        """text_id, bits: what a strategy reads of the index, for each symbol of the text, if each number took the bits that the text's length needs, and a symbol 8."""
        numbers = sum((F.size(k) for k in search.columns_of(STRATEGIES[strategy]) if k in _LISTS), F.lit(0))
        symbols = F.length("p_sym" if STRATEGIES[strategy].psi_runs else "run_sym")
        return self.data.select("text_id", ((numbers * F.ceil(F.log2(F.col("n") + 1)) + 8 * symbols) / F.col("n")).alias("bits"))

    def counters(self) -> DataFrame:
        """text_id, n, r, s, kept samples and valid marks of both directions."""
        valid = {f"{d}_valid": F.size(F.filter(f"{d}_area", lambda a: a < 0)).cast("long") for d in "bf"}
        kept = {f"{d}_kept_n": F.size(f"{d}_kept").cast("long") for d in "bf"}
        return self.data.select("text_id", "n", "r", "s", *(v.alias(k) for k, v in (kept | valid).items()))


def sweep(texts: DataFrame, rates: tuple[int, ...] = (4, 8, 16, 32, 64, 128, 256, 512)) -> DataFrame:
    """text_id, s, n, r, kept_b, kept_f, valid_b, valid_f at every rate; the suffix array of each text is built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, bodies in by_size(b.column("text_id"), b.column("body")):
                base, sa = sorted_suffixes(bodies)
                runs = Runs.of(bodies, base, sa)
                for s in rates:
                    both = [Samples.of(runs, backward, s) for backward in (True, False)]
                    kept = [np.add.reduceat(x.kept.astype(np.int64), runs.first[:-1]) for x in both]
                    valid = [np.add.reduceat(x.valid.astype(np.int64), x.first[:-1]) for x in both]
                    columns = [np.full(len(ids), s), np.diff(base), np.diff(runs.first), *kept, *valid]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c.astype(np.int64)) for c in columns)], ["text_id", "s", "n", "r", "kept_b", "kept_f", "valid_b", "valid_f"])

    return map_batches(texts.select("text_id", "body"), run, "text_id long, s long, n long, r long, kept_b long, kept_f long, valid_b long, valid_f long")
