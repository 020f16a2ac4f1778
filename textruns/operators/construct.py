"""Relations of a text's index, each a DataFrame with a ``text_id``: from texts to runs, the successor permutation, links and samples.

Rows name their text by ``text_id``, so ids must be distinct and not NULL (``sources.texts.with_distinct_ids`` checks it).

A text of n - 1 bytes has positions 0 to n - 1, the last being the sentinel (symbol 0, before every byte). Positions count bytes. The suffix
array is built text by text in an Arrow kernel next to the scan, so no text is ever exploded to be sorted; everything after it is a
window, a join or an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textruns.functions.cluster import map_batches, shared_dir
from textruns.functions.kernels import Runs, Samples, sorted_suffixes

from .deal import dealt, joined

#: Bytes of text whose suffix arrays are built together.
TOGETHER = 1 << 20

SUFFIX_SCHEMA = "text_id long, n long, i long, sa long, text_pos long, sym int"


def by_size(ids: pa.Array, bodies: pa.Array, most: int = TOGETHER) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of a batch, some at a time; NULL bodies are left out, NULL ids are not; a text with an inner NUL byte is an error."""
    some_ids: list[int] = []
    some: list[bytes] = []
    size = 0
    for i, b in zip(ids.to_pylist(), bodies.to_pylist(), strict=True):
        if b is None:
            continue
        if b"\0" in b:
            raise ValueError(f"text {i} has an inner NUL byte")
        some_ids.append(i)
        some.append(b)
        size += len(b) + 1
        if size >= most:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some


def symbols(texts: DataFrame) -> DataFrame:
    """text_id, pos, sym: every byte and the sentinel."""
    n = F.length("body")
    sym = F.transform(F.sequence(F.lit(0), n), lambda p: F.when(p < n, F.conv(F.hex(F.substring("body", p + 1, F.lit(1))), 16, 10).cast("int")).otherwise(F.lit(0)))
    return texts.where("body IS NOT NULL").select("text_id", F.posexplode(sym).alias("pos", "sym")).withColumn("pos", F.col("pos").cast("long"))


def alphabet(syms: DataFrame) -> DataFrame:
    """text_id, sym, code (dense rank), freq, c_before: occurrences of smaller symbols."""
    w = Window.partitionBy("text_id").orderBy("sym")
    counted = dealt(syms.select("text_id", "sym"), "text_id").groupBy("text_id", "sym").agg(F.count("*").alias("freq"))
    return counted.select("text_id", "sym", (F.row_number().over(w) - 1).cast("long").alias("code"), "freq", F.coalesce(F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("c_before"))


def f_array(alpha: DataFrame) -> DataFrame:
    """text_id, byte, first: for each of 0 to 256, where that byte's suffixes begin in the suffix array."""
    w = Window.partitionBy("text_id").orderBy("sym")
    # a symbol stands for the bytes after it up to the next symbol, the first one also for those up to itself
    stretch = F.sequence(F.when(F.col("c_before") == 0, F.lit(0)).otherwise(F.col("sym") + 1), F.coalesce(F.lead("sym").over(w), F.lit(256)))
    first = F.when(F.col("byte") > F.col("sym"), F.col("c_before") + F.col("freq")).otherwise(F.lit(0))
    spread = alpha.select("text_id", "sym", "freq", "c_before", stretch.alias("bytes"))
    return spread.select("text_id", "sym", "freq", "c_before", F.explode("bytes").alias("byte")).select("text_id", "byte", first.cast("long").alias("first"))


def suffix_array(texts: DataFrame) -> DataFrame:
    """text_id, n, i, sa, text_pos (of the BWT symbol), sym (the BWT symbol)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, bodies in by_size(b.column("text_id"), b.column("body")):
                base, sa = sorted_suffixes(bodies)
                n = np.diff(base)
                own = np.repeat(base[:-1], n)
                before = np.arange(-1, len(sa) - 1)
                before[base[:-1]] = base[1:] - 1
                tpos = before[sa]
                sym = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)[tpos].astype(np.int32)
                text_id = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), n)))
                yield pa.RecordBatch.from_arrays([text_id, pa.array(np.repeat(n, n)), pa.array(np.arange(len(sa)) - own), pa.array(sa - own), pa.array(tpos - own), pa.array(sym)], ["text_id", "n", "i", "sa", "text_pos", "sym"])

    return map_batches(texts.select("text_id", "body"), run, SUFFIX_SCHEMA)


def suffix_array_by_windows(syms: DataFrame) -> DataFrame:
    """text_id, i, sa by prefix doubling with windows alone, as often as the longest text needs: an alternative to the kernel, to check it."""
    by = Window.partitionBy("text_id")
    ranked = syms.select("text_id", "pos", F.dense_rank().over(by.orderBy("sym")).alias("rank"))
    longest, step = (syms.agg(F.max("pos")).first()[0] or 0) + 1, 1
    while step < longest:
        ahead = F.coalesce(F.lead("rank", step).over(by.orderBy("pos")), F.lit(0))
        ranked = ranked.withColumn("ahead", ahead).select("text_id", "pos", F.dense_rank().over(by.orderBy("rank", "ahead")).alias("rank"))
        step *= 2
    return ranked.select("text_id", (F.col("rank") - 1).cast("long").alias("i"), F.col("pos").alias("sa"))


#: Ways to build a suffix array, by name: of texts that a task can hold, by windows, and of texts of any length.
ALGORITHMS = ("kernel", "windows", "blocks")


def suffix_array_by(texts: DataFrame, algorithm: str = "kernel") -> DataFrame:
    """text_id, i, sa by the named algorithm."""
    if algorithm == "kernel":
        return suffix_array(texts).select("text_id", "i", "sa")
    if algorithm == "windows":
        return suffix_array_by_windows(symbols(texts))
    if algorithm == "blocks":
        return suffix_array_by_blocks(symbols(texts))
    raise ValueError(f"unknown algorithm {algorithm!r}; there are {', '.join(ALGORITHMS)}")


def suffix_array_by_blocks(syms: DataFrame) -> DataFrame:
    """text_id, i, sa of texts of any length, each spread over many tasks: prefix doubling by joins and small windows.

    A suffix's rank is the number of suffixes of its text that are known to be smaller. In each round those that share their rank are ranked by the rank of
    the suffix ``step`` behind, which a join on the position finds; the others are settled. The first round has a window for each symbol, later ones a
    window for each repeated string. Rounds are as many as the logarithm of the longest repeat; each is a checkpoint in the folder that executors share.
    """
    context = syms.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(syms.sparkSession))
    ranked = joined(syms.select("text_id", "pos", "sym"), alphabet(syms).select("text_id", "sym", F.col("c_before").alias("rank")), ["text_id", "sym"]).select("text_id", "pos", "rank")
    step = 1
    while True:
        same = Window.partitionBy("text_id", "rank")
        ranked = ranked.withColumn("alone", F.count("*").over(same) == 1).checkpoint()
        if ranked.where("NOT alone").isEmpty():
            return ranked.select("text_id", F.col("rank").cast("long").alias("i"), F.col("pos").alias("sa"))
        ahead = ranked.select("text_id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("ahead")).where("pos >= 0")
        open_ = joined(ranked.where("NOT alone"), ahead, ["text_id", "pos"], "left")
        moved = open_.select("text_id", "pos", (F.col("rank") + F.rank().over(same.orderBy(F.coalesce("ahead", F.lit(-1)))) - 1).cast("long").alias("rank"))
        ranked = ranked.where("alone").select("text_id", "pos", "rank").union(moved)
        step *= 2


def bwt(sa: DataFrame) -> DataFrame:
    return sa.select("text_id", "i", "sym", "text_pos")


def bwt_runs(bwt_: DataFrame) -> DataFrame:
    """text_id, run, sym, start, end_excl, head_tpos, tail_tpos."""
    w = Window.partitionBy("text_id").orderBy("i")
    head = F.when(F.lag("sym").over(w).eqNullSafe(F.col("sym")), 0).otherwise(1)
    numbered = dealt(bwt_, "text_id").withColumn("head", head).withColumn("run", F.sum("head").over(w) - 1)
    return numbered.groupBy("text_id", "run").agg(
        F.min("sym").alias("sym"), F.min("i").alias("start"), (F.max("i") + 1).alias("end_excl"), F.min_by("text_pos", "i").alias("head_tpos"), F.max_by("text_pos", "i").alias("tail_tpos")
    )


def ordered_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with sym_before (earlier occurrences of the symbol), sym_run (earlier runs of it), prun (place by symbol, then position) and f_start (where it begins in the first column)."""
    of_sym = Window.partitionBy("text_id", "sym").orderBy("run")
    of_text = Window.partitionBy("text_id").orderBy("sym", "run")
    before = Window.unboundedPreceding, -1
    size = F.col("end_excl") - F.col("start")
    return runs.withColumns(
        {
            "sym_before": F.coalesce(F.sum(size).over(of_sym.rowsBetween(*before)), F.lit(0)).cast("long"),
            "sym_run": (F.row_number().over(of_sym) - 1).cast("long"),
            "prun": (F.row_number().over(of_text) - 1).cast("long"),
            "f_start": F.coalesce(F.sum(size).over(of_text.rowsBetween(*before)), F.lit(0)).cast("long"),
        }
    )


def runs_per_symbol(runs: DataFrame) -> DataFrame:
    """text_id, sym, n_runs, cum_runs: runs of this and smaller symbols."""
    counted = runs.groupBy("text_id", "sym").agg(F.count("*").alias("n_runs"))
    return counted.withColumn("cum_runs", F.sum("n_runs").over(Window.partitionBy("text_id").orderBy("sym")).cast("long"))


def psi(bwt_: DataFrame) -> DataFrame:
    """text_id, j, psi: the successor permutation."""
    w = Window.partitionBy("text_id").orderBy("sym", "i")
    return dealt(bwt_.select("text_id", "sym", "i"), "text_id").select("text_id", (F.row_number().over(w) - 1).cast("long").alias("j"), F.col("i").alias("psi"))


def lf(bwt_: DataFrame) -> DataFrame:
    """text_id, i, lf: the inverse of psi."""
    return psi(bwt_).select("text_id", F.col("psi").alias("i"), F.col("j").alias("lf"))


def phi(sa: DataFrame, backward: bool) -> DataFrame:
    """text_id, v, next_v: the suffix-array entry before (or after) each entry, NULL at the end."""
    w = Window.partitionBy("text_id").orderBy("i")
    return dealt(sa.select("text_id", "i", "sa"), "text_id").select("text_id", F.col("sa").alias("v"), (F.lag("sa") if backward else F.lead("sa")).over(w).alias("next_v"))


def links_backward(runs: DataFrame) -> DataFrame:
    """text_id, mark (head), sample (the tail before it, circular), mark_order, sample_run."""
    w = Window.partitionBy("text_id").orderBy("run")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = runs.select(
        "text_id", F.col("head_tpos").alias("mark"), F.coalesce(F.lag("tail_tpos").over(w), F.last("tail_tpos").over(all_)).alias("sample"), F.coalesce(F.lag("run").over(w), F.last("run").over(all_)).cast("long").alias("sample_run")
    )
    return linked.withColumn("mark_order", (F.row_number().over(Window.partitionBy("text_id").orderBy("mark")) - 1).cast("long"))


def links_forward(runs2: DataFrame) -> DataFrame:
    """text_id, mark (tail), sample (the head after it by symbol, circular), mark_order, sample_prun."""
    w = Window.partitionBy("text_id").orderBy("prun")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = runs2.select(
        "text_id", F.col("tail_tpos").alias("mark"), F.coalesce(F.lead("head_tpos").over(w), F.first("head_tpos").over(all_)).alias("sample"), F.coalesce(F.lead("prun").over(w), F.first("prun").over(all_)).cast("long").alias("sample_prun")
    )
    return linked.withColumn("mark_order", (F.row_number().over(Window.partitionBy("text_id").orderBy("mark")) - 1).cast("long"))


def extremes(runs: DataFrame) -> DataFrame:
    """text_id, first and last run's head and tail positions."""
    return runs.groupBy("text_id").agg(F.min_by("head_tpos", "run").alias("first_head"), F.max_by("head_tpos", "run").alias("last_head"), F.min_by("tail_tpos", "run").alias("first_tail"), F.max_by("tail_tpos", "run").alias("last_tail"))


def counters(texts: DataFrame) -> DataFrame:
    """text_id, n, r: in one pass, without exploding a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, bodies in by_size(b.column("text_id"), b.column("body")):
                base, sa = sorted_suffixes(bodies)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(base)), pa.array(np.diff(Runs.of(bodies, base, sa).first))], ["text_id", "n", "r"])

    return map_batches(texts.select("text_id", "body"), run, "text_id long, n long, r long")


def subsamples(texts: DataFrame, s: int, backward: bool) -> DataFrame:
    """text_id, run, tpos: the run ends (tails backward, heads forward) that sub-sampling at rate ``s`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, bodies in by_size(b.column("text_id"), b.column("body")):
                base, sa = sorted_suffixes(bodies)
                runs = Runs.of(bodies, base, sa)
                kept = np.flatnonzero(Samples.of(runs, backward, s).kept)
                text = runs.text[kept]
                tpos = (runs.tail_tpos if backward else runs.head_tpos)[kept] - base[text]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(text)), pa.array(kept - runs.first[text]), pa.array(tpos)], ["text_id", "run", "tpos"])

    return map_batches(texts.select("text_id", "body"), run, "text_id long, run long, tpos long")


def sample_links(links: DataFrame) -> DataFrame:
    """text_id, sample, sample_order (among the samples by position), mark, mark_order: the links from samples to marks, one to one."""
    w = Window.partitionBy("text_id").orderBy("sample")
    return links.select("text_id", "sample", (F.row_number().over(w) - 1).cast("long").alias("sample_order"), "mark", "mark_order")


def subsample_places(kept: DataFrame, runs2: DataFrame) -> DataFrame:
    """Kept samples (text_id, run) with row_order (among the kept ones by row), start (the first row of the run), prun and symbol_order (among the kept ones by symbol)."""
    by_row, by_symbol = (Window.partitionBy("text_id").orderBy(k) for k in ("run", "prun"))
    number = lambda w: (F.row_number().over(w) - 1).cast("long")
    placed = joined(kept.select("text_id", "run"), runs2.select("text_id", "run", "start", "prun"), ["text_id", "run"])
    return placed.select("text_id", "run", "start", "prun", number(by_row).alias("row_order"), number(by_symbol).alias("symbol_order"))


def submark_links(links: DataFrame, places: DataFrame, backward: bool) -> DataFrame:
    """text_id, mark, mark_order (among the kept marks by position), row_order and symbol_order of the kept sample that it leads to."""
    key = "run" if backward else "prun"
    led = joined(links.select("text_id", "mark", F.col("sample_run" if backward else "sample_prun").alias(key)), places, ["text_id", key])
    w = Window.partitionBy("text_id").orderBy("mark")
    return led.select("text_id", "mark", (F.row_number().over(w) - 1).cast("long").alias("mark_order"), "row_order", "symbol_order")


def submarks(links: DataFrame, kept: DataFrame, sample_key: str) -> DataFrame:
    """The links whose sample is kept: text_id, mark, sample. ``kept`` has text_id and ``sample_key``."""
    return joined(links, kept.select("text_id", sample_key), ["text_id", sample_key], "left_semi").select("text_id", "mark", "sample")


def validity(links: DataFrame, sub: DataFrame, backward: bool) -> DataFrame:
    """text_id, mark, valid, area of each kept mark: valid unless the next full mark (the previous one, forward) was left out; then area is the distance to it, else NULL."""
    w = Window.partitionBy("text_id").orderBy("mark" if backward else F.desc("mark"))
    full = links.select("text_id", "mark", F.lead("mark").over(w).alias("next_full"))
    kept = sub.select("text_id", "mark", F.lead("mark").over(w).alias("next_kept"))
    ok = F.col("next_full").eqNullSafe(F.col("next_kept"))
    return joined(kept, full, ["text_id", "mark"]).select("text_id", "mark", ok.alias("valid"), F.when(~ok, F.abs(F.col("next_full") - F.col("mark"))).alias("area"))
