"""Lookups on runs: an as-of join without a join, interval overlap, and rank, select, access, LF, predecessor and successor on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .deal import dealt, joined


def asof(probes: DataFrame, table: DataFrame, by: list[str], at: str, key: str, values: list[str], backward: bool = True, strict: bool = False) -> DataFrame:
    """``probes`` with the ``values`` of the row of ``table`` whose ``key`` is the last at or before ``at`` (first at or after, if not ``backward``) within ``by``.

    ``strict`` leaves out an equal key. A union and one window: one shuffle on ``by``, whatever the number of probes for each key. Keys
    are unique within ``by``. Without such a row the values are NULL.
    """
    rest = [c for c in probes.columns if c not in by]
    left = probes.select(F.struct(*rest).alias("probe"), *by, F.col(at).alias("_at"), F.lit(None).cast(_struct(table, [key, *values])).alias("hit"))
    right = table.select(F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), *by, F.col(key).alias("_at"), F.struct(key, *values).alias("hit"))
    # rows are walked towards the probes, so that a frame only grows; at equal positions, probes come after the rows they may see
    sees = F.lit(1) if strict else F.lit(0)
    side = F.when(F.col("probe").isNull(), sees).otherwise(1 - sees)
    w = Window.partitionBy(*by).orderBy(F.asc("_at") if backward else F.desc("_at"), side)
    found = F.last("hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = dealt(left.unionByName(right), *by).withColumn("hit", found).where("probe IS NOT NULL")
    return both.select(*(F.col(c if c in by else f"probe.{c}") for c in probes.columns), *(F.col(f"hit.{v}").alias(v) for v in [key, *values]))


def _struct(table: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:{table.schema[n].dataType.simpleString()}" for n in names) + ">"


def access(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, pos) with run, sym at that BWT position."""
    return asof(probes, runs, ["text_id"], "pos", "start", ["run", "sym"]).drop("start")


def rank(runs2: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, sym, pos) with rank: occurrences of sym in [0, pos); symbol_run: runs of sym begun before pos; covers: whether pos lies in one, or at its end."""
    found = asof(probes, runs2, ["text_id", "sym"], "pos", "start", ["end_excl", "sym_before", "sym_run"], strict=True)
    count = F.coalesce(F.col("sym_before") + F.least("pos", "end_excl") - F.col("start"), F.lit(0)).cast("long")
    return found.select(*probes.columns, count.alias("rank"), F.coalesce(F.col("sym_run") + 1, F.lit(0)).cast("long").alias("symbol_runs"), F.coalesce(F.col("pos") <= F.col("end_excl"), F.lit(False)).alias("covers"))


def select(runs2: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, sym, k from 1) with pos of the k-th sym, NULL if there are fewer."""
    found = asof(probes, runs2.select("text_id", "sym", "sym_before", "start", "end_excl"), ["text_id", "sym"], "k", "sym_before", ["start", "end_excl"], strict=True)
    pos = F.col("start") + F.col("k") - 1 - F.col("sym_before")
    return found.select(*probes.columns, F.when((F.col("k") >= 1) & (pos < F.col("end_excl")), pos).alias("pos"))


def select_run(runs2: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, sym, k from 1) with run: the k-th run of sym."""
    return joined(probes, runs2.select("text_id", "sym", (F.col("sym_run") + 1).alias("k"), "run"), ["text_id", "sym", "k"], "left")


def lf_range(runs2: DataFrame, alphabet: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (text_id, lo, hi, sym) with new_lo, new_hi: one step of backward search; empty (equal) where sym does not occur in the range."""
    both = ranges.select(*ranges.columns, F.explode(F.array("lo", "hi")).alias("pos")).distinct()
    ranked = rank(runs2, both)
    ends = joined(ranked, alphabet.select("text_id", "sym", "c_before"), ["text_id", "sym"]).withColumn("to", F.col("c_before") + F.col("rank"))
    return ends.groupBy(*ranges.columns).agg(F.min("to").alias("new_lo"), F.max("to").alias("new_hi"))


def _over_runs(ranges: DataFrame, runs: DataFrame, by: list[str], lo: str, hi: str, start: str, number: str) -> DataFrame:
    """``ranges`` with ``number`` of each run that they overlap: the runs of both ends are looked up and those between counted, so no range meets a run that it does not overlap."""
    named = runs.select(*by, F.col(start).alias("_s"), F.col(number).alias("_k"))
    some = ranges.where(F.col(lo) < F.col(hi)).withColumn("_last", F.col(hi) - 1)
    begun = asof(some, named, by, lo, "_s", ["_k"]).drop("_s").withColumnRenamed("_k", "_from")
    ended = asof(begun, named, by, "_last", "_s", ["_k"]).drop("_s")
    return ended.where("_k IS NOT NULL").select(*ranges.columns, F.explode(F.sequence(F.coalesce("_from", F.lit(0).cast("long")), "_k")).alias(number))


def split_in_runs(runs: DataFrame, ranges: DataFrame, clip: bool = True) -> DataFrame:
    """ranges (text_id, lo, hi) with the runs that they overlap: run, sym, start, end_excl, cut to the range or, without ``clip``, whole."""
    r = runs.select("text_id", "run", "sym", F.col("start").alias("_s"), F.col("end_excl").alias("_e"))
    hit = joined(_over_runs(ranges, runs, ["text_id"], "lo", "hi", "start", "run"), r, ["text_id", "run"]).where("_e > lo")
    a, b = (F.greatest("lo", "_s"), F.least("hi", "_e")) if clip else (F.col("_s"), F.col("_e"))
    return hit.select(*ranges.columns, "run", "sym", a.alias("start"), b.alias("end_excl"))


def break_range(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (text_id, lo, hi, sym) with the parts of them that hold the symbol: run, start, end_excl."""
    found = split_in_runs(runs.withColumnRenamed("sym", "_sym").withColumn("sym", F.col("_sym")), ranges.withColumnRenamed("sym", "wanted"))
    return found.where("sym = wanted").select(*ranges.columns, "run", "start", "end_excl")


def forward_runs(runs2: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (text_id, sym, k_lo, k_hi: ranks from 1, half-open) with the BWT intervals of those occurrences."""
    first = (F.col("sym_before") + 1).alias("_k1")
    r = runs2.select("text_id", "sym", "sym_run", "run", F.col("start").alias("_s"), first, (F.col("end_excl") - F.col("start")).alias("_n"))
    named = runs2.select("text_id", "sym", "sym_run", first)
    hit = joined(_over_runs(ranges, named, ["text_id", "sym"], "k_lo", "k_hi", "_k1", "sym_run"), r, ["text_id", "sym", "sym_run"]).where("_k1 < k_hi AND _k1 + _n > k_lo")
    begin = F.col("_s") + F.greatest("k_lo", "_k1") - F.col("_k1")
    return hit.select(*ranges.columns, "run", begin.alias("start"), (begin + F.least("k_hi", F.col("_k1") + F.col("_n")) - F.greatest("k_lo", "_k1")).alias("end_excl"))


def own_rank(runs2: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, pos) with the symbol there, its rank (occurrences before), its run, that run's bounds and its place among the symbol's runs."""
    found = asof(probes, runs2, ["text_id"], "pos", "start", ["end_excl", "sym", "sym_before", "sym_run", "run"])
    rank = (F.col("sym_before") + F.col("pos") - F.col("start")).cast("long")
    return found.select(*probes.columns, "sym", rank.alias("rank"), "run", F.col("start").alias("run_start"), F.col("end_excl").alias("run_end"), "sym_run")


def rank_run(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, v) with below: runs that start before v; upto: those that start at v or before; run_start: where the last of these starts."""
    soft = asof(probes, runs.select("text_id", "start", "run"), ["text_id"], "v", "start", ["run"])
    upto = F.coalesce(F.col("run") + 1, F.lit(0)).cast("long")
    return soft.select(*probes.columns, (upto - F.coalesce((F.col("start") == F.col("v")).cast("int"), F.lit(0))).cast("long").alias("below"), upto.alias("upto"), F.col("start").alias("run_start"))


def run_at(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, run) with sym, start, end_excl and length of that run."""
    return joined(probes, runs.select("text_id", "run", "sym", "start", "end_excl", (F.col("end_excl") - F.col("start")).alias("length")), ["text_id", "run"])


def traverse(runs2: DataFrame, symbols: DataFrame) -> DataFrame:
    """All runs of some symbols (text_id, sym), numbered within each: sym_run, run, start, end_excl."""
    return joined(symbols, runs2.select("text_id", "sym", "sym_run", "run", "start", "end_excl"), ["text_id", "sym"])


def first_symbol(runs: DataFrame) -> DataFrame:
    """text_id, sym of the first row of the BWT, sigma (symbols, the sentinel among them) and size of the text."""
    return runs.groupBy("text_id").agg(F.min_by("sym", "start").alias("sym"), F.count_distinct("sym").alias("sigma"), F.max("end_excl").alias("size"))


def _circular(marks: DataFrame, probes: DataFrame, backward: bool, *values: str) -> DataFrame:
    w = Window.partitionBy("text_id").orderBy("mark")
    numbered = marks.select("text_id", "mark", (F.row_number().over(w) - 1).cast("long").alias("order"), *values)
    found = asof(probes, numbered, ["text_id"], "v", "mark", ["order", *values], backward, strict=backward)
    ends = numbered.groupBy("text_id").agg((F.max if backward else F.min)(F.struct("mark", "order", *values)).alias("wrap"))

    def either(name: str) -> Column:
        return F.coalesce(F.col(name), F.col(f"wrap.{name}")).alias(name)

    return joined(found, ends, "text_id", "left").select(*probes.columns, either("order"), either("mark"), *map(either, values))


def predecessor(marks: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, v) with order and mark: the largest mark under v, or the largest of all."""
    return _circular(marks, probes, True)


def successor(marks: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, v) with order and mark: the smallest mark of at least v, or the smallest of all."""
    return _circular(marks, probes, False)


def phi_by_marks(links: DataFrame, lengths: DataFrame, probes: DataFrame, backward: bool) -> DataFrame:
    """probes (text_id, v) with next_v: the neighbouring suffix-array entry, from links (text_id, mark, sample) and lengths (text_id, n) alone."""
    sized = joined(_circular(links, probes, backward, "sample"), lengths.select("text_id", "n"), "text_id")
    gap = F.pmod((F.col("v") - F.col("mark")) if backward else (F.col("mark") - F.col("v")), F.col("n"))
    step = F.col("sample") + gap if backward else F.col("sample") - gap
    return sized.select(*probes.columns, F.pmod(step, F.col("n")).alias("next_v"))


def symbol_of_row(alphabet: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with sym: the first symbol of the i-th suffix."""
    return asof(probes, alphabet.select("text_id", "c_before", F.col("sym").alias("symbol")), ["text_id"], "i", "c_before", ["symbol"]).select(*probes.columns, F.col("symbol").alias("sym"))


def exist(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """Those probes (text_id, sym, pos) whose BWT position holds the symbol."""
    found = asof(probes, runs.select("text_id", "start", F.col("sym").alias("_sym")), ["text_id"], "pos", "start", ["_sym"])
    return found.where("sym = _sym").select(*probes.columns)


def closest_run_break(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, sym, pos) with break_pos: the head or the tail of a run of sym nearest to pos (of two as near the smaller), NULL without such a run."""
    by = ["text_id", "sym"]
    rest = [c for c in probes.columns if c not in by]
    left = probes.select(F.struct(*rest).alias("probe"), *by, F.col("pos").alias("_at"), F.lit(None).cast("struct<start:long,last:long>").alias("run"))
    right = runs.select(F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), *by, F.col("start").alias("_at"), F.struct("start", (F.col("end_excl") - 1).alias("last")).alias("run"))
    # the run that begins last at or before pos and the one that begins next: one shuffle for the walks both ways
    side, frame = F.col("probe").isNotNull(), (Window.unboundedPreceding, Window.currentRow)
    up, down = Window.partitionBy(*by).orderBy("_at", side), Window.partitionBy(*by).orderBy(F.desc("_at"), side.desc())
    near = {"below": F.last("run", ignorenulls=True).over(up.rowsBetween(*frame)), "above": F.last("run", ignorenulls=True).over(down.rowsBetween(*frame))}
    found = dealt(left.unionByName(right), *by).withColumns(near).where("probe IS NOT NULL")
    breaks = [F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(x) - F.col("_at")).alias("far"), F.col(x).alias("at"))) for x in ("below.start", "below.last", "above.start")]
    return found.select(*(F.col(c if c in by else f"probe.{c}") for c in probes.columns), F.array_min(F.array(*breaks))["at"].alias("break_pos"))


def gaps(marks: DataFrame) -> DataFrame:
    """marks (text_id, mark) with order and gap: the distance to the mark before, NULL for the first."""
    w = Window.partitionBy("text_id").orderBy("mark")
    return marks.select("text_id", "mark", (F.row_number().over(w) - 1).cast("long").alias("order"), (F.col("mark") - F.lag("mark").over(w)).alias("gap"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """text_id, bwt: the symbols that the runs stand for, as two hexadecimal digits each."""
    size = (F.col("end_excl") - F.col("start")).cast("int")
    one = F.struct("run", F.repeat(F.lpad(F.hex("sym"), 2, "0"), size).alias("part"))
    return runs.groupBy("text_id").agg(F.sort_array(F.collect_list(one)).alias("parts")).select("text_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("bwt"))
