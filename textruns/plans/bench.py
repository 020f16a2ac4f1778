"""Timing of strategies on a standing index: all patterns at once, one at a time, or once with the results written."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textruns.operators.stats import timing_summary
from textruns.sources.texts import write_locate

from .index import TextIndex


def measure(index: TextIndex, patterns: DataFrame, strategies: list[str], mode: str = "macro", reps: int = 10, min_time: float = 0.0, report_stats: bool = False, out: str = "") -> DataFrame:
    """A row for each repetition: name ('strategy/rate'), seconds, patterns, occurrences, seconds a pattern and an occurrence, bits a symbol.

    ``macro``: each repetition locates all patterns, again until ``min_time`` seconds are over, and counts as their mean. ``micro``: a repetition for each
    pattern, whatever ``reps``. ``print``: one, whose occurrences go to ``out``/<strategy>. One run before is not timed. With
    ``report_stats`` the statistics of ``stats.timing_summary`` over the repetitions instead.
    """
    spark = index.data.sparkSession
    rate = (index.data.select("s").first() or [0])[0]
    given = [tuple(r) for r in patterns.select("pattern_id", "pattern").collect()] if mode == "micro" else [None]
    rows = []
    for name in strategies:
        bits = index.bits_per_symbol(name).agg(F.avg("bits")).first()[0]
        index.locate(patterns, name).count()
        for k in range(reps if mode == "macro" else 1):
            for one in given:
                asked = patterns if one is None else spark.createDataFrame([one], "pattern_id long, pattern binary")
                began, times = time.time(), 0
                while not times or time.time() - began < min_time:
                    found = index.locate(asked, name)
                    if mode == "print":
                        write_locate(found, patterns, f"{out}/{name}")
                    occurrences, times = found.count(), times + 1
                seconds, n = (time.time() - began) / times, asked.count()
                rows.append((f"{name}/{rate}", seconds, n, occurrences, seconds / max(n, 1), seconds / max(occurrences, 1), bits))
    times_ = spark.createDataFrame(rows, "name string, seconds double, patterns long, occurrences long, per_pattern double, per_occurrence double, bits double")
    return timing_summary(times_) if report_stats else times_
