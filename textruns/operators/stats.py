"""Statistics of indexes and results: counters, per-pattern and per-set summaries, sweeps over the sub-sampling rate, mark densities, sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deal import joined


def occurrence_stats(counts: DataFrame) -> DataFrame:
    """Over all (text, pattern) counts: patterns, total, min, max, mean."""
    return counts.agg(F.count_distinct("pattern_id").alias("patterns"), F.coalesce(F.sum("occ"), F.lit(0)).cast("long").alias("total"), F.min("occ").alias("least"), F.max("occ").alias("most"), F.avg("occ").alias("mean"))


def per_pattern(counts: DataFrame) -> DataFrame:
    """pattern_id, texts, total, least, most: one line a pattern."""
    return counts.groupBy("pattern_id").agg(F.count("*").alias("texts"), F.sum("occ").cast("long").alias("total"), F.min("occ").alias("least"), F.max("occ").alias("most"))


def mark_density(marks: DataFrame, width: int) -> DataFrame:
    """text_id, bin, n, share: a histogram of mark positions in bins of ``width``."""
    counted = marks.select("text_id", F.floor(F.col("mark") / width).cast("long").alias("bin")).groupBy("text_id", "bin").agg(F.count("*").alias("n"))
    total = counted.groupBy("text_id").agg(F.sum("n").alias("all"))
    return joined(counted, total, "text_id").select("text_id", "bin", "n", (F.col("n") / F.col("all")).alias("share"))


def mark_quartiles(marks: DataFrame) -> DataFrame:
    """text_id, n, least, q1, median, q3, most of mark positions; quartiles between two marks are interpolated."""
    q = lambda p: F.percentile("mark", F.lit(p))
    return marks.groupBy("text_id").agg(F.count("*").alias("n"), F.min("mark").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("mark").alias("most"))


def mark_kde(marks: DataFrame, lengths: DataFrame, points: int, bandwidth: float = 0.05) -> DataFrame:
    """text_id, x, density: a Gaussian kernel estimate of the marks' density over the text, both as shares of its length, at ``points`` + 1 places.

    Marks are counted by position first, so a text's marks meet the places once for each distinct position.
    """
    counted = joined(marks.groupBy("text_id", "mark").agg(F.count("*").alias("w")), lengths.select("text_id", "n"), "text_id")
    at = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("x", F.col("k") / points)
    z = (F.col("x") - F.col("mark") / F.col("n")) / bandwidth
    weight = F.col("w") * F.exp(-z * z / 2)
    return at.groupBy("text_id", "x").agg((F.sum(weight) / F.sum("w") / (bandwidth * (2 * math.pi) ** 0.5)).alias("density"))


def repetitiveness(counters: DataFrame) -> DataFrame:
    """counters (text_id, n, r) with n/r, the most repetitive first."""
    return counters.withColumn("ratio", F.col("n") / F.col("r")).orderBy(F.desc("ratio"), "text_id")


def timing_summary(timings: DataFrame) -> DataFrame:
    """name, repetitions, least, most, total, mean, median, deviation of rows (name, seconds)."""
    s = F.col("seconds")
    return timings.groupBy("name").agg(F.count("*").alias("repetitions"), F.min(s).alias("least"), F.max(s).alias("most"), F.sum(s).alias("total"), F.avg(s).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.stddev_samp(s).alias("deviation"))


def query_plot(results: DataFrame, labels: DataFrame) -> DataFrame:
    """label, ms, bits from benchmark rows (name 'strategy/rate/...', seconds, bits), joined to labels (name, label)."""
    named = results.withColumn("name", F.split("name", "/")[0])
    return named.join(labels, "name").select("label", (F.col("seconds") * 1000).alias("ms"), "bits")
