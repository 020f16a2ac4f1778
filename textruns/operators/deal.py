"""Shuffles of relations whose tasks stay small, and joins that no guess of a size makes a broadcast.

A text becomes far more rows than its file tells: a broadcast by Spark's guess, which goes by the files, fills the driver's memory. Partitions of a
fixed number, or merged by their compressed size, fill a task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files behind a relation for each of its partitions, and partitions at most.
PART_BYTES = 1 << 17
MOST_PARTS = 4096
#: From here on a size is Spark's word for an unknown one.
UNKNOWN = 1 << 50


def partitions(*relations: DataFrame) -> int:
    """How many partitions rows of these relations take, by the bytes of the files that they are made of: in proportion to the input."""
    total = 0
    for df in relations:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        total += sum(x for x in sizes if x < UNKNOWN)
    return min(total // PART_BYTES + 1, MOST_PARTS)


def dealt(df: DataFrame, *by: str, parts: int = 0) -> DataFrame:
    """``df`` partitioned by some columns, for the windows, groups and joins by these (or more) that follow; a small one as it is, for Spark to partition."""
    parts = parts or partitions(df)
    return df.repartition(parts, *by) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting both sides, never a broadcast."""
    by = [on] if isinstance(on, str) else on
    parts = partitions(left, right)
    return dealt(left, *by, parts=parts).join(dealt(right, *by, parts=parts).hint("merge"), by, how)
