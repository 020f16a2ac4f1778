"""Binary number files: pairs of 5-byte little-endian integers (row, suffix-array value), and plain 8-byte little-endian columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textruns.functions.cluster import map_batches


def _numbers(data: bytes, width: int) -> np.ndarray:
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes are no whole number of {width}-byte integers")
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<i8").ravel()


def read_pairs(spark: SparkSession, path: str, n: int) -> DataFrame:
    """path, run, row, text_pos of the run ends in a file of pairs; ``n`` is the length of the text with its sentinel."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                pairs = _numbers(content, 5).reshape(-1, 2)
                at = np.arange(len(pairs))
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(pairs)), pa.array(at), pa.array(pairs[:, 0]), pa.array((pairs[:, 1] - 1) % n)], ["path", "run", "row", "text_pos"])

    return map_batches(files, run, "path string, run long, row long, text_pos long")


def read_u64(spark: SparkSession, path: str) -> DataFrame:
    """path, i, value of every number in files of 8-byte integers."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = _numbers(content, 8)
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(x)), pa.array(np.arange(len(x))), pa.array(x)], ["path", "i", "value"])

    return map_batches(files, run, "path string, i long, value long")


def as_u64(column: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, content: a key's values in order, as 8-byte little-endian integers."""
    one = F.hex(F.col(value).cast("long"))
    swapped = F.concat(*(F.substring(F.lpad(one, 16, "0"), 15 - 2 * k, 2) for k in range(8)))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), swapped.alias("h"))))
    return column.groupBy(key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("content"))
