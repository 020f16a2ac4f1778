"""Helpers for jobs: the shared scratch folder, materialised tables, Arrow maps, bounded samples of labelled rows."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textruns.functions.cluster import file_system, shared_dir, ship


def materialize(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The files of ``spent``, tables that this function returned and nothing reads any more, go at once; all others when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textruns-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    for old in spent:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._textruns_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned; any other table is left alone."""
    if path := getattr(table, "_textruns_path", None):
        fs, where = file_system(table.sparkSession, path)
        fs.delete(where, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Bytes and rows of a batch between the JVM and Python: texts are large, and both sides hold whole batches.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def release() -> None:
    """Give freed memory back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with small batches, and memory given back at the end of each task."""
    spark = df.sparkSession
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(key).rstrip("bB"))
        except (PySparkException, ValueError):  # not known to this version, or in another unit
            continue
        if not 0 < now <= most:
            spark.conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; with ``spread``, one of fewer files than cores is dealt out over all of them (a file may be a single row group)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and len(df.inputFiles()) < cores else df


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], bound: int) -> DataFrame:
    """``bound`` labelled documents at most, those whose doc_id has the smallest hash, each doc_id once. NULL ids, texts and labels are left out.

    Of several labels of a doc_id the largest counts, of several texts the smallest, so the sample is the same in every run. The labels are
    counted first; only about 1.5 times ``bound`` of them, by their hash, are sorted.
    """
    known = labels.select("doc_id", *columns).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    n, place = known.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = known.where(place < int((1 << 30) * min(1.0, 1.5 * bound / max(n, 1)))).orderBy(place, "doc_id").limit(bound)
    return docs.select("doc_id", "text").dropna().join(F.broadcast(rows), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("doc_id", "text", *columns)


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """The model that ``fit`` makes of all rows, in one task on an executor: the texts of a sample never reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        frame = pa.Table.from_batches(held).to_pandas() if held else pd.DataFrame(columns=rows_columns)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(frame))], pa.binary())], ["model"])

    rows_columns = rows.columns
    found = arrow_map(rows.repartition(1), run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pd.DataFrame(columns=rows_columns))
