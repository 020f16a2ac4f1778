"""What jobs need of a session: a folder that all executors share, and this package on them."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run in this process's machine (a local master)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found := "file://" + tempfile.mkdtemp(prefix="textruns-"))
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, by way of the shared folder; where they share the driver's path (a local session with it) nothing is sent."""
    sc = spark.sparkContext
    known = is_local(spark) and any(p and Path(p).resolve() == ROOT for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])
    if known or getattr(sc, "_textruns_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted((ROOT / "textruns").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    path = f"{shared_dir(spark)}/textruns-{uuid.uuid4().hex}.zip"
    fs, where = file_system(spark, path)
    out = fs.create(where)
    out.write(bytearray(data.getvalue()))
    out.close()
    fs.deleteOnExit(where)
    sc.addPyFile(path)
    sc._textruns_shipped = True


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
