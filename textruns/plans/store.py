"""A folder of named relations, written once and read afterwards: stages of a build that exist are not built again."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


@dataclass
class Store:
    spark: SparkSession
    path: str
    memo: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)  # of every relation written here
    bytes: dict[str, int] = field(default_factory=dict)  # that it takes on disk

    def _path(self, name: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self, path: Any) -> Any:
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, key: str) -> bool:
        at = self._path(f"{key}/_SUCCESS")
        return key in self.memo or self._fs(at).exists(at)

    def log(self) -> DataFrame:
        """relation, seconds, bytes of every stage built here."""
        return self.spark.createDataFrame([(k, v, self.bytes[k]) for k, v in self.seconds.items()], "relation string, seconds double, bytes long")

    def get(self, key: str) -> DataFrame:
        if key not in self.memo:
            try:
                self.memo[key] = self.spark.read.parquet(f"{self.path}/{key}")
            except AnalysisException as e:
                raise KeyError(f"no relation {key!r} in {self.path}") from e
        return self.memo[key]

    def put(self, key: str, df: DataFrame) -> DataFrame:
        """Write under ``key`` unless it is there already: the first one stays."""
        if not self.has(key):
            began = time.time()
            df.write.mode("overwrite").parquet(f"{self.path}/{key}")
            self.seconds[key] = time.time() - began
            self.bytes[key] = self._fs(at := self._path(key)).getContentSummary(at).getLength()
        return self.get(key)

    def once(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.get(key) if self.has(key) else self.put(key, make())
