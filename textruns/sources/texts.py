"""Readers of texts and patterns, writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def texts_of(df: DataFrame, text_id: str, text: str) -> DataFrame:
    """texts (text_id, body) from a string column, as UTF-8; NULL texts are left out. Ids of an integer type are kept, of any other hashed; a NULL id stays NULL."""
    kind = df.schema[text_id].dataType
    key = F.col(text_id).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(text_id).isNotNull(), F.xxhash64(F.col(text_id)))
    return df.select(key.alias("text_id"), F.encode(F.col(text), "UTF-8").alias("body")).where("body IS NOT NULL")


def with_distinct_ids(texts: DataFrame) -> DataFrame:
    """``texts``, after a check that no text_id is NULL or repeated: relations, whose rows name their text by it, would mix such texts up."""
    bad = texts.groupBy("text_id").count().where("text_id IS NULL OR count > 1").first()
    if bad is not None:
        raise ValueError(f"text_id {bad['text_id']} is NULL or stands {bad['count']} times")
    return texts


def read_parquet(spark: SparkSession, path: str, text_id: str, text: str) -> DataFrame:
    return texts_of(spark.read.parquet(path), text_id, text)


def spread(texts: DataFrame) -> DataFrame:
    """Texts of few files for the cores, dealt out over all of them: an index costs far more than moving its text once."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(4 * cores) if len(texts.inputFiles()) < 2 * cores else texts


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """texts, one for each file: text_id is a hash of the path, which is kept."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("text_id"), F.col("content").alias("body"), "path")


def without_nul(texts: DataFrame, by: bytes | None = None) -> DataFrame:
    """Texts whose inner NUL bytes are replaced by one other byte, or, with none given, only the texts without any."""
    # each byte is a character of this encoding and back
    bytes_ = F.decode("body", "ISO-8859-1")
    if by is None:
        return texts.where(~F.contains(bytes_, F.lit("\0")))
    return texts.withColumn("body", F.encode(F.replace(bytes_, F.lit("\0"), F.lit(by.decode("latin-1"))), "ISO-8859-1"))


def collection(texts: DataFrame, separator: int = 1) -> tuple[DataFrame, DataFrame]:
    """One text of all texts, each followed by a separator byte, and offsets (text_id, start) of each: for small collections, which one task must hold."""
    whole = texts.orderBy("text_id").groupBy().agg(F.array_sort(F.collect_list(F.struct("text_id", "body"))).alias("parts"))
    sep = F.unhex(F.lit(f"{separator:02X}"))
    one = whole.select(F.lit(0).cast("long").alias("text_id"), F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(F.concat(p["body"], sep))), "")).alias("body"))
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p["body"]) + 1)))
    offsets = whole.select(F.explode(F.arrays_zip(F.transform("parts", lambda p: p["text_id"]).alias("text_id"), F.slice(ends, 1, F.size("parts")).alias("start"))).alias("x"))
    return one, offsets.select(F.col("x.text_id").alias("text_id"), F.col("x.start").alias("start"))


def read_patterns(spark: SparkSession, path: str, base64: bool = False) -> DataFrame:
    """patterns (pattern_id, encoded, pattern): one a line, blank lines skipped, decoded from base64 if so coded."""
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    return decode_patterns(lines.select(F.monotonically_increasing_id().alias("pattern_id"), F.col("value").alias("encoded")), base64)


def decode_patterns(encoded: DataFrame, base64: bool = False) -> DataFrame:
    """patterns from rows (pattern_id, encoded)."""
    return encoded.withColumn("pattern", F.unbase64("encoded") if base64 else F.encode("encoded", "UTF-8"))


def encode_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("encoded", F.base64("pattern"))


def _shown(encoded: bool) -> Column:
    """A pattern as text, or in base64 where it is asked for (patterns that are no UTF-8, or hold spaces or line breaks, need it)."""
    return F.base64("pattern") if encoded else F.decode("pattern", "UTF-8")


def write_locate(found: DataFrame, patterns: DataFrame, path: str, encoded: bool = False) -> None:
    """Text lines: pattern, text_id, then its sorted positions, one line a text and pattern; sorted within files, not over them."""
    lists = found.groupBy("text_id", "pattern_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    line = F.concat_ws(" ", _shown(encoded), F.col("text_id"), F.array_join(F.transform("at", lambda x: x.cast("string")), " "))
    named = lists.join(patterns.select("pattern_id", "pattern"), "pattern_id")
    named.sortWithinPartitions("pattern_id", "text_id").select(line.alias("value")).write.mode("overwrite").text(path)


def write_count(counts: DataFrame, patterns: DataFrame, path: str, encoded: bool = False) -> None:
    """CSV with a header: pattern, text_id, count, range_start, range_end (of the suffix array); sorted within files, not over them."""
    named = counts.join(patterns.select("pattern_id", "pattern"), "pattern_id").sortWithinPartitions("pattern_id", "text_id")
    columns = [_shown(encoded).alias("pattern"), "text_id", F.col("occ").alias("count"), F.col("sa_start").alias("range_start"), F.col("sa_end").alias("range_end")]
    named.select(*columns).write.mode("overwrite").csv(path, header=True)
