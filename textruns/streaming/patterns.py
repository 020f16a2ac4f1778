"""A stream of patterns against a standing index, or of texts against standing patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textruns.operators import search
from textruns.plans.index import TextIndex


def locate_stream(index: TextIndex, patterns: DataFrame, sink: Callable[[DataFrame, int], None], strategy: str = "tails", checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch of ``patterns`` (pattern_id, pattern) is located over the whole index; ``sink`` gets its results and number."""
    writer = patterns.writeStream.foreachBatch(lambda batch, number: sink(index.locate(batch, strategy), number))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def count_in_stream(texts: DataFrame, patterns: list[tuple[int, bytes]]) -> DataFrame:
    """texts (text_id, body), streaming or not, to (text_id, pattern_id, occ): stateless, for a bounded list of patterns."""
    fixed = texts.sparkSession.createDataFrame(patterns, "pattern_id long, pattern binary")
    return search.scan_count(texts, fixed)
