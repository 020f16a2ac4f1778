"""Command line: build, count, locate, bench, sweep over Parquet tables of texts."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import SparkSession

from textruns.functions.kernels import STRATEGIES
from textruns.operators.construct import ALGORITHMS
from textruns.plans.bench import measure
from textruns.plans.build import relations
from textruns.plans.index import TextIndex, sweep
from textruns.plans.store import Store
from textruns.sources import texts as src


@dataclass(frozen=True)
class Config:
    """What a build needs: the table, its columns, and where each item goes, by name."""

    data: str
    out: str
    id: str = "doc_id"
    text: str = "text"
    rate: int = 16
    algorithm: str = "kernel"

    def key(self, item: str, sampled: bool = False) -> str:
        """The folder of an item; of a sub-sampled one, at this rate."""
        return f"{self.out}/s={self.rate}/{item}" if sampled else f"{self.out}/{item}"


def rates(least: int, most: int) -> tuple[int, ...]:
    found = []
    while least << len(found) <= most:
        found.append(least << len(found))
    return tuple(found)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textruns")
    todo = parser.add_subparsers(dest="what", required=True)
    for what in ("build", "sweep", "relations"):
        p = todo.add_parser(what)
        p.add_argument("--data", required=True, help="Parquet table of texts")
        p.add_argument("--id", default="doc_id")
        p.add_argument("--text", default="text")
        p.add_argument("--out", required=True)
    for what in ("build", "relations"):
        todo.choices[what].add_argument("--rate", type=int, default=16, help="sub-sampling rate")
    todo.choices["relations"].add_argument("--strategy", choices=list(STRATEGIES), help="of all, if not given")
    todo.choices["relations"].add_argument("--algorithm", default="kernel", choices=ALGORITHMS)
    todo.choices["sweep"].add_argument("--min-rate", type=int, default=4)
    todo.choices["sweep"].add_argument("--max-rate", type=int, default=512)
    for what in ("count", "locate", "bench"):
        p = todo.add_parser(what)
        p.add_argument("--index", required=True)
        p.add_argument("--patterns", required=True, help="one a line")
        p.add_argument("--base64", action="store_true", help="patterns are coded so")
        p.add_argument("--out", required=True)
    todo.choices["locate"].add_argument("--strategy", default="tails", choices=list(STRATEGIES))
    p = todo.choices["bench"]
    p.add_argument("--strategy", action="append", choices=list(STRATEGIES), help="of all, if not given")
    p.add_argument("--mode", default="macro", choices=("macro", "micro", "print"), help="all patterns at once, one at a time, or once with what is found written")
    p.add_argument("--reps", type=int, default=10)
    p.add_argument("--min-time", type=float, default=0.0, help="seconds that a repetition lasts at least")
    p.add_argument("--report-stats", action="store_true", help="least, most, mean, median and deviation instead of each repetition")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("textruns").getOrCreate()
    if a.what in ("build", "relations"):
        config = Config(a.data, a.out, a.id, a.text, a.rate, getattr(a, "algorithm", "kernel"))
        texts = src.read_parquet(spark, config.data, config.id, config.text)
        if a.what == "build":
            TextIndex.build(texts, config.rate).save(config.out)
        else:
            store = Store(spark, config.out)
            relations(store, texts, config.rate, a.strategy, config.algorithm)
            if store.seconds:
                store.log().write.mode("append").csv(config.key("log"), header=True)
    elif a.what == "sweep":
        sweep(src.read_parquet(spark, a.data, a.id, a.text), rates(a.min_rate, a.max_rate)).write.mode("overwrite").parquet(a.out)
    else:
        index, patterns = TextIndex.load(spark, a.index), src.read_patterns(spark, a.patterns, a.base64)
        if a.what == "count":
            src.write_count(index.count(patterns), patterns, a.out, a.base64)
        elif a.what == "locate":
            src.write_locate(index.locate(patterns, a.strategy), patterns, a.out, a.base64)
        else:
            measure(index, patterns, a.strategy or list(STRATEGIES), a.mode, a.reps, a.min_time, a.report_stats, a.out).write.mode("overwrite").csv(f"{a.out}/times", header=True)


if __name__ == "__main__":
    main()
