"""Quality rules (operator 10): a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the measurements and, in one number, a bit for each rule failed. A policy is a named
version with a mask of rules: a document is kept by it if it fails none of them. Policies are applied to the stored bits alone, and an
ablation counts, for each policy and rule, the documents that only this rule rejects (failed & mask = the rule's bit): what dropping the rule would let in.
``judge`` decides and ablates in one pass over the bits, so no text is measured again; ``ablate`` gives the same as a table, from any ledger.

Rules compare integers by cross-multiplication, so every engine decides alike. A rule about shares of words holds from ``SHARES_FROM`` words on:
shorter documents are left to the others. No rule has an upper bound. Distinct words grow as the square root of a text's length, so
``few_distinct_words`` asks for a tenth of the words up to 1,000 of them and for the square root of 10 times their number beyond, which meet there.

Defined cases: a NULL text measures as an empty one and fails ``no_words``; NULL ids pass through; repeated rows have a row each; extra
columns are ignored; an empty table gives an empty ledger, and an ablation with counts of zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ._job import arrow_map
from .measures import MEASURES, measure
from .search import WORDS_SQL

SHARES_FROM = 20

#: Rules in the order of their bits; true: failed. The expressions are both Spark's and DuckDB's.
RULES: dict[str, str] = {
    "no_words": "n_words = 0",
    "too_many_symbols": "10 * n_symbols > n_bytes",
    "shouting": f"n_words >= {SHARES_FROM} AND 2 * n_upper > n_upper + n_lower",
    "exclamations": f"n_words >= {SHARES_FROM} AND 3 * n_bangs > n_words",
    "list_bars": f"n_words >= {SHARES_FROM} AND 2 * n_bars > n_words",
    "words_too_long": "n_words > 0 AND word_bytes > 25 * n_words",
    "longest_word": "longest_word > 400",
    "repeated_words": f"n_words >= {SHARES_FROM} AND 3 * n_repeats > n_words",
    "few_distinct_words": f"n_words >= {SHARES_FROM} AND 10 * n_distinct < n_words AND n_distinct * n_distinct < 10 * n_words",
    "repeated_pairs": f"n_words >= {SHARES_FROM} AND 4 * n_pairs < n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_distinct_lines < 4 * n_lines",
    "digits": f"n_words >= {SHARES_FROM} AND 2 * n_digits > n_bytes",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: names of their rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("no_words", "too_many_symbols", "shouting", "words_too_long"),
    "v2": tuple(RULES),
    "v3": tuple(r for r in RULES if r not in ("longest_word", "digits")),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement, failed (the rules' bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = measure(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in found.values())], ["doc_id", *found])

    measured = arrow_map(docs.select("doc_id", "text"), run, ", ".join(["doc_id long", *(f"{k} long" for k in MEASURES)]))
    bits = reduce(Column.bitwiseOR, (F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()))
    return measured.withColumn("failed", bits)


def decide(kept: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A ledger with keep_<policy> for each policy."""
    return kept.withColumns({f"keep_{p}": F.col("failed").bitwiseAND(F.lit(sum(BIT[r] for r in rules)).cast("long")) == 0 for p, rules in policies.items()})


def judge(kept: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``decide``, with the ablation counted by whatever job first reads the result whole; ``ablation`` has it then."""
    masks = {p: sum(BIT[r] for r in rules) for p, rules in policies.items()}
    hit = lambda m: F.col("failed").bitwiseAND(F.lit(m).cast("long"))
    rejected = [F.count_if(hit(m) != 0).alias(p) for p, m in masks.items()]
    only = [F.count_if(hit(masks[p]) == BIT[r]).alias(f"{p}/{r}") for p, rules in policies.items() for r in rules]
    counts = Observation()
    judged = decide(kept.observe(counts, *rejected, *only), policies)
    judged._textruns_ablation = counts, policies
    return judged


def ablation(judged: DataFrame) -> list[tuple[str, str, int, int]]:
    """policy, rule, rejected, only, as in ``ablate``, of a table that ``judge`` returned; it waits until a job has read that."""
    counts, policies = judged._textruns_ablation
    return [(p, r, counts.get[p], counts.get[f"{p}/{r}"]) for p, rules in policies.items() for r in rules]


def ablate(kept: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """policy, rule, rejected (documents that the policy rejects), only (those that this rule alone rejects): one pass over the bits."""
    by_bits = kept.groupBy("failed").agg(F.count("*").alias("n"))
    named = [(p, r, sum(BIT[x] for x in rules), BIT[r]) for p, rules in policies.items() for r in rules]
    table = kept.sparkSession.createDataFrame(named, "policy string, rule string, mask long, bit long")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    joined = F.broadcast(table).join(by_bits, F.lit(True), "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return joined.groupBy("policy", "rule").agg(total(hit != 0).alias("rejected"), total(hit == F.col("bit")).alias("only"))


_SQL_LEDGER = f"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, {WORDS_SQL.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\x0b\\f]')) AS ls FROM raw),
measured AS (SELECT doc_id, {", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in MEASURES.items())} FROM parts),
ledger AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())} AS BIGINT) AS failed FROM measured)
"""
SQL = _SQL_LEDGER + f"SELECT *, {', '.join(f'(failed & {mask(p)}) = 0 AS keep_{p}' for p in POLICIES)} FROM ledger"
ABLATION_SQL = _SQL_LEDGER + f"""
, named(policy, rule, mask, bit) AS (VALUES {", ".join(f"('{p}', '{r}', {mask(p)}, {BIT[r]})" for p, rules in POLICIES.items() for r in rules)})
SELECT policy, rule, CAST(count(*) FILTER ((failed & mask) <> 0) AS BIGINT) AS rejected, CAST(count(*) FILTER ((failed & mask) = bit) AS BIGINT) AS only
FROM named LEFT JOIN ledger ON true GROUP BY policy, rule
"""
