"""The chains of relations behind each strategy, stage by stage in a ``Store``: what exists is reused, and only what a strategy needs is built."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textruns.functions.kernels import STRATEGIES, Strategy
from textruns.operators import construct as c
from textruns.operators.deal import joined
from textruns.sources.texts import with_distinct_ids

from .store import Store


def relations(store: Store, texts: DataFrame, s: int = 4, strategy: str | None = None, algorithm: str = "kernel") -> dict[str, DataFrame]:
    """Relations by name: of one strategy's chain, or of all. ``algorithm`` is that of the suffix array (``construct.ALGORITHMS``).

    Base items of all: suffix_array, runs, alphabet. Forward strategies add psi; each direction its links; sampled strategies at rate ``s``
    the kept samples, their places by row or symbol, and the kept marks; with their links by symbol for strategies in that order, and with
    validity (marks and areas) for those that trust marks. The suffix-array slice needs the first alone.
    """
    chains = list(STRATEGIES.values()) if strategy is None else [STRATEGIES[strategy]]
    built = "suffix_array" if algorithm == "kernel" else f"suffix_array_{algorithm}"
    out = {"suffix_array": store.once(built, lambda: _with_symbols(with_distinct_ids(texts), algorithm))}
    if all(x.slice for x in chains):
        return out
    bwt = c.bwt(out["suffix_array"])
    out["runs"] = store.once("runs", lambda: c.ordered_runs(c.bwt_runs(bwt)))
    out["alphabet"] = store.once("alphabet", lambda: c.alphabet(bwt))
    for x in chains:
        if not x.slice:
            _direction(store, texts, s, x, bwt, out)
    return out


def _with_symbols(texts: DataFrame, algorithm: str) -> DataFrame:
    """``construct.suffix_array``'s columns from any algorithm."""
    if algorithm == "kernel":
        return c.suffix_array(texts)
    syms = c.symbols(texts)
    n = syms.groupBy("text_id").count().withColumnRenamed("count", "n")
    placed = joined(c.suffix_array_by(texts, algorithm), n, "text_id").selectExpr("text_id", "n", "i", "sa", "(sa + n - 1) % n AS text_pos")
    return joined(placed, syms.withColumnRenamed("pos", "text_pos"), ["text_id", "text_pos"]).select("text_id", "n", "i", "sa", "text_pos", "sym")


def _direction(store: Store, texts: DataFrame, s: int, how: Strategy, bwt: DataFrame, out: dict[str, DataFrame]) -> None:
    side, runs = ("backward", out["runs"]) if how.backward else ("forward", out["runs"])
    if not how.backward:
        out["psi"] = store.once("psi", lambda: c.psi(bwt))
    links = out[f"links_{side}"] = store.once(f"links_{side}", lambda: c.links_backward(runs) if how.backward else c.links_forward(runs))
    if not how.sampled:
        return
    kept = out[f"samples_{side}"] = store.once(f"s={s}/samples_{side}", lambda: c.subsamples(texts, s, how.backward))
    places = out[f"places_{side}"] = store.once(f"s={s}/places_{side}", lambda: c.subsample_places(kept, runs))
    key, number = ("sample_run", "run") if how.backward else ("sample_prun", "prun")
    marks = out[f"marks_{side}"] = store.once(f"s={s}/marks_{side}", lambda: c.submarks(links, places.select("text_id", places[number].alias(key)), key))
    if how.psi_order:
        out[f"mark_links_{side}"] = store.once(f"s={s}/mark_links_{side}", lambda: c.submark_links(links, places, how.backward))
    if how.valid_mark:
        out[f"validity_{side}"] = store.once(f"s={s}/validity_{side}", lambda: c.validity(links, marks, how.backward))
