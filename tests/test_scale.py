"""What keeps tasks and the driver small as tables grow: no broadcast by a guess of a size, partitions in proportion to the input."""

import pytest

from textruns.operators import deal
from textruns.plans.queries import QUERIES, SQL

from .conftest import SF


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["break_range", "select_run", "split_in_runs", "split_in_whole_runs"])
def test_relations_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["closest_run_break", "forward_runs", "traverse"])
def test_partitions_grow_with_the_input(spark, duck, same, monkeypatch, name):
    monkeypatch.setattr(deal, "PART_BYTES", 1 << 10)
    df = QUERIES[name](spark, SF)
    assert deal.partitions(df) > 10 and "REPARTITION_BY_NUM" in plan(df)
    same(df.toArrow().to_pylist(), duck.sql(SQL[name]).to_arrow_table().to_pylist())


def test_f_array_shuffles_no_row_for_each_byte(spark):
    df = QUERIES["f_array"](spark, SF)
    assert "Join" not in plan(df) and df.count() % 257 == 0


def test_strategies_share_searches_and_sum_as_they_locate(spark, monkeypatch):
    from textruns.functions.kernels import STRATEGIES
    from textruns.operators import search
    from textruns.plans.index import TextIndex, index_batch

    bodies, asked, searches, whole = [b"banana", b"", b"nanana ban", b"xyz"], [b"an", b"na", b"q"], [], search.search
    monkeypatch.setattr(search, "search", lambda *x: searches.append(x) or whole(*x))
    rows = search.Rows(index_batch([1, 2, 3, 4], bodies, 2, True, True))
    found = {k: sorted(zip(*(x.tolist() for x in part), strict=True)) for k, how in STRATEGIES.items() for part in search._resolved(rows, how, asked)}
    assert len(searches) <= 3 and len(found) == len(STRATEGIES) and len({str(x) for x in found.values()}) == 1
    texts = spark.createDataFrame([(1, b"banana"), (None, b"nanana ban"), (None, b"an"), (7, None)], "text_id long, body binary")
    patterns = spark.createDataFrame([(0, b"an"), (1, b"na"), (2, b"")], "pattern_id long, pattern binary")
    index = TextIndex.build(texts, 2)
    want = index.locate_by_each(patterns).groupBy("strategy", "text_id", "pattern_id").agg({"*": "count", "pos": "sum"})
    got = index.sums_by_each(patterns).groupBy("strategy", "text_id", "pattern_id").sum("occ", "positions")
    order = lambda df: sorted(str((r["strategy"], r["text_id"], r["pattern_id"], *list(r)[3:])) for r in df.collect())
    named = want.select("strategy", "text_id", "pattern_id", "count(1)", "sum(pos)")
    assert order(got) == order(named) and got.count() == 4 * len(STRATEGIES)


@pytest.mark.parametrize("name", ["count_patterns_docs", "locate_docs"])
def test_an_unsaved_index_is_searched_in_the_task_that_builds_it(spark, name):
    assert plan(QUERIES[name](spark, SF)).split("== Initial Plan ==")[0].count("MapInArrow") == 1
