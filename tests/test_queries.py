"""Every registered query of the engine against its SQL, and the contract's entry."""

import pytest

from textruns.plans.queries import QUERIES, SQL

from .conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, same, name):
    got = QUERIES[name](spark, SF).toArrow().to_pylist()
    same(got, duck.sql(SQL[name]).to_arrow_table().to_pylist())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("side", ["backward", "forward"])
def test_subsampling_of_whole_items(spark, side):
    whole = {r["item_id"]: len(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    last = {}
    for r in QUERIES[f"subsamples_{side}"](spark, SF).collect():
        last[r["text_id"]] = max(last.get(r["text_id"], 0), r["tpos"])
    assert set(last) == set(whole) and all(last[k] > n - 60 and last[k] > 60 for k, n in whole.items())
    marks = QUERIES[f"submarks_{side}"](spark, SF).collect()
    assert max(r["mark"] for r in marks) > 60
    assert QUERIES[f"validity_{side}"](spark, SF).count() == len({(r["text_id"], r["mark"]) for r in marks})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
