"""The pipeline against the same decisions taken on plain lists, and its stages' contracts."""

import glob

import pyarrow as pa
import pytest

import corpus_pipeline
from textruns.llm import _job, langid, neardup, packing, toxicity

from ..conftest import SF
from .test_search import multiset, overlap, union_find
from .test_tokens import brute_two_fit


def test_stages(spark, odd, docs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        last = name == "packing"
        assert last or stage(spark, docs, SF).columns == docs.columns
        assert last or set(stage(spark, odd, SF).columns) == set(odd.columns)
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, odd, SF).count() >= 0


def test_checkpoint_folder_is_named_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, other: other)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _job.shared_dir(Cluster)


def test_spent_tables_are_deleted(spark):
    first = _job.materialize(spark.range(3).toDF("a"), "x")
    second = _job.materialize(first.where("a > 0"), "y", first)
    assert second.count() == 2 and not glob.glob(first._textruns_path.removeprefix("file://"))


def test_run_like_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, labels)
    severity, _ = model.severity(pa.array(list(rows.values())))
    kept = [d for d, s in zip(rows, severity, strict=True) if s < model.cut]
    frame = docs.where(docs.doc_id.isin(kept))
    known = langid.train(frame)
    rejected = known.predict(pa.array([rows[d] for d in kept]))[2]
    kept = [d for d, r in zip(kept, rejected, strict=True) if not r]
    bags = {d: multiset(rows[d]) for d in kept}
    pairs = [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if overlap(bags[a], bags[b]) >= neardup.THRESHOLD]
    root = union_find(pairs)
    kept = sorted(d for d in kept if root.get(d, d) == d)
    size = {d: sum(1 for _ in multiset(rows[d], 1).elements()) for d in kept}
    pieces = [(d, n % packing.CAPACITY) for d, n in size.items() if n % packing.CAPACITY]
    bins = brute_two_fit([n for _, n in pieces], packing.CAPACITY)
    want = sorted([[pieces[i][0] for i in b] for b in bins] + [[d] for d, n in size.items() for _ in range(n // packing.CAPACITY)])
    assert sorted(r["doc_ids"] for r in corpus_pipeline.run(spark, SF).collect()) == want
