"""Quality, toxicity, language: held-out accuracy, brute-force posteriors, defined cases."""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from textruns.llm import langid, quality, toxicity
from textruns.llm._job import labelled_sample
from textruns.llm._text import span_hashes


def test_toxicity_held_out(more):
    train, test = more[:2400], more[2400:]
    model = toxicity.fit(train.text.tolist(), train.toxic.to_numpy())
    assert (np.diff(model.theta) > 0).all()
    severity, grade = model.severity(pa.array(test.text))
    hit, truth = severity >= model.cut, test.toxic.to_numpy() == 1
    # about one toxic document in ten of this table holds no word that tells it from a clean one of its language
    assert hit[truth].mean() > 0.88 and (~hit[~truth]).mean() > 0.985
    assert ((severity >= 0) & (severity <= toxicity.GRADES)).all() and grade.max() <= toxicity.GRADES
    assert np.corrcoef(grade, severity)[0, 1] > 0.9


def test_toxicity_probabilities_are_cumulative():
    m = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0, 1.0, 2.0]))
    p = m.above(np.array([0.5]))[0]
    assert (np.diff(p) < 0).all() and math.isclose(p[0], 1 / (1 + math.exp(-0.5)))


def test_toxicity_gradient_falls():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    rows = np.repeat(np.arange(400), 1)
    w, theta = toxicity.fit_ordinal(rows, grade, 400, 4, grade, 3, l1=1e-5, steps=500)
    assert (np.diff(w) > 0.3).all() and (np.diff(theta) > 0).all()


def test_toxicity_cases(spark, odd, none, labels, docs):
    blank = toxicity.fit([], np.zeros(0))
    assert toxicity.score(odd, blank).count() == odd.count() == toxicity.filter_toxic(odd, blank).count()
    assert toxicity.filter_toxic(odd, blank).columns == odd.columns
    model = toxicity.train(docs, labels)
    assert toxicity.score(none, model).count() == 0 and toxicity.train(none, labels).keys.size == 0
    got = toxicity.score(odd, model).toPandas()
    assert len(got) == odd.count() and not got[got.doc_id == 2].rejected.any() and got[got.doc_id == 1].severity.nunique() == 1
    bad = spark.createDataFrame([(1, "you stupid pathetic idiot, worthless scum", 7), (2, "the house by the lake", 8)], "doc_id long, text string, grade int")
    strong = toxicity.fit(["nice words here now"] * 3 + ["the house stands there"] * 2 + ["a lake and a boat"] + ["you idiot scum", "what an idiot", "idiot you are", "such scum"], np.array([0] * 6 + [1] * 4))
    assert len(strong.theta) == toxicity.GRADES
    assert toxicity.filter_toxic(bad, strong).columns == ["doc_id", "text", "grade"]


def test_language_held_out(more):
    train, test = more[:900], more[1200:2400]
    model = langid.fit(train.text.tolist(), train.lang.tolist())
    best, confidence, rejected = model.predict(pa.array(test.text))
    right = np.array([model.languages[i] for i in best]) == test.lang.to_numpy()
    assert right.mean() > 0.97 and rejected.mean() < 0.01
    # calibrated: mean confidence is close to accuracy
    assert abs(confidence.mean() - right.mean()) < 0.05
    strange = pa.array(["", None, "12 34 567", "?!", "Это русский текст о погоде и природе", "中文文本在这里写着", "zzqx wqkj xvvz qqzx kkjw"])
    assert model.predict(strange)[2].all()


def test_language_subwords_by_hand():
    text = "ab é".encode()
    buckets, counts = langid.subwords(np.frombuffer(text, np.uint8), np.array([0, len(text), len(text)]))
    # " ab" "ab " around two letters, one 4-gram " ab "; é is two bytes likewise
    assert counts.tolist() == [len(buckets), 0]
    one, c1 = langid.subwords(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))
    two, c2 = langid.subwords(np.frombuffer(b"xy abc", np.uint8), np.array([0, 2, 6]))
    assert sorted(one.tolist()) == sorted(two[c2[0] :].tolist())


def test_language_cases(spark, odd, none, docs):
    model = langid.train(docs)
    got = langid.identify(odd, model).toPandas()
    assert len(got) == odd.count()
    assert got[got.doc_id.isin([2, 3, 5])].rejected.all() and got[got.doc_id.isin([2, 3, 5])].predicted.isna().all()
    assert got[got.doc_id == 1].predicted.tolist() == ["en", "en"]
    kept = langid.filter_language(odd, model)
    assert kept.columns == odd.columns and {2, 3, 5}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(none)
    assert nothing.languages == [] and langid.filter_language(odd, nothing).count() == 0


def test_quality_held_out(more):
    train, test = more[:2400], more[2400:]
    p = quality.fit(train.text.tolist(), train.quality.to_numpy()).log_odds(pa.array(test.text))
    good = test.quality.to_numpy() == 1
    assert (p[good] > 0).mean() > 0.995 and (p[~good] < 0).mean() > 0.95


def brute_quality(rows: pd.DataFrame) -> list[float]:
    """Posterior of each row (host, path, log_odds, p), group by group."""
    n, y = len(rows), rows.p.sum()
    mean = min(max(y / n, 1e-4), 1 - 1e-4)
    paths, hosts = rows.groupby("path").p, rows.groupby("host").p
    variance = max(sum(((g - g.mean()) ** 2).sum() for _, g in paths) / n, 1e-9)
    mh = quality.strength(len(hosts), n, sum(len(g) ** 2 for _, g in hosts), sum(len(g) * (g.mean() - mean) ** 2 for _, g in hosts), variance)
    of = rows.groupby("path").host.first()
    hm = hosts.mean()
    mp = quality.strength(len(paths) - len(hosts) + 1, n, sum(len(g) ** 2 for _, g in paths), sum(len(g) * (g.mean() - hm[of[k]]) ** 2 for k, g in paths), variance)
    out = []
    for r in rows.itertuples():
        h, q = hosts.get_group(r.host), paths.get_group(r.path)
        host = min(max((h.sum() - r.p + mh * mean) / (len(h) - 1 + mh), 1e-6), 1 - 1e-6)
        path = min(max((q.sum() - r.p + mp * host) / (len(q) - 1 + mp), 1e-6), 1 - 1e-6)
        out.append(1 / (1 + math.exp(-(r.log_odds + math.log(path / (1 - path)) - math.log(mean / (1 - mean))))))
    return out


def test_quality_posteriors(spark):
    rng = np.random.default_rng(0)
    host = rng.integers(0, 6, 300)
    z = rng.normal(0, 1, 300) + host - 2
    rows = pd.DataFrame({"doc_id": np.arange(300), "host": [f"h{h}" for h in host], "path": [f"h{h}/{k}" for h, k in zip(host, rng.integers(0, 3, 300), strict=True)], "log_odds": z, "p": 1 / (1 + np.exp(-z))})
    got = quality.combine(spark.createDataFrame(rows)).toPandas().sort_values("doc_id")
    assert np.allclose(got.quality, brute_quality(rows), atol=1e-9)
    # a site with few documents lies nearer to the global mean than its own rate does
    assert got.host_posterior.between(0, 1).all()


def test_quality_cases(odd, none, docs, labels):
    model = quality.train(docs, labels)
    got = quality.classify(odd, model).toPandas()
    assert len(got) == odd.count() and got.quality.between(0, 1).all() and got.host.notna().all()
    assert quality.classify(none, model).count() == 0
    flat = quality.fit([], np.zeros(0))
    assert quality.classify(odd, flat).toPandas().keep.all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_training_ignores_nulls(spark, docs, labels, module):
    nulls = [(None, 1, 1), (0, None, None), (99_999_999, 0, 1)]
    known = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    schema = "doc_id long, quality int, toxic int"
    plain, more_ = (module.train(docs, spark.createDataFrame(x, schema)) for x in (known, nulls + known + known))
    text = pa.array([r["text"] for r in docs.limit(50).collect()])
    of = (lambda m: m.severity(text)[0]) if module is toxicity else (lambda m: m.log_odds(text))
    assert np.array_equal(of(plain), of(more_)) and np.ptp(of(plain)) > 0


def test_sample_is_bounded_and_the_same_every_time(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = [sorted(map(tuple, labelled_sample(d, labels, ["toxic"], 30).collect())) for d in (docs, docs.repartition(5).orderBy("text"))]
    assert got[0] == got[1] and 10 < len(got[0]) <= 30 and all(t == min(f"text {i}", f"text {i + 40}") and y == i % 2 for i, t, y in got[0])


def parts_of(text):
    """Words of a text, in plain Python."""
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def test_toxicity_like_brute_force(docs, labels):
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    assert len(weight) > 3
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        stems = {w for x in parts_of(r["text"]) for w in [x, *(x[:k] for k in toxicity.STEMS if len(x) > k)]}
        z = sum(weight.get(h, 0.0) for h in {int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in stems})
        above = [1 / (1 + math.exp(t - z)) for t in model.theta]
        each = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert math.isclose(got[r["doc_id"]]["severity"], sum(above), abs_tol=1e-9)
        assert got[r["doc_id"]]["grade"] == each.index(max(each)) and got[r["doc_id"]]["rejected"] == (sum(above) >= model.cut)


def test_language_like_brute_force(docs):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    m = 1 << 32

    def buckets(text):
        for x in re.findall(rb"[a-z\x80-\xff]{2,}", text.lower().encode()):
            x = b"\0" + x + b"\0"
            for i in range(len(x) - 2):
                a, b, c = x[i : i + 3]
                h = ((a * 2654435761 % m) ^ (b * 2246822519 % m) ^ (c * 3266489917 % m)) * 668265263 % m
                yield h >> 17
                if i < len(x) - 3:
                    yield (((h ^ (x[i + 3] * 374761393 % m)) * 2654435761 % m) ^ 0x5BD1E995) >> 17

    for r in docs.limit(60).collect():
        found = list(buckets(r["text"]))
        z = (model.table[found].mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        rejected = p.max() < model.least_confidence or model.seen[found].mean() < model.least_seen
        assert got[r["doc_id"]]["predicted"] == model.languages[int(p.argmax())] and got[r["doc_id"]]["rejected"] == rejected
        assert math.isclose(got[r["doc_id"]]["confidence"], p.max(), abs_tol=1e-9)
