"""Byte BPE, the language model, packing."""

import base64
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textruns.llm import _text, bpe, lm, packing
from textruns.llm._text import pieces, word_hash, words


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.load(), bpe.PATTERN)


ODD_TEXTS = ["", " ", "   ", " a", "a   b\n\n  c ", "it's  don't\t x 　 y", "a" * 5000, " " * 300 + "x", "é" * 300, "ab" * 400 + " q", "日本語 テキスト​ ok", "\x1c \x1c a", "a \x85b", "<|endoftext|>", "x  y", "👩‍👩‍👧 ok"]


def test_bpe_like_the_library(codec, reference, more):
    texts = ODD_TEXTS + more.text[:150].tolist()
    got = [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode([np.array(x, np.int32) for x in got]) == texts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sé#1"), st.characters(codec="utf-8")), max_size=40))
def test_bpe_random(codec, reference, text):
    got = np.frombuffer(codec.encode([text])[0], np.int32)
    assert got.tolist() == reference.encode_ordinary(text) and codec.decode([got]) == [text]


def test_bpe_long_words_take_the_same_steps(codec):
    rng = np.random.default_rng(0)
    for n in (3, 40, 120):
        word = bytes(rng.choice(list(b"theraion"), n).astype(np.uint8))
        short = codec.encode_words([word])[0].tolist()
        try:
            bpe.LONG, keep = 0, bpe.LONG
            assert codec.encode_words([word])[0].tolist() == short
        finally:
            bpe.LONG = keep


@settings(max_examples=40, deadline=None)
@given(st.integers(129, 700), st.sampled_from(["theraion", "ab", "aab", "日本語東京の", " ", "=-", "0123456789"]), st.integers(0, 1 << 30))
def test_bpe_random_long_words(codec, reference, n, letters, seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(list(letters), n)) + rng.choice(["", " x"])
    assert np.frombuffer(codec.encode([text])[0], np.int32).tolist() == reference.encode_ordinary(text)


def test_bpe_cases(odd, none):
    got = {r["doc_id"]: r for r in bpe.encode(odd, check=True).collect()}
    assert got[2]["ids"] is None and got[3]["ids"] == [] and all(r["round_trip"] in (True, None) for r in got.values())
    assert bpe.encode(none).count() == 0
    coded = bpe.encode(odd)
    back = sorted(((r["doc_id"] or 0, r["text"] or "") for r in bpe.decode(coded).collect()))
    assert back == sorted(((r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(coded.selectExpr("doc_id", "array(99999999) AS ids")).collect()


def test_bpe_decodes_broken_utf8(codec):
    half = int(np.flatnonzero([t == b"\xc3" for t in bpe.load()[0]])[0])
    assert codec.decode([bpe.load()[1][[half]]]) == ["�"]


def brute_log_probs(model, text):
    """Each token's log-probability: an explicit softmax over the units, a known word's share, a rare word's spelling letter by letter."""
    at = {int(h): (int(i), float(x)) for h, i, x in zip(model.words, model.ids, model.share, strict=True)}
    out, c1, c2 = [], lm.START, lm.START
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
        h = int(words(next(pieces(pa.array([word.decode()])))).hashes[0])
        t, inner = at.get(h, (lm.UNKNOWN, None))
        if inner is None:
            symbols = [lm.EDGE, lm.EDGE, *word, lm.EDGE]
            inner = sum(model.spelling.log_probs(np.array([(p * 257 + q) * 257 + c]))[0] for p, q, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
        s = (model.context[c1] @ model.first + model.context[c2] @ model.second) @ model.target.T + model.bias
        s[lm.START] = -np.inf
        out.append(s[t] - s.max() - math.log(np.exp(s - s.max()).sum()) + inner)
        c1, c2 = c2, t
    return out


def test_lm_against_softmax(spark, docs):
    model = lm.train(docs)
    got = {r["doc_id"]: r for r in lm.score(docs, model, per_token=True).collect()}
    for r in docs.limit(6).collect():
        want = brute_log_probs(model, r["text"])
        assert np.allclose(got[r["doc_id"]]["token_log_probs"], want, atol=2e-3)
        assert math.isclose(got[r["doc_id"]]["log_prob"], sum(want), abs_tol=1e-2 * len(want))


def plain_step(p, g2, logn, noise, t, c2, c1, w, rate):
    """A step of noise-contrastive estimation, token by token as it is defined, in double precision."""
    r, m1, m2, q, b = p
    grads = [np.zeros_like(x) for x in p]
    for ti, i2, i1, wi in zip(t, c2, c1, w / w.sum(), strict=True):
        h = r[i1] @ m1 + r[i2] @ m2
        for u, data in [(ti, True), *((x, False) for x in noise)]:
            is_data = 1 / (1 + np.exp(logn[u] - h @ q[u] - b[u]))
            e = wi * (data - is_data)
            grads[0][i1] += e * m1 @ q[u]
            grads[0][i2] += e * m2 @ q[u]
            grads[1] += e * np.outer(r[i1], q[u])
            grads[2] += e * np.outer(r[i2], q[u])
            grads[3][u] += e * h
            grads[4][u] += e
    for x, g, a in zip(p, grads, g2, strict=True):
        a += (100 * g) ** 2
        x += rate * 100 * g / np.sqrt(a)


def some_trainer(units, dim, k, seed=3):
    rng = np.random.default_rng(0)
    none = np.zeros(0, np.int64)
    model, noise = lm.initial(none.view(np.uint64), none.astype(np.int16), none.astype(np.float32), rng.integers(1, 500, units), lm.Spelling(none, none.astype(float)), dim)
    return lm.Trainer(model, noise, seed, k=k), rng


def test_lm_step_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 7)
    trainer, rng = some_trainer(30, 4, 9)
    m = trainer.m
    p = [np.array(x, float) for x in (m.context, m.first, m.second, m.target, m.bias)]
    g2, draws = [np.full(x.shape, 1e-2) for x in p], np.random.default_rng(3)
    for _ in range(4):
        t, c2, c1, w = *(rng.integers(0, 30, 25) for _ in range(3)), rng.random(25).astype(np.float32)
        trainer.step(t, c2, c1, w)
        plain_step(p, g2, trainer.logn.astype(float), np.searchsorted(trainer.cum, draws.random(9)), t, c2, c1, w.astype(float), trainer.rate)
    assert np.allclose(trainer.flat(), np.concatenate([x.ravel() for x in p]), atol=1e-4)


def test_lm_step_makes_no_table_of_all_tokens_and_noise_words():
    trainer, rng = some_trainer(1280, 16, 128)
    t, c2, c1 = (rng.integers(0, 1280, 4096) for _ in range(3))
    w = np.ones(4096, np.float32)
    trainer.step(t, c2, c1, w)
    tracemalloc.start()
    try:
        trainer.step(t, c2, c1, w)
        assert tracemalloc.get_traced_memory()[1] < 2 * 4096 * 128 * 4
    finally:
        tracemalloc.stop()


def test_lm_looks_each_word_of_a_piece_up_once(spark, monkeypatch):
    rng = np.random.default_rng(0)
    own = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    near = own[:50] ^ np.uint64(1)  # alike in all but the bits that give way to places
    keys = rng.permutation(np.repeat(np.concatenate([own[::7], near, rng.integers(0, 1 << 64, 99, dtype=np.uint64)]), 20))
    asked, plain = [], _text.lookup
    monkeypatch.setattr(_text, "lookup", lambda table, k: (asked.append(k), plain(table, k))[1])
    for k in (keys, keys[:1], keys[:0]):
        assert np.array_equal(_text.lookup_hashes(own, k), plain(own, k)) and np.array_equal(_text.lookup_hashes(own[:0], k), plain(own[:0], k))
    apart = asked[0][~np.isin(asked[0], np.concatenate([near, own[:50]]))]
    assert len(apart) == len(np.unique(apart)) and (np.diff(apart.astype(float)) >= 0).all()
    words_ = [f"w{i % 40}" for i in range(900)]
    counted = lm.word_counts(spark.createDataFrame([(1, " ".join(words_)), (2, "w3 w3"), (3, None)], "doc_id long, text string")).collect()
    assert {r["word"]: r["n"] for r in counted} == {int(np.uint64(word_hash(x)).view(np.int64)): words_.count(x) + 2 * (x == "w3") for x in set(words_)}


def test_lm_beats_unigrams_on_held_out_rows(spark, more):
    train, test = (spark.createDataFrame(x[["doc_id", "text"]]) for x in (more[:2000], more[3000:3300][~more[3000:3300].text.isin(set(more[:2000].text))]))
    total = lambda m: lm.score(test, m).selectExpr("sum(log_prob) / sum(n_tokens)").first()[0]
    # the untrained model has the unigram biases: over 20 % of its perplexity go
    assert total(lm.train(train)) > total(lm.train(train, rounds=0)) + 0.25


def test_lm_does_not_depend_on_partitions(spark, docs):
    one, many = (lm.train(docs.repartition(k), chunk=20_000) for k in (1, 7))
    assert np.array_equal(one.flat(), many.flat()) and np.array_equal(one.words, many.words) and np.array_equal(one.share, many.share)
    assert np.array_equal(one.spelling.codes, many.spelling.codes) and np.array_equal(one.spelling.n, many.spelling.n)


def test_lm_averages_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 4)
    rng = np.random.default_rng(0)
    x, n = rng.random((23, 5)), rng.integers(1, 9, 23)
    rows = spark.createDataFrame([(i, int(n[i]), bytearray(x[i].tobytes())) for i in range(23)], "chunk long, n long, x binary")
    assert np.allclose(lm.averaged(rows, "vectors"), np.average(x, axis=0, weights=n))


def test_lm_cases(odd, none):
    model = lm.train(odd)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(odd, model).collect()}
    assert got[2, 0]["log_prob"] == 0 and got[2, 0]["perplexity"] is None and got[5, 0]["mean_log_prob"] is None
    assert got[4, 60_000]["perplexity"] > 0 and (None, 10) in got
    empty = lm.train(none)
    assert lm.score(none, empty).count() == 0
    assert all(r["n_unknown"] == r["n_tokens"] and (r["log_prob"] < 0) == (r["n_tokens"] > 0) for r in lm.score(odd, empty).collect())


def test_lm_vocabulary_follows_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(0)
    types = [f"w{chr(97 + i % 26)}{i}{chr(97 + i // 26 % 26)}" for i in range(3000)]
    stream = rng.permutation([t for i, t in enumerate(types) for _ in range(2 + 20 * (i < 1022) + 9 * (i % 2))]).tolist()
    rows = [(i, " ".join(stream[a : a + 100] + [f"once{i}"])) for i, a in enumerate(range(0, len(stream), 100))]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(corpus)
    assert len(model.words) == len(types)
    new = spark.createDataFrame([(1, types[2001]), (2, types[2000]), (3, "once7"), (4, "zqxjkvzq")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(new, model, per_token=True).collect()}
    assert [got[i]["n_unknown"] for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    counts = {r["word"]: r["n"] for r in lm.word_counts(corpus).collect()}
    known = model.words.view(np.int64)
    for k in (2001, 2000):  # shares within a class are shares of its tokens
        unit = model.ids[known == np.int64(np.uint64(word_hash(types[k])).view(np.int64))][0]
        members = model.ids == unit
        n = np.array([counts[int(h)] for h in known[members]])
        assert np.allclose(np.exp(model.share[members]), n / n.sum(), atol=1e-6)
    assert got[3]["log_prob"] > got[4]["log_prob"] + 5  # an unknown word is charged for its form
    for context in (256 * 257 + 256, 256 * 257 + ord("o"), ord("o") * 257 + ord("n"), 3):
        assert math.isclose(np.exp(model.spelling.log_probs(context * 257 + np.arange(257))).sum(), 1)
    monkeypatch.setattr(lm, "MOST_KNOWN", 2000)
    fewer = lm.train(corpus, rounds=0)
    assert 1000 < len(fewer.words) <= 2000 and math.isclose(np.exp(fewer.tables()[1][5] + fewer.tables()[0][5] - fewer.tables()[2][5, 5]).sum(), 1, abs_tol=1e-4)


def brute_two_fit(sizes, capacity):
    """The greedy rule on a plain list."""
    left = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = []
    while left:
        gap, items = capacity, []
        while True:
            fit = next((i for i in left if sizes[i] <= gap), None)
            if fit is None or not gap:
                break
            left.remove(fit)
            items.append(fit)
            gap -= sizes[fit]
        if gap:
            out = items[-1]
            room, best = gap + sizes[out], None
            for a in left:
                for b in left:
                    if a != b and sizes[a] >= sizes[b] and sizes[a] + sizes[b] <= room and sizes[a] + sizes[b] > sizes[out]:
                        key = (-(sizes[a] + sizes[b]), -sizes[a], left.index(a), left.index(b))
                        best = min(best, (key, a, b)) if best else (key, a, b)
            if best:
                _, a, b = best
                left.remove(a)
                left.remove(b)
                items[-1:] = [a, b]
                left.append(out)
                # it goes before others of its size, as it was the first of them
                left.sort(key=lambda i: (-sizes[i], i))
        bins.append(items)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=25))
def test_packing_like_brute_force(sizes):
    assert packing.best_two_fit(np.array(sizes, int), 20) == brute_two_fit(sizes, 20)


def test_packing_whole(docs, odd, none):
    for table in (docs, odd):
        bins = packing.pack(table, 100, 50).collect()
        want = {}
        for r in packing.lengths(table).collect():
            want.setdefault(r["doc_id"], []).append(r["n_tokens"])
        got = {}
        for b in bins:
            assert sum(b["lengths"]) == b["used"] <= b["capacity"] == 100
            for d, s, n in zip(b["doc_ids"], b["starts"], b["lengths"], strict=True):
                got.setdefault(d, []).append((s, n))
        assert {k: sum(n for _, n in v) for k, v in got.items()} == {k: sum(v) for k, v in want.items() if sum(v)}
    assert packing.pack(none).count() == 0
    bins = packing.pack(docs).toPandas()
    assert bins.used.sum() / (len(bins) * packing.CAPACITY) > 0.9


def test_packing_keeps_ids_next_to_nulls(spark):
    big = 1152921504606846977
    rows = [(None, "a b"), (big, "c d e"), (None, "a b"), (big + 2, "f")]
    bins = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(((d or 0, n) for b in bins for d, n in zip(b["doc_ids"], b["lengths"], strict=True))) == [(0, 2), (0, 2), (big, 3), (big + 2, 1)]


def test_packing_shards_are_bounded(spark):
    rows = [(7 if i % 3 else None, "w " * (i % 9)) for i in range(400)]
    bins = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 20, 25).toPandas()
    held = bins.groupby("shard").doc_ids.apply(lambda x: sum(map(len, x)))
    assert held.max() <= 50 and held.sum() == sum(i % 9 > 0 for i in range(400)) and not bins.duplicated(["shard", "bin"]).any()
