"""Top-k search, URL filters, near duplicates, rules."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textruns.llm import components, measures, neardup, queries, rules, search, urls
from textruns.llm._text import distinct_per_owner, pieces, word_hash, words

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SF).toArrow().to_pylist(), duck.sql(queries.SQL[name]).to_arrow_table().to_pylist())


def test_words():
    w = words(next(pieces(pa.array(["Ab c-ab", None, "", "AB"]))))
    assert w.at.tolist() == [0, 3, 3, 3, 4] and w.hashes[0] == w.hashes[2] == w.hashes[3] == word_hash("ab") != w.hashes[1]
    long = "é" * 700_000
    found = [words(p).hashes.tolist() for p in pieces(pa.array([long, "x", long + " y"]))]
    assert [len(h) for h in found] == [1, 1, 2] and found[0][0] == found[2][0] == word_hash(long) and found[1] == [word_hash("x")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=8), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 6), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(1, 4), st.booleans())
def test_maxscore_is_exact(docs, query, k, zero):
    impact = lambda t, n: 0 if zero and t < 3 else 7 * (t + 1) + n
    posts = sorted((t, d, impact(t, n)) for d, ws in enumerate(docs) for t, n in Counter(ws).items())
    term, owner, imp = (np.array([p[i] for p in posts], np.int64) for i in range(3))
    ptr = np.searchsorted(term, np.arange(8))
    bounds = np.array([max((p[2] for p in posts if p[0] == t), default=0) for t in range(7)])
    at, score = search.maxscore(query, ptr, owner, imp, bounds, np.arange(len(docs)), k)
    full = {d: sum(impact(t, Counter(ws)[t]) * n for t, n in query if t in ws) for d, ws in enumerate(docs)}
    met = {d for d, ws in enumerate(docs) if any(t in ws for t, _ in query)}
    want = sorted(((d, s) for d, s in full.items() if d in met), key=lambda x: (-x[1], x[0]))[:k]
    assert list(zip(at.tolist(), score.tolist(), strict=True)) == want


def test_search_cases(spark, odd, none, monkeypatch):
    asked = spark.createDataFrame([(1, "quick fox"), (1, "quick fox"), (2, None), (3, ""), (None, "one word"), (4, "nothing-here-zz")], "item_id long, text string")
    got = search.search(odd, asked, 3).collect()
    assert [r["doc_id"] for r in sorted((r for r in got if r["item_id"] == 1), key=lambda r: (r["rank"], r["doc_id"]))] == [1, 1, 1, 1, 8, 8]
    assert {r["item_id"] for r in got} == {1, None}
    monkeypatch.setattr(search, "BLOCK", 2)
    assert sorted(map(str, search.search(odd, asked, 3).collect())) == sorted(map(str, got))
    assert search.search(none, asked).count() == 0 and search.search(odd, asked.limit(0)).count() == 0


def test_a_word_of_every_document_is_a_result_of_impact_zero(spark):
    docs = spark.createDataFrame([(i, "common") for i in range(3000)], "doc_id long, text string")
    got = search.search(docs, spark.createDataFrame([(1, "common")], "item_id long, text string")).collect()
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in got) == [(i + 1, i, 0) for i in range(10)]


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(100, 140)]
    pairs = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)] + chain + [(7, 7), (200, 200), (3, 4), (4, 3)]
    got = components.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == union_find(pairs)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    link = lambda x: f'<head><link href="{x}" rel="canonical"></head>'
    pages = [
        (1, "http://casino-win.example.com/x", ""), (2, "https://clean.example.com/a?utm_source=q#f", link("http://casino-win.example.com/x")), (3, "http://m.clean.example.com/b/", '<META http-equiv="refresh" content="0; url=/a">'),
        (4, "http://casino-win.example.org/en/1", None), (5, "http://other.example.com/", link("http://casino-win.example.org/en/1")), (6, None, link("http://x.example.com")), (7, " ", ""), (8, "http://fine.example.com/p?page=2", link("p?page=2")),
        (9, "http://casino-win.example.org/en/9", link("http://spam-farm.example.com/")), (9, "http://casino-win.example.org/en/9", link("http://spam-farm.example.com/")), (10, "http://alias.example.com/z", ""),
    ]
    df = spark.createDataFrame([(*p, "pass") for p in pages], "page_id long, url string, html string, decision string")
    redirects = spark.createDataFrame([("http://alias.example.com/z", "http://hop.example.com/"), ("http://hop.example.com", "https://clean.example.com/b")], "src string, dst string")
    got = {r["page_id"]: r for r in urls.filter_urls(df, redirects).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "pass", 6: "pass", 7: "pass", 8: "pass", 9: "allow", 10: "block"}
    assert got[2]["name"] == "clean.example.com/a" and got[8]["name"] == "fine.example.com/p?page=2" and got[6]["name"] is None
    assert got[10]["class"] == got[1]["class"] and urls.filter_urls(df, redirects).count() == len(pages)
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_declarations_like_sql(spark, duck):
    import textruns.llm.urls as u

    html = [
        '<link rel="canonical" href="http://b.example.com/a?id=1&amp;p=2"><LINK href=\'/x;y=1 z\' REL=\'next Canonical\'>', "<meta content='0; url=\"http://c.example.com/q\"' http-equiv=Refresh>", '<link title="a > rel=canonical" href=/no rel=icon>',
        "<link rel=canonical href=//d.example.com/e/><linkrel=canonical href=/f>", '<meta http-equiv=" refresh " content="3, URL = g/h?a=1">', None, "<link>", '<link rel="canonical" href=""><link rel=canonical rel=icon href="&#39;&amp;lt;i" href="/second">', "<meta name=x content='5;url=/no'>",
    ]
    pages = [(i, f"http://a{i}.example.com/dir/p", h) for i, h in enumerate(html)] + [(50, None, html[0]), (51, "http://casino-win.example.com/q", html[1])]
    duck.register("odd_pages", pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": [p[2] for p in pages]}))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = lambda sql: sorted(map(str, duck.sql(sql.replace("FROM pages", "FROM odd_pages")).fetchall()))
    want = sorted(str(tuple(r)) for r in u.declarations(df).collect())
    assert len(want) == 7 and rows(f"WITH {u.DECLARED_SQL} SELECT url, target FROM declared WHERE target <> ''") == want
    assert rows(f"SELECT page_id, url, name, class, decision FROM ({u.SQL})") == sorted(str(tuple(r)) for r in u.filter_urls(df).collect())


def test_url_declarations_are_whole(spark):
    pages = [
        (1, "http://casino-win.example.com/a?id=1&p=2", ""), (2, "http://b.example.com/", '<link rel="canonical" href="http://casino-win.example.com/a?id=1&amp;p=2">'),
        (3, "http://spam-farm.example.com/x;jsessionid=5", None), (4, "http://d.example.com/", "<link rel=canonical href=http://d2.example.com/><LINK href='http://spam-farm.example.com/x;jsessionid=5' REL='canonical'>"),
        (5, "http://e.example.com/", """<meta http-equiv="refresh" content="0; url='http://spam-farm.example.com/x;jsessionid=5'">"""),
        (6, "http://f.example.com/", '<link rel="canonical" href="/q?id=1&amp;p=2">'), (7, "http://g.example.com/", '<link rel="canonical" href="http://f.example.com/q?id=1&amp;p=3">'),
        (8, "http://h.example.com/", '<link title="a > b" rel="canonical" href="http://f.example.com/a b">'),
    ]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "pass", 7: "pass", 8: "pass"}
    assert got[6]["class"] != got[7]["class"] and got[8]["class"] == "f.example.com/a b"


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14), st.sampled_from(["link", "meta", "redirect"])), max_size=14))
def test_url_classes_like_brute_force(spark, links):
    site = lambda i: f"http://{'casino-win.' if i in (3, 11) else ''}s{i}.example.com/p"
    tag = {"link": '<link rel="canonical" href="{}">', "meta": "<meta http-equiv=refresh content='0;url={}'>"}
    html = {i: "".join(tag[k].format(site(b)) for a, b, k in links if a == i and k != "redirect") for i in range(15)}
    pages = spark.createDataFrame([(i, site(i), html[i]) for i in range(15)], "page_id long, url string, html string")
    moved = spark.createDataFrame([(site(a), site(b)) for a, b, k in links if k == "redirect"], "src string, dst string")
    root = union_find([(a, b) for a, b, _ in links])
    bad = {root.get(i, i) for i in (3, 11)}
    got = {r["page_id"]: r for r in urls.filter_urls(pages, moved).collect()}
    assert {i: r["decision"] for i, r in got.items()} == {i: "block" if root.get(i, i) in bad else "pass" for i in range(15)}
    assert all((got[i]["class"] == got[j]["class"]) == (root.get(i, i) == root.get(j, j)) for i in range(15) for j in range(i))


def multiset(text, k=neardup.SHINGLE):
    w = words(next(pieces(pa.array([text])))).hashes.tolist()
    return Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else Counter()


def overlap(a, b):
    same = sum((a & b).values())
    return same / max(sum(a.values()) + sum(b.values()) - same, 1)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    a = {i: int(rng.integers(1, 9)) for i in range(300)}
    b = {i: a[i] if 60 < i < 300 else int(rng.integers(1, 9)) for i in range(30, 330)}
    keys = neardup.mix(np.array([*a, *b], np.uint64))
    s = neardup.signatures(np.repeat([0, 1], [len(a), len(b)]), keys, np.array([*a.values(), *b.values()]), 3, 4096)
    assert abs((s[0] == s[1]).mean() - overlap(Counter(a), Counter(b))) < 0.03 and np.isinf(s[2]).all() and np.isfinite(s[:2]).all()


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "x", "a b c d e f g " * 40, "one two"]
    def sign(ts):
        p = next(pieces(pa.array(ts)))
        return neardup.signatures(*distinct_per_owner(*neardup.shingles(words(p)), len(ts)), len(ts))
    together = sign(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(sign([t])[0], together[i])


def test_groups_like_brute_force(spark, docs):
    texts = {r["doc_id"]: multiset(r["text"]) for r in docs.collect()}
    ids = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if overlap(texts[a], texts[b]) >= neardup.THRESHOLD]
    want = defaultdict(set)
    for x, r in union_find(pairs).items():
        want[r].add(x)
    got = {r["group_id"]: set(r["doc_ids"]) for r in neardup.groups(docs).collect()}
    within = lambda g: {(a, b) for m in g.values() for a in m for b in m if a < b}
    assert within(got) <= within(want) and len(within(got)) >= 0.9 * len(within(want)) > 0


def test_a_large_group_of_varied_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for j in rng.integers(0, 120, 3):
            t[j] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(f"q{rng.integers(10_000)}" for _ in range(80))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["group_id"], r["size"]) for r in neardup.groups(df).collect()] == [(0, 150)]
    assert sorted(r["doc_id"] for r in neardup.deduplicate(df).collect()) == [0, *range(1000, 1050)]


def family(n, own):
    """Documents that share 60 words and have 40 others each: their overlap is 0.42 at most."""
    rng = np.random.default_rng(n)
    head = " ".join(f"w{i}" for i in range(60))
    return [(i, head + " " + " ".join(f"z{rng.integers(own)}" for _ in range(40))) for i in range(n)]


def test_a_template_is_no_pair_of_all(spark):
    counts = []
    for n in (100, 200):
        seen = []
        df = spark.createDataFrame(family(n, 1 << 40), "doc_id long, text string")
        assert neardup.edges(df, verified=seen).count() == 0
        counts.append(sum(seen))
        assert seen[-1] == 0 and sum(seen) <= n * neardup.BANDS
    assert counts[1] < 2.6 * counts[0]


def test_prefix_pairs_hold_every_overlap(spark):
    rng = np.random.default_rng(3)
    sets = {}
    for i in range(120):
        base = sets[int(rng.integers(i))] if i > 5 and rng.random() < 0.6 else set()
        base = {x for x in base if rng.random() < 0.8}
        sets[i] = base | set(rng.integers(0, 400, int(rng.integers(1, 40))).tolist())
    part = {i: int(rng.integers(0, 90)) for i in sets}
    df = spark.createDataFrame([(i, part[i], sorted(x)) for i, x in sets.items()], "doc_id long, c long, items array<long>")
    got = {(r["a"], r["b"]) for r in neardup.prefix_pairs(df, 0.5).collect()}
    want = {(a, b) for a in sets for b in sets if part[a] != part[b] and (len(sets[b]), b) < (len(sets[a]), a) and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert want and want <= got and len(got) < 0.5 * 120 * 119 / 2


def test_near_duplicates_among_templates(spark):
    rows = family(60, 50)
    rows += [(1000 + i, t.replace("z1 ", "y1 ").replace("w5 ", "y2 ")) for i, t in rows[:20]] + [(2000, " ".join(f"w{i}" for i in range(60)))]
    texts = {i: multiset(t) for i, t in rows}
    pairs = [(a, b) for a in texts for b in texts if a < b and overlap(texts[a], texts[b]) >= neardup.THRESHOLD]
    want = defaultdict(set)
    for x, r in union_find(pairs).items():
        want[r].add(x)
    got = {r["group_id"]: set(r["doc_ids"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_names_and_repeats_of_near_duplicates(spark):
    rows = [(1, "b c d e f g", "x", 1, 2), (1, "a c d e f g", "y", 1, 2), (1, "a c d e f g", "x", 1, 2), (2, "q r s t", None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string, _textruns_at int, nth int")
    got = neardup.deduplicate(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "a c d e f g", "x", 1, 2), (2, "q r s t", None, None, 5)]


def test_near_duplicate_cases(odd, none):
    assert [(r["group_id"], r["doc_ids"]) for r in neardup.groups(odd).collect()] == [(1, [1, 8])]
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: x or 0) == [None, 1, 2, 3, 4, 5, 6, 7, 9]
    assert neardup.groups(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_ledger_and_ablation(odd, none, docs):
    got = rules.decide(rules.ledger(odd)).toPandas()
    assert len(got) == odd.count() and not got[got.doc_id == 2].keep_v1.any() and got[got.doc_id == 1].keep_v2.all()
    assert rules.ledger(none).count() == 0 and set(rules.ablate(rules.ledger(none)).toPandas().only) == {0}
    bits = rules.ledger(docs).toPandas().failed.to_numpy()
    for r in rules.ablate(rules.ledger(docs)).collect():
        mask, bit = rules.mask(r["policy"]), rules.BIT[r["rule"]]
        assert r["rejected"] == ((bits & mask) != 0).sum() and r["only"] == ((bits & mask) == bit).sum()


def test_the_rules_query_ablates_in_the_same_pass(spark, odd, none, docs, tmp_path):
    judged = queries.op10_quality_rules(spark, "/root/testdata/sf0.001")
    judged.write.parquet(f"{tmp_path}/judged")
    want = {tuple(r) for r in queries.quality_rules_ablation(spark, "/root/testdata/sf0.001").collect()}
    assert set(rules.ablation(judged)) == want and any(only for *_, only in want)
    for kept in map(rules.ledger, (odd, none)):
        judged = rules.judge(kept)
        assert sorted(map(str, judged.collect())) == sorted(map(str, rules.decide(kept).collect()))
        assert set(rules.ablation(judged)) == {tuple(r) for r in rules.ablate(kept).collect()}


def test_repetition_fails_at_every_length(spark):
    rows = [(n, "a b " * n) for n in (400, 500, 600, 30_000)] + [(7, " ".join(f"w{i % 1500}" for i in range(20_000)))]
    got = {r["doc_id"]: r for r in rules.decide(rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    bits = rules.BIT["few_distinct_words"] | rules.BIT["repeated_pairs"]
    assert all(got[n]["failed"] & bits == bits and not got[n]["keep_v2"] and not got[n]["keep_v3"] for n in (400, 500, 600, 30_000))
    assert got[7]["failed"] & rules.BIT["few_distinct_words"] == 0


def test_measures_of_odd_texts(duck):
    texts = ["", " ", "a\n\n b \na", "A!A!A!", "x|y|z", "é É e", "\n", "one one one two", "a\r\nb\r\na", "1234 #$%", "t\tq\x0b"]
    got = measures.measure(pa.array(texts))
    duck.register("odd_texts", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    want = duck.sql(rules.SQL.replace("FROM documents", "FROM odd_texts")).df().sort_values("doc_id")
    for name in measures.MEASURES:
        assert got[name].tolist() == want[name].tolist(), name
