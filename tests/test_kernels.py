"""Golden values of small texts, and random repetitive texts against plain search."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textruns.functions import forest
from textruns.functions.forest import Forest
from textruns.functions.kernels import STRATEGIES, Runs, Samples, greedy_sample, sorted_suffixes, suffix_arrays
from textruns.operators.search import Rows, access_of
from textruns.plans.index import index_batch

T1, T2, T3, T4 = b"abcabcababc", b"alabaralaalabarda", b"abracadabra", b"abcabcabcab"


def runs_of(*texts: bytes) -> Runs:
    return Runs.of(list(texts), *sorted_suffixes(list(texts)))


def forest_of(r: Runs) -> Forest:
    return Forest.of_bwt_order(np.diff(r.base), r.text, r.sym, r.start - r.base[r.text])


def naive(text: bytes, pattern: bytes) -> list[int]:
    return [i for i in range(len(text)) if text.startswith(pattern, i)] if pattern else []


def occurrences(texts: list[bytes], patterns: list[bytes], strategy: str, s: int) -> dict[tuple[int, int], list[int]]:
    """(text, pattern) to sorted positions, through an index row and what the strategy reads of it."""
    how, rows = STRATEGIES[strategy], Rows(index_batch(list(range(len(texts))), texts, s, True, True))
    f = rows.forest(how.psi_runs)
    found = forest.search(f, patterns, how.backward)
    out: dict[tuple[int, int], list[int]] = {}
    owner, pos = forest.locate(f, found, access_of(rows, f, how), how, s)
    for k, p in zip(owner.tolist(), pos.tolist(), strict=True):
        t = int(found.text[k])
        out.setdefault((t, int(found.pattern[k])), []).append(p - int(f.base[t]))
    return {k: sorted(v) for k, v in out.items()}


def wanted(texts: list[bytes], patterns: list[bytes]) -> dict[tuple[int, int], list[int]]:
    return {(t, p): at for t, x in enumerate(texts) for p, y in enumerate(patterns) if (at := naive(x, y))}


ENUMERATING = [k for k, v in STRATEGIES.items() if not v.slice]


@pytest.mark.parametrize(
    "text, sa",
    [(T1, [11, 6, 8, 3, 0, 7, 9, 4, 1, 10, 5, 2]), (T2, [17, 16, 8, 2, 11, 6, 0, 9, 4, 13, 3, 12, 15, 7, 1, 10, 5, 14]), (T3, [11, 10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2]), (T4, [11, 9, 6, 3, 0, 10, 7, 4, 1, 8, 5, 2]), (b"", [0])],
)
def test_suffix_array(text, sa):
    assert suffix_arrays([text])[0].tolist() == sa


def test_runs():
    r = runs_of(T1)
    assert "".join(chr(c) if c > 0 else "$" for c in r.sym) == "cbc$ab"
    assert r.start.tolist() == [0, 2, 3, 4, 5, 9]
    assert r.head_tpos.tolist() == [10, 7, 2, 11, 6, 9] and r.tail_tpos.tolist() == [5, 7, 2, 11, 0, 1]
    f = forest_of(r)
    assert f.psi(np.arange(12))[0].tolist() == [4, 5, 6, 7, 8, 2, 9, 10, 11, 0, 1, 3]
    assert f.lf(f.psi(np.arange(12))[0]).tolist() == list(range(12))
    t2 = runs_of(T2)
    assert t2.head_tpos[t2.by_symbol].tolist() == [17, 16, 8, 2, 6, 3, 15, 7, 5, 14]
    assert t2.tail_tpos[t2.by_symbol].tolist() == [17, 16, 8, 11, 13, 12, 15, 10, 5, 14]


@pytest.mark.parametrize(
    "s, values, order, required, kept",
    [
        (1, [5, 7, 2, 11, 0, 1], [4, 5, 2, 0, 1, 3], (), [4, 5, 2, 0, 1, 3]),
        (4, [5, 7, 2, 11, 0, 1], [4, 5, 2, 0, 1, 3], (), [4, 2, 0, 1, 3]),
        (6, [5, 7, 2, 11, 0, 1], [4, 5, 2, 0, 1, 3], (), [4, 0, 3]),
        (6, [5, 7, 2, 11, 0, 1], [4, 5, 2, 0, 1, 3], (1, 2), [4, 2, 1, 3]),
        (8, [5, 7, 2, 11, 0, 1], [4, 5, 2, 0, 1, 3], (), [4, 1, 3]),
        (4, [10, 7, 2, 11, 6, 9], [3, 0, 5, 1, 4, 2], (), [3, 1, 4, 2]),
        (8, [10, 7, 2, 11, 6, 9], [3, 0, 5, 1, 4, 2], (1, 4), [3, 1, 4, 2]),
    ],
)
def test_greedy_sample(s, values, order, required, kept):
    assert greedy_sample(np.array(values), np.array(order), s, required).tolist() == kept


def test_phi_chains():
    r = runs_of(T1)
    for backward, chain in ((True, [2, 5, 10, 1, 4, 9, 7, 0, 3, 8, 6, 11]), (False, [11, 6, 8, 3, 0, 7, 9, 4, 1, 10, 5, 2])):
        x = Samples.of(r, backward)
        got, _ = forest.Marks(x.mark, x.sample, np.where(x.valid, -1, x.area), x.first).phi(forest_of(r), np.zeros(11, np.int64), np.array(chain[:-1]), backward, False)
        assert got.tolist() == chain[1:]


@pytest.mark.parametrize("text, kept", [(T2, [17, 16, 8, 2, 5, 14]), (T1, [11, 6, 7, 2])])
def test_forward_subsamples(text, kept):
    r = runs_of(text)
    x = Samples.of(r, False, 4)
    assert r.head_tpos[r.by_symbol][x.kept[r.by_symbol]].tolist() == kept


@pytest.mark.parametrize("text, bits, areas", [(T2, [1, 1, 1, 0, 0, 1], [1, 1]), (T1, [1, 0, 1, 0], [1, 4])])
def test_forward_validity(text, bits, areas):
    x = Samples.of(runs_of(text), False, 4)
    assert x.valid.astype(int).tolist() == bits and x.area[~x.valid].tolist() == areas


@pytest.mark.parametrize("strategy", ENUMERATING)
@pytest.mark.parametrize("s", [1, 6])
def test_locate_golden(strategy, s):
    assert occurrences([T1], [b"ab", b"aba", b"bc", b"zz", b"", b"\xff"], strategy, s) == {(0, 0): [0, 3, 6, 8], (0, 1): [6], (0, 2): [1, 4, 9]}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=3), st.lists(st.integers(0, 2), min_size=1, max_size=8), st.sampled_from([1, 2, 4, 6, 8, 30]), st.data())
def test_all_strategies_on_repetitive_texts(words, picks, s, data):
    text = "".join(words[i % len(words)] for i in picks).encode()
    start = data.draw(st.integers(0, len(text) - 1))
    texts = [text, b"", text[start:], b"abcab", text[:start] * 3]
    patterns = [text[start : start + 1], text[start : start + 3], text, b"cc", text[:2] * 2]
    for strategy in ENUMERATING:
        assert occurrences(texts, patterns, strategy, s) == wanted(texts, patterns), strategy


def test_edge_texts():
    for text in (b"a", b"aaaa", "ñandú ñ".encode(), bytes(range(1, 256))):
        for strategy in ENUMERATING:
            assert occurrences([text], [text[:1], text], strategy, 4) == wanted([text], [text[:1], text])


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=1, max_size=40), st.sampled_from([1, 3, 5]), st.data())
def test_toehold_is_the_value_of_the_range_end(text, s, data):
    """The first value, found from the last run end that the search passed, is the suffix array's at the range's last or first row."""
    x = text.encode()
    a = data.draw(st.integers(0, len(x) - 1))
    patterns = [x[a : a + k] for k in (1, 2, 5)]
    sa = suffix_arrays([x])[0]
    for name in ("tails", "heads", "heads_psi", "tails_sampled", "heads_sampled", "heads_slim_sampled", "heads_psi_sampled"):
        how, rows = STRATEGIES[name], Rows(index_batch([0], [x], s, False, True))
        f = rows.forest(how.psi_runs)
        found = forest.search(f, patterns, how.backward)
        got = forest.first_values(f, found, access_of(rows, f, how), how.backward, s if how.sampled else 0)
        assert got.tolist() == sa[found.hi - 1 if how.backward else found.lo].tolist()


def test_no_walk_is_longer_than_the_rate(monkeypatch):
    """Navigation beyond ``s`` steps would be an error; at rate ``s`` no text needs it, and lookups of samples stop with the levels."""
    text = b"abcabcababc" * 30
    for s in (2, 5):
        for name in ENUMERATING:
            calls = []
            for move in ("split_forward", "lf"):
                plain = getattr(Forest, move)
                monkeypatch.setattr(Forest, move, lambda self, *a, plain=plain: calls.append(1) or plain(self, *a))
            assert occurrences([text], [b"cab"], name, s) == wanted([text], [b"cab"])
            assert len(calls) <= s
            monkeypatch.undo()


def test_strategies_read_their_own_columns():
    from textruns.operators.search import columns_of

    read = {name: frozenset(columns_of(how)) for name, how in STRATEGIES.items()}
    assert "run_start" not in read["heads_psi"] | read["heads_psi_sampled_areas"] and "p_start" not in read["heads_slim_sampled"] | read["heads"]
    assert len({read[k] for k in ("sa_slice", "tails", "tails_sampled", "heads_sampled", "heads_slim_sampled", "heads_psi", "heads_psi_sampled")}) == 7


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc", max_size=25), min_size=1, max_size=6), st.sampled_from([1, 2, 4, 7]))
def test_a_batch_is_its_texts(texts, s):
    """Runs, marks, samples and validity of texts built together are those of each alone."""
    bodies = [t.encode() for t in texts]
    for backward in (True, False):
        r = runs_of(*bodies)
        x = Samples.of(r, backward, s)
        for t, body in enumerate(bodies):
            r1 = runs_of(body)
            x1 = Samples.of(r1, backward, s)
            a, b, c, d = r.first[t], r.first[t + 1], x.first[t], x.first[t + 1]
            assert r.sym[a:b].tolist() == r1.sym.tolist() and (r.start[a:b] - r.base[t]).tolist() == r1.start.tolist() and x.kept[a:b].tolist() == x1.kept.tolist()
            assert [(x.mark[c:d] - r.base[t]).tolist(), (x.sample[c:d] - r.base[t]).tolist(), x.valid[c:d].tolist(), x.area[c:d].tolist()] == [x1.mark.tolist(), x1.sample.tolist(), x1.valid.tolist(), x1.area.tolist()]
