"""Exact integer measurements of texts, shared by the quality rules and the quality classifier; each has an SQL form in ``SQL``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import WORD_BYTE, count_between, distinct_per_owner, mix, pieces, runs, span_hashes, words

#: Name and DuckDB expression over t (the text, '' for NULL), ws (its words, lower case), ls (its non-blank lines).
MEASURES: dict[str, str] = {
    "n_bytes": "strlen(t)",
    "n_words": "len(ws)",
    "word_bytes": "coalesce(list_sum(list_transform(ws, lambda x: strlen(x))), 0)",
    "longest_word": "coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0)",
    "n_distinct": "len(list_distinct(ws))",
    "n_repeats": "coalesce(list_sum(list_transform(range(2, len(ws) + 1), lambda i: CASE WHEN ws[i] = ws[i - 1] THEN 1 ELSE 0 END)), 0)",
    "n_pairs": "len(list_distinct(list_transform(range(2, len(ws) + 1), lambda i: ws[i - 1] || ' ' || ws[i])))",
    "n_upper": "length(regexp_replace(t, '[^A-Z]', '', 'g'))",
    "n_lower": "length(regexp_replace(t, '[^a-z]', '', 'g'))",
    "n_digits": "length(regexp_replace(t, '[^0-9]', '', 'g'))",
    "n_symbols": "length(regexp_replace(t, '[^#$%&*+/<=>@^_`{|}~\\[\\]\\\\]', '', 'g'))",
    "n_bangs": "length(regexp_replace(t, '[^!]', '', 'g'))",
    "n_bars": "length(regexp_replace(t, '[^|]', '', 'g'))",
    "n_lines": "len(ls)",
    "n_distinct_lines": "len(list_distinct(ls))",
}


def _flag(chars: str) -> np.ndarray:
    on = np.zeros(256, bool)
    on[[ord(c) for c in chars]] = True
    return on


_UPPER, _LOWER, _DIGIT = (_flag("".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in ("AZ", "az", "09"))
_SYMBOL, _BANG, _BAR, _BREAK = _flag("#$%&*+/<=>@^_`{|}~[]\\"), _flag("!"), _flag("|"), _flag("\n")
_BLANK = _flag(" \t\r\n\v\f")


def measure(texts: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    """All measurements, int64, one value a text. A NULL text measures as an empty one."""
    out = {k: np.zeros(len(texts), np.int64) for k in MEASURES}
    for p in pieces(texts):
        n, at = p.hi - p.lo, slice(p.lo, p.hi)
        w = words(p)
        owner, counts = w.owner(), np.diff(w.at)
        size = w.ends - w.starts
        out["n_bytes"][at] = np.diff(p.offsets)
        out["n_words"][at] = counts
        sums = np.concatenate([[0], np.cumsum(size)])
        out["word_bytes"][at] = np.diff(sums[w.at])
        some = np.flatnonzero(counts)
        if len(some):
            out["longest_word"][p.lo + some] = np.maximum.reduceat(size, w.at[some])
        out["n_distinct"][at] = np.bincount(distinct_per_owner(owner, w.hashes, n)[0], minlength=n)
        if len(owner) > 1:
            inner = owner[1:] == owner[:-1]
            out["n_repeats"][at] = np.bincount(owner[1:][inner & (w.hashes[1:] == w.hashes[:-1])], minlength=n)
            pair = mix(w.hashes[:-1] * np.uint64(3)) + w.hashes[1:]
            out["n_pairs"][at] = np.bincount(distinct_per_owner(owner[1:][inner], pair[inner], n)[0], minlength=n)
        for name, flag in (("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_symbols", _SYMBOL), ("n_bangs", _BANG), ("n_bars", _BAR)):
            out[name][at] = count_between(flag[p.data], p.offsets)
        starts, ends = runs(~_BREAK[p.data], p.offsets)
        solid = np.concatenate([[0], np.cumsum(~_BLANK[p.data])])
        full = solid[ends] > solid[starts]
        starts, ends = starts[full], ends[full]
        line_at = np.searchsorted(starts, p.offsets)
        out["n_lines"][at] = np.diff(line_at)
        line_owner = np.repeat(np.arange(n), np.diff(line_at))
        out["n_distinct_lines"][at] = np.bincount(distinct_per_owner(line_owner, span_hashes(p.data, starts, ends), n)[0], minlength=n)
    return out
