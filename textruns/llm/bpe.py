"""Byte-level BPE (operator 2): encoding and decoding by DuckDB queries inside each partition.

``encode``: a text is cut into words by the tokenizer's pattern. Rows (word, position, token, next position, next token) join the merge
table; a recursive query contracts each word's leftmost pair of minimum rank until none is left, and an ordered aggregation lists the
word's tokens. A word is encoded once for each worker that meets it, kept in a bounded cache. Words longer than ``LONG`` bytes take the same steps
one statement at a time, where the pair of minimum rank is contracted at all its places at once (from the left, without overlap: the
order that the one-by-one rule takes, as a merged token's own merges have higher ranks), so they need neither as many steps nor their history.

``decode``: rows (document, position, token) join the vocabulary; an ordered aggregation concatenates the bytes. Bytes that are no UTF-8
become U+FFFD, as usual for byte-level tokenizers.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter; it is read once by the driver and broadcast (fixed size).

Defined cases: a NULL text has NULL ids, an empty one no ids; NULL ids decode to NULL, a token that is not in the vocabulary fails;
special tokens' strings are ordinary text; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._job import arrow_map

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The widely published pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache; when full it starts anew, which costs time only.
CACHE = 600_000
LONG = 128
WORDS_AT_ONCE = 40_000
#: Characters of text handled at once, a longer text alone.
TEXT_AT_ONCE = 4_000_000

ENCODE = """
WITH RECURSIVE step(word, pos, tok, npos, ntok, live) AS (
  SELECT word, pos, tok, npos, ntok, true FROM letters
  UNION ALL
  (WITH cand AS (
     SELECT s.word, min((m.new::BIGINT << 32) | s.pos) AS k, arg_min(s.npos, (m.new::BIGINT << 32) | s.pos) AS q
     FROM step s JOIN merges m ON s.tok = m.l AND s.ntok = m.r WHERE s.live GROUP BY s.word),
   best AS (
     SELECT c.word, (c.k & 4294967295)::INT AS p, c.q, (c.k >> 32)::INT AS new, n.npos AS qnext, n.ntok AS qtok
     FROM cand c JOIN step n ON n.word = c.word AND n.pos = c.q)
   SELECT s.word, s.pos, CASE WHEN s.pos = b.p THEN b.new ELSE s.tok END, CASE WHEN s.pos = b.p THEN b.qnext ELSE s.npos END,
          CASE WHEN s.pos = b.p THEN b.qtok WHEN s.npos = b.p THEN b.new ELSE s.ntok END, b.word IS NOT NULL
   FROM step s LEFT JOIN best b ON s.word = b.word WHERE s.live AND (b.q IS NULL OR s.pos <> b.q)))
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word ORDER BY word
"""

STEP = """
CREATE OR REPLACE TEMP TABLE next_long AS
WITH pairs AS (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS ntok, row_number() OVER (PARTITION BY word ORDER BY pos) AS n FROM long_words),
     ranked AS (SELECT p.*, m.new, min(m.new) OVER (PARTITION BY p.word) AS best FROM pairs p LEFT JOIN merges m ON p.tok = m.l AND p.ntok = m.r),
     hits AS (SELECT *, coalesce(new = best, false) AS hit, max(CASE WHEN new IS DISTINCT FROM best OR best IS NULL THEN n ELSE 0 END) OVER (PARTITION BY word ORDER BY pos) AS miss FROM ranked),
     taken AS (SELECT *, hit AND (n - miss) % 2 = 1 AS take FROM hits),
     gone AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM taken)
SELECT word, pos, CASE WHEN take THEN new ELSE tok END AS tok FROM gone WHERE NOT eaten
"""

DECODE = "SELECT t.doc, string_agg(v.piece, '' ORDER BY t.pos) AS piece, count(v.tok) AS known, count(*) AS n FROM tokens t LEFT JOIN vocabulary v ON t.tok = v.tok GROUP BY t.doc ORDER BY t.doc"


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens' bytes, their ids, and the merges as rows (left, right, merged) in order of rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    merges = []
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(found)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
    merges.sort(key=lambda x: x[2])
    return list(ranks), np.array(list(ranks.values()), np.int32), np.array(merges, np.int32).reshape(-1, 3)


class Codec:
    """A worker's DuckDB connection with the tables of one vocabulary."""

    def __init__(self, tokens: list[bytes], ids: np.ndarray, merges: np.ndarray, pattern: str) -> None:
        import duckdb
        import regex

        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "300MB"})
        for name, t in (
            ("merges", pa.table({"l": merges[:, 0], "r": merges[:, 1], "new": merges[:, 2]})),
            ("vocabulary", pa.table({"tok": ids, "piece": pa.array([t.decode("latin-1") for t in tokens])})),
        ):
            self.db.register("t", t)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM t")
            self.db.unregister("t")
        self.byte = np.zeros(256, np.int32)
        for t, i in zip(tokens, ids.tolist(), strict=True):
            if len(t) == 1:
                self.byte[t[0]] = i
        self.words = regex.compile(pattern)
        self.space = regex.compile(r"\s")
        self.cut = regex.compile(r" (?=\S)")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in words])
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        return np.repeat(np.arange(len(words), dtype=np.int32), n), np.arange(len(tok), dtype=np.int32), tok, np.cumsum(n) - 1

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (no word empty)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for a in range(0, len(short), WORDS_AT_ONCE):
            some = short[a : a + WORDS_AT_ONCE]
            word, pos, tok, last = self._rows([words[i] for i in some])
            npos, ntok = pos + 1, np.append(tok[1:], -1).astype(np.int32)
            npos[last] = ntok[last] = -1
            self.db.register("letters", pa.table({"word": word, "pos": pos, "tok": tok, "npos": npos, "ntok": ntok}))
            self._spread(self.db.sql(ENCODE).to_arrow_table(), some, out)
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            word, pos, tok, _ = self._rows([words[i] for i in long])
            self.db.register("letters", pa.table({"word": word, "pos": pos, "tok": tok}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE long_words AS SELECT * FROM letters")
            before = len(tok)
            while True:
                self.db.execute(STEP)
                self.db.execute("CREATE OR REPLACE TEMP TABLE long_words AS SELECT * FROM next_long")
                after = self.db.sql("SELECT count(*) FROM long_words").fetchall()[0][0]
                if after == before:
                    break
                before = after
            self._spread(self.db.sql("SELECT word, list(tok ORDER BY pos) AS ids FROM long_words GROUP BY word ORDER BY word").to_arrow_table(), long, out)
        return out

    @staticmethod
    def _spread(result: pa.Table, at: list[int], out: list[np.ndarray]) -> None:
        lists = result.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values, offs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy()
        offs = offs - offs[0]
        for j, i in enumerate(at):
            out[i] = values[offs[j] : offs[j + 1]]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text, as int32 bytes."""
        if len(self.first) + len(self.later) > CACHE:
            self.first.clear()
            self.later.clear()
        # a space before a non-space always begins a word, so texts fall apart there; other spaces stay within a part
        heads: list[str] = []
        tails: list[list[str]] = []
        for t in texts:
            head, space, rest = (t or "").partition(" ")
            heads.append(head)
            tails.append(rest.split(" ") if space else [])
        new = set().union(*tails) - self.later.keys()
        bad = {x for x in new if not x or self.space.match(x)}
        if bad:
            new -= bad
            for i, tail in enumerate(tails):
                if not bad.isdisjoint(tail):
                    parts = self.cut.split(texts[i] or "")
                    heads[i], tails[i] = parts[0], parts[1:]
                    new.update(parts[1:])
            new -= self.later.keys()
        todo = [(self.first, x, self.words.findall(x)) for x in set(heads) - self.first.keys()] + [(self.later, x, self.words.findall(" " + x)) for x in new]
        unique = list({w for _, _, ws in todo for w in ws})
        coded = dict(zip(unique, (a.tobytes() for a in self.encode_words([w.encode() for w in unique])), strict=True)) if unique else {}
        for cache, x, ws in todo:
            cache[x] = coded[ws[0]] if len(ws) == 1 else b"".join(coded[w] for w in ws)
        later = self.later
        return [None if t is None else self.first[h] + b"".join([later[x] for x in tail]) for t, h, tail in zip(texts, heads, tails, strict=True)]

    def decode(self, lists: list[np.ndarray | None]) -> list[str | None]:
        out: list[str | None] = [None if x is None else "" for x in lists]
        some = [i for i, x in enumerate(lists) if x is not None and len(x)]
        if some:
            n = np.array([len(lists[i]) for i in some])
            tok = np.concatenate([lists[i] for i in some]).astype(np.int32)
            doc = np.repeat(np.arange(len(some), dtype=np.int32), n)
            self.db.register("tokens", pa.table({"doc": doc, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
            got = self.db.sql(DECODE).to_arrow_table()
            if not np.array_equal(got["known"].to_numpy(), got["n"].to_numpy()):
                raise ValueError("a token is not in the vocabulary")
            for i, s in zip(some, got["piece"].to_pylist(), strict=True):
                out[i] = s.encode("latin-1").decode("utf-8", "replace")
        return out


_codecs: dict[Any, Codec] = {}


def _codec(key: Any, tables: Any, pattern: str) -> Codec:
    """This worker's codec; workers outlive tasks."""
    if (key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[key, pattern] = Codec(*tables.value, pattern)
    return _codecs[key, pattern]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _id_array(coded: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) // 4 for x in coded])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x for x in coded if x), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in coded]))


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, check: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens of each row; with ``check`` also round_trip: whether the decoded ids are the text again."""
    tables = docs.sparkSession.sparkContext.broadcast(load(path))
    key = f"{path}/{tables.id if hasattr(tables, 'id') else id(tables)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, tables, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = np.array([len(t or "") for t in texts], np.int64)
            for lo, hi in _slices(sizes, TEXT_AT_ONCE):
                coded = codec.encode(texts[lo:hi])
                ids = _id_array(coded)
                columns, names = [b.column("doc_id").slice(lo, hi - lo), ids, pa.array([None if x is None else len(x) // 4 for x in coded], pa.int64())], ["doc_id", "ids", "n_tokens"]
                if check:
                    back = codec.decode([None if x is None else np.frombuffer(x, np.int32) for x in coded])
                    columns.append(pa.array([None if t is None else t == x for t, x in zip(texts[lo:hi], back, strict=True)], pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, n_tokens long" + ", round_trip boolean" * check)


def decode(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    tables = coded.sparkSession.sparkContext.broadcast(load(path))
    key = f"{path}/{tables.id if hasattr(tables, 'id') else id(tables)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, tables, PATTERN)
        for b in batches:
            lists = b.column("ids")
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            for lo, hi in _slices(sizes, TEXT_AT_ONCE // 4):
                got = codec.decode([np.array(x.as_py(), np.int32) if x.is_valid else None for x in lists.slice(lo, hi - lo)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(got, pa.string())], ["doc_id", "text"])

    return arrow_map(coded.select("doc_id", "ids"), run, "doc_id long, text string")
