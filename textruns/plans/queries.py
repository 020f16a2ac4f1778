"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textruns.functions.kernels import STRATEGIES
from textruns.operators import construct as c
from textruns.operators import navigate as nav
from textruns.operators import search, stats
from textruns.operators.deal import joined
from textruns.sources.texts import decode_patterns, read_parquet, spread

from .index import TextIndex, sweep

Query = Callable[[SparkSession, str], DataFrame]

RATE = 4
PATTERNS = ["ed", "e", "an", "ee", " l", "zz", "ion", "a", "bl", "#"]
LONGER = ["the", "ation", "stupid", "ción", "heit", "queue", "Licensed under"]
ENCODED = ["ZWQ=", "YW4=", "IGw="]


def parts(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_parquet(spark, f"{d}/part.parquet", "p_partkey", "p_name"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_parquet(spark, f"{d}/benchmark.parquet", "item_id", "text"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_parquet(spark, f"{d}/documents.parquet", "doc_id", "text"))


def patterns(spark: SparkSession, texts: list[str]) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(texts)), "pattern_id long, encoded string")
    return decode_patterns(rows)


def _bwt(spark: SparkSession, d: str) -> DataFrame:
    return c.bwt(c.suffix_array(parts(spark, d)))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return c.bwt_runs(_bwt(spark, d))


def _runs2(spark: SparkSession, d: str) -> DataFrame:
    return c.ordered_runs(_runs(spark, d))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("text_id")


def _probes(spark: SparkSession, d: str, name: str, values: list[int]) -> DataFrame:
    return _ids(spark, d).withColumn(name, F.explode(F.array(*(F.lit(v).cast("long") for v in values))))


def _symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("sym", F.explode(F.array(*(F.lit(ord(x)) for x in "aeln"))))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _base(texts: str = "SELECT p_partkey AS text_id, p_name AS txt FROM part") -> str:
    """Relations of an index in DuckDB: hex of the UTF-8 bytes orders suffixes as bytes do, and '' is the sentinel."""
    return f"""
t AS (SELECT CAST(text_id AS BIGINT) AS text_id, hex(encode(txt)) AS h, octet_length(encode(txt)) + 1 AS n FROM ({texts}) WHERE txt IS NOT NULL),
s AS (SELECT text_id, h, n, unnest(range(0, n)) AS pos FROM t),
sa AS (SELECT text_id, h, n, pos AS sa, row_number() OVER (PARTITION BY text_id ORDER BY substr(h, 2 * pos + 1)) - 1 AS i FROM s),
bwt AS (SELECT text_id, n, i, sa, (sa + n - 1) % n AS text_pos, CAST(coalesce(nullif(CASE WHEN sa = 0 THEN 0 ELSE ascii(unhex(substr(h, 2 * sa - 1, 2))::VARCHAR) END, 0), 0) AS INT) AS sym0, CAST(CASE WHEN sa = 0 THEN 0 ELSE 16 * (strpos('0123456789ABCDEF', substr(h, 2 * sa - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * sa, 1)) - 1 END AS INT) AS sym FROM sa),
fl AS (SELECT *, CASE WHEN i = 0 OR lag(sym) OVER w IS DISTINCT FROM sym THEN 1 ELSE 0 END AS hd FROM bwt WINDOW w AS (PARTITION BY text_id ORDER BY i)),
g AS (SELECT *, CAST(sum(hd) OVER (PARTITION BY text_id ORDER BY i) - 1 AS BIGINT) AS run FROM fl),
runs AS (SELECT text_id, run, min(sym) AS sym, min(i) AS st, max(i) + 1 AS en, arg_min(text_pos, i) AS head_tpos, arg_max(text_pos, i) AS tail_tpos FROM g GROUP BY 1, 2),
psi AS (SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY sym, i) - 1 AS j, i AS psi FROM bwt),
pr AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY sym, run) - 1 AS prun,
       CAST(coalesce(sum(en - st) OVER (PARTITION BY text_id, sym ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sym_before,
       row_number() OVER (PARTITION BY text_id, sym ORDER BY run) - 1 AS sym_run,
       CAST(coalesce(sum(en - st) OVER (PARTITION BY text_id ORDER BY sym, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f_start FROM runs),
r AS (SELECT text_id, count(*) AS r FROM runs GROUP BY 1),
lb AS (SELECT x.text_id, x.head_tpos AS mark, y.tail_tpos AS sample, y.run AS sample_run FROM runs x JOIN r USING (text_id) JOIN runs y ON y.text_id = x.text_id AND y.run = (x.run + r.r - 1) % r.r),
lfw AS (SELECT x.text_id, x.tail_tpos AS mark, y.head_tpos AS sample, y.prun AS sample_prun FROM pr x JOIN r USING (text_id) JOIN pr y ON y.text_id = x.text_id AND y.prun = (x.prun + 1) % r.r)
""".replace(", CAST(coalesce(nullif(CASE WHEN sa = 0 THEN 0 ELSE ascii(unhex(substr(h, 2 * sa - 1, 2))::VARCHAR) END, 0), 0) AS INT) AS sym0", "")


WITH = "WITH " + _base()
WITH_ITEMS = "WITH " + _base("SELECT item_id AS text_id, text AS txt FROM benchmark")
_SYM = "(VALUES (97), (101), (108), (110)) AS y(sym)"


def _values(texts: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(texts)) + ") AS p(pattern_id, pattern)"


@query("symbols", WITH + "SELECT text_id, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN pos = n - 1 THEN 0 ELSE 16 * (strpos('0123456789ABCDEF', substr(h, 2 * pos + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * pos + 2, 1)) - 1 END AS INT) AS sym FROM s")
def symbols(spark: SparkSession, d: str) -> DataFrame:
    return c.symbols(parts(spark, d))


@query("alphabet", WITH + "SELECT text_id, sym, row_number() OVER w - 1 AS code, freq, CAST(coalesce(sum(freq) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c_before FROM (SELECT text_id, sym, count(*) AS freq FROM bwt GROUP BY 1, 2) WINDOW w AS (PARTITION BY text_id ORDER BY sym)")
def alphabet(spark: SparkSession, d: str) -> DataFrame:
    return c.alphabet(c.symbols(parts(spark, d)))


@query("f_array", WITH + "SELECT text_id, CAST(byte AS INT) AS byte, (SELECT count(*) FROM bwt WHERE bwt.text_id = t.text_id AND sym < byte) AS first FROM t, range(0, 257) AS x(byte)")
def f_array(spark: SparkSession, d: str) -> DataFrame:
    return c.f_array(c.alphabet(c.symbols(parts(spark, d))))


@query("suffix_array", WITH + "SELECT text_id, n, i, sa FROM sa")
def suffix_array(spark: SparkSession, d: str) -> DataFrame:
    return c.suffix_array(parts(spark, d)).select("text_id", "n", "i", "sa")


@query("suffix_array_windows", WITH + "SELECT text_id, i, sa FROM sa")
def suffix_array_windows(spark: SparkSession, d: str) -> DataFrame:
    return c.suffix_array_by(parts(spark, d), "windows")


@query("suffix_array_blocks", WITH_ITEMS + "SELECT text_id, i, sa FROM sa")
def suffix_array_blocks(spark: SparkSession, d: str) -> DataFrame:
    return c.suffix_array_by(items(spark, d), "blocks")


@query("bwt", WITH + "SELECT text_id, i, sym, text_pos FROM bwt")
def bwt(spark: SparkSession, d: str) -> DataFrame:
    return _bwt(spark, d)


@query("bwt_runs", WITH + "SELECT text_id, run, sym, st AS start, en AS end_excl, head_tpos, tail_tpos FROM runs")
def bwt_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


@query("psi_runs", WITH + "SELECT text_id, run, sym, st AS start, en AS end_excl, head_tpos, tail_tpos, sym_before, sym_run, prun, f_start FROM pr")
def psi_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs2(spark, d)


@query("run_count_stats", WITH_ITEMS + "SELECT text_id, n, r FROM t JOIN r USING (text_id)".replace("SELECT text_id, n, r", "SELECT t.text_id, n, r.r AS r"))
def run_count_stats(spark: SparkSession, d: str) -> DataFrame:
    return c.counters(items(spark, d))


@query("run_cum_counts", WITH + "SELECT text_id, sym, n_runs, CAST(sum(n_runs) OVER (PARTITION BY text_id ORDER BY sym) AS BIGINT) AS cum_runs FROM (SELECT text_id, sym, count(*) AS n_runs FROM runs GROUP BY 1, 2)")
def run_cum_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.runs_per_symbol(_runs(spark, d))


@query("psi", WITH + "SELECT text_id, j, psi FROM psi")
def psi(spark: SparkSession, d: str) -> DataFrame:
    return c.psi(_bwt(spark, d))


@query("lf", WITH + "SELECT text_id, psi AS i, j AS lf FROM psi")
def lf(spark: SparkSession, d: str) -> DataFrame:
    return c.lf(_bwt(spark, d))


@query("phi_backward", WITH + "SELECT text_id, sa AS v, lag(sa) OVER (PARTITION BY text_id ORDER BY i) AS next_v FROM sa")
def phi_backward(spark: SparkSession, d: str) -> DataFrame:
    return c.phi(c.suffix_array(parts(spark, d)), True)


@query("phi_forward", WITH + "SELECT text_id, sa AS v, lead(sa) OVER (PARTITION BY text_id ORDER BY i) AS next_v FROM sa")
def phi_forward(spark: SparkSession, d: str) -> DataFrame:
    return c.phi(c.suffix_array(parts(spark, d)), False)


def _phi_marks(backward: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        sa, runs2 = c.suffix_array(parts(spark, d)), _runs2(spark, d)
        links = c.links_backward(runs2) if backward else c.links_forward(runs2)
        lengths = parts(spark, d).select("text_id", (F.length("body") + 1).cast("long").alias("n"))
        return nav.phi_by_marks(links, lengths, sa.select("text_id", F.col("sa").alias("v")), backward)

    return run


# the neighbours of the suffix array's ends are each other through the circular links
query("phi_backward_by_marks", WITH + "SELECT text_id, sa AS v, coalesce(lag(sa) OVER w, last_value(sa) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_v FROM sa WINDOW w AS (PARTITION BY text_id ORDER BY i)")(_phi_marks(True))
query("phi_forward_by_marks", WITH + "SELECT text_id, sa AS v, coalesce(lead(sa) OVER w, first_value(sa) OVER w) AS next_v FROM sa WINDOW w AS (PARTITION BY text_id ORDER BY i)")(_phi_marks(False))


@query("links_backward", WITH + "SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY mark) - 1 AS mark_order FROM lb")
def links_backward(spark: SparkSession, d: str) -> DataFrame:
    return c.links_backward(_runs(spark, d))


@query("links_forward", WITH + "SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY mark) - 1 AS mark_order FROM lfw")
def links_forward(spark: SparkSession, d: str) -> DataFrame:
    return c.links_forward(_runs2(spark, d))


@query("sample_links_backward", WITH + "SELECT text_id, sample, row_number() OVER (PARTITION BY text_id ORDER BY sample) - 1 AS sample_order, mark, row_number() OVER (PARTITION BY text_id ORDER BY mark) - 1 AS mark_order FROM lb")
def sample_links_backward(spark: SparkSession, d: str) -> DataFrame:
    return c.sample_links(c.links_backward(_runs(spark, d)))


@query("sample_links_forward", WITH + "SELECT text_id, sample, row_number() OVER (PARTITION BY text_id ORDER BY sample) - 1 AS sample_order, mark, row_number() OVER (PARTITION BY text_id ORDER BY mark) - 1 AS mark_order FROM lfw")
def sample_links_forward(spark: SparkSession, d: str) -> DataFrame:
    return c.sample_links(c.links_forward(_runs2(spark, d)))


@query("extremes", WITH + "SELECT text_id, arg_min(head_tpos, run) AS first_head, arg_max(head_tpos, run) AS last_head, arg_min(tail_tpos, run) AS first_tail, arg_max(tail_tpos, run) AS last_tail FROM runs GROUP BY 1")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    return c.extremes(_runs(spark, d))


_POS = [0, 1, 3, 6, 10, 15]
_UNNEST = "unnest([" + ", ".join(map(str, _POS)) + "]::BIGINT[])"


@query("access", WITH + f"SELECT p.text_id, p.pos, g.run, g.sym FROM (SELECT text_id, n, {_UNNEST} AS pos FROM t) p JOIN g ON g.text_id = p.text_id AND g.i = p.pos WHERE p.pos < p.n")
def access(spark: SparkSession, d: str) -> DataFrame:
    n = parts(spark, d).select("text_id", (F.length("body") + 1).alias("n"))
    probes = joined(_probes(spark, d, "pos", _POS), n, "text_id").where("pos < n").select("text_id", "pos")
    return nav.access(_runs(spark, d), probes)


@query("rank_c", WITH + f"""SELECT p.text_id, p.pos, y.sym, (SELECT count(*) FROM bwt b WHERE b.text_id = p.text_id AND b.sym = y.sym AND b.i < p.pos) AS rank,
  (SELECT count(*) FROM runs b WHERE b.text_id = p.text_id AND b.sym = y.sym AND b.st < p.pos) AS symbol_runs,
  EXISTS (SELECT 1 FROM runs b WHERE b.text_id = p.text_id AND b.sym = y.sym AND b.st < p.pos AND b.en >= p.pos) AS covers
  FROM (SELECT text_id, {_UNNEST} AS pos FROM t) p, {_SYM}""")
def rank_c(spark: SparkSession, d: str) -> DataFrame:
    return nav.rank(_runs2(spark, d), _symbols(_probes(spark, d, "pos", _POS)))


@query("select_c", WITH + f"""SELECT p.text_id, p.k, y.sym, o.i AS pos FROM (SELECT text_id, unnest([1, 2, 3]::BIGINT[]) AS k FROM t) p CROSS JOIN {_SYM}
  LEFT JOIN (SELECT text_id, sym, i, row_number() OVER (PARTITION BY text_id, sym ORDER BY i) AS k FROM bwt) o ON o.text_id = p.text_id AND o.sym = y.sym AND o.k = p.k""")
def select_c(spark: SparkSession, d: str) -> DataFrame:
    return nav.select(_runs2(spark, d), _symbols(_probes(spark, d, "k", [1, 2, 3])))


@query("select_run", WITH + f"SELECT p.text_id, p.k, y.sym, o.run FROM (SELECT text_id, unnest([1, 2]::BIGINT[]) AS k FROM t) p CROSS JOIN {_SYM} LEFT JOIN pr o ON o.text_id = p.text_id AND o.sym = y.sym AND o.sym_run = p.k - 1")
def select_run(spark: SparkSession, d: str) -> DataFrame:
    return nav.select_run(_runs2(spark, d), _symbols(_probes(spark, d, "k", [1, 2])))


@query("lf_range", WITH + f"""SELECT t.text_id, 2::BIGINT AS lo, 9::BIGINT AS hi, y.sym,
  (SELECT count(*) FROM bwt b WHERE b.text_id = t.text_id AND (b.sym < y.sym OR b.sym = y.sym AND b.i < 2)) AS new_lo,
  (SELECT count(*) FROM bwt b WHERE b.text_id = t.text_id AND (b.sym < y.sym OR b.sym = y.sym AND b.i < 9)) AS new_hi
  FROM t, {_SYM} WHERE EXISTS (SELECT 1 FROM bwt b WHERE b.text_id = t.text_id AND b.sym = y.sym)""")
def lf_range(spark: SparkSession, d: str) -> DataFrame:
    ranges = _symbols(_ids(spark, d).select("text_id", F.lit(2).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi")))
    return nav.lf_range(_runs2(spark, d), c.alphabet(c.symbols(parts(spark, d))), ranges)


@query("split_in_runs", WITH + "SELECT text_id, 3::BIGINT AS lo, 11::BIGINT AS hi, run, sym, greatest(st, 3) AS start, least(en, 11) AS end_excl FROM runs WHERE st < 11 AND en > 3")
def split_in_runs(spark: SparkSession, d: str) -> DataFrame:
    return nav.split_in_runs(_runs(spark, d), _ids(spark, d).select("text_id", F.lit(3).cast("long").alias("lo"), F.lit(11).cast("long").alias("hi")))


@query("forward_runs", WITH + f"""SELECT pr.text_id, y.sym, 2::BIGINT AS k_lo, 5::BIGINT AS k_hi, run, min(o.i) AS start, max(o.i) + 1 AS end_excl FROM pr JOIN {_SYM} ON pr.sym = y.sym
  JOIN (SELECT text_id, sym, i, row_number() OVER (PARTITION BY text_id, sym ORDER BY i) AS k FROM bwt) o ON o.text_id = pr.text_id AND o.sym = y.sym AND o.k >= 2 AND o.k < 5 AND o.i >= st AND o.i < en GROUP BY ALL""")
def forward_runs(spark: SparkSession, d: str) -> DataFrame:
    ranges = _symbols(_ids(spark, d).select("text_id", F.lit(2).cast("long").alias("k_lo"), F.lit(5).cast("long").alias("k_hi")))
    return nav.forward_runs(_runs2(spark, d), ranges)


@query("split_in_whole_runs", WITH + "SELECT text_id, 3::BIGINT AS lo, 11::BIGINT AS hi, run, sym, st AS start, en AS end_excl FROM runs WHERE st < 11 AND en > 3")
def split_in_whole_runs(spark: SparkSession, d: str) -> DataFrame:
    return nav.split_in_runs(_runs(spark, d), _ids(spark, d).select("text_id", F.lit(3).cast("long").alias("lo"), F.lit(11).cast("long").alias("hi")), clip=False)


@query("break_range", WITH + f"SELECT text_id, 1::BIGINT AS lo, 8::BIGINT AS hi, y.sym, run, greatest(st, 1) AS start, least(en, 8) AS end_excl FROM runs JOIN {_SYM} ON runs.sym = y.sym WHERE st < 8 AND en > 1")
def break_range(spark: SparkSession, d: str) -> DataFrame:
    ranges = _symbols(_ids(spark, d).select("text_id", F.lit(1).cast("long").alias("lo"), F.lit(8).cast("long").alias("hi")))
    return nav.break_range(_runs(spark, d), ranges)


@query("own_rank", WITH + f"""SELECT p.text_id, p.pos, g.sym, (SELECT count(*) FROM bwt b WHERE b.text_id = p.text_id AND b.sym = g.sym AND b.i < p.pos) AS rank, g.run, pr.st AS run_start, pr.en AS run_end, pr.sym_run
  FROM (SELECT text_id, n, {_UNNEST} AS pos FROM t) p JOIN g ON g.text_id = p.text_id AND g.i = p.pos JOIN pr ON pr.text_id = g.text_id AND pr.run = g.run WHERE p.pos < p.n""")
def own_rank(spark: SparkSession, d: str) -> DataFrame:
    n = parts(spark, d).select("text_id", (F.length("body") + 1).alias("n"))
    return nav.own_rank(_runs2(spark, d), joined(_probes(spark, d, "pos", _POS), n, "text_id").where("pos < n").select("text_id", "pos"))


@query("rank_run", WITH + f"SELECT p.text_id, p.v, count(*) FILTER (st < p.v) AS below, count(*) FILTER (st <= p.v) AS upto, max(st) FILTER (st <= p.v) AS run_start FROM (SELECT text_id, {_UNNEST} AS v FROM t) p JOIN runs ON runs.text_id = p.text_id GROUP BY 1, 2")
def rank_run(spark: SparkSession, d: str) -> DataFrame:
    return nav.rank_run(_runs(spark, d), _probes(spark, d, "v", _POS))


@query("run_at", WITH + "SELECT text_id, run, sym, st AS start, en AS end_excl, en - st AS length FROM runs WHERE run IN (0, 2, 5)")
def run_at(spark: SparkSession, d: str) -> DataFrame:
    return nav.run_at(_runs(spark, d), _probes(spark, d, "run", [0, 2, 5]))


@query("traverse", WITH + f"SELECT text_id, y.sym, sym_run, run, st AS start, en AS end_excl FROM pr JOIN {_SYM} ON pr.sym = y.sym")
def traverse(spark: SparkSession, d: str) -> DataFrame:
    return nav.traverse(_runs2(spark, d), _symbols(_ids(spark, d)))


@query("first_symbol", WITH + "SELECT text_id, arg_min(sym, i) AS sym, count(DISTINCT sym) AS sigma, count(*) AS size FROM bwt GROUP BY 1")
def first_symbol(spark: SparkSession, d: str) -> DataFrame:
    return nav.first_symbol(_runs(spark, d))


@query("predecessor", WITH + f"""SELECT p.text_id, p.v, o.mo AS "order", o.mark FROM (SELECT text_id, {_UNNEST} AS v FROM t) p JOIN LATERAL (SELECT mark, row_number() OVER (ORDER BY mark) - 1 AS mo FROM lb WHERE lb.text_id = p.text_id ORDER BY (mark < p.v) DESC, mark DESC LIMIT 1) o ON true""".replace("row_number() OVER (ORDER BY mark) - 1 AS mo FROM lb WHERE lb.text_id = p.text_id", "mo FROM (SELECT text_id, mark, row_number() OVER (PARTITION BY text_id ORDER BY mark) - 1 AS mo FROM lb) l WHERE l.text_id = p.text_id"))
def predecessor(spark: SparkSession, d: str) -> DataFrame:
    return nav.predecessor(c.links_backward(_runs(spark, d)).select("text_id", "mark"), _probes(spark, d, "v", _POS))


@query("successor", WITH + f"""SELECT p.text_id, p.v, o.mo AS "order", o.mark FROM (SELECT text_id, {_UNNEST} AS v FROM t) p JOIN LATERAL (SELECT mark, mo FROM (SELECT text_id, mark, row_number() OVER (PARTITION BY text_id ORDER BY mark) - 1 AS mo FROM lfw) l WHERE l.text_id = p.text_id ORDER BY (mark >= p.v) DESC, mark LIMIT 1) o ON true""")
def successor(spark: SparkSession, d: str) -> DataFrame:
    return nav.successor(c.links_forward(_runs2(spark, d)).select("text_id", "mark"), _probes(spark, d, "v", _POS))


@query("symbol_of_row", WITH + f"SELECT p.text_id, p.i, CAST(CASE WHEN s.sa = s.n - 1 THEN 0 ELSE 16 * (strpos('0123456789ABCDEF', substr(s.h, 2 * s.sa + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(s.h, 2 * s.sa + 2, 1)) - 1 END AS INT) AS sym FROM (SELECT text_id, n, {_UNNEST} AS i FROM t) p JOIN sa s ON s.text_id = p.text_id AND s.i = p.i WHERE p.i < p.n")
def symbol_of_row(spark: SparkSession, d: str) -> DataFrame:
    n = parts(spark, d).select("text_id", (F.length("body") + 1).alias("n"))
    probes = joined(_probes(spark, d, "i", _POS), n, "text_id").where("i < n").select("text_id", "i")
    return nav.symbol_of_row(c.alphabet(c.symbols(parts(spark, d))), probes)


@query("exist", WITH + f"SELECT p.text_id, y.sym, p.pos FROM (SELECT text_id, {_UNNEST} AS pos FROM t) p JOIN {_SYM} ON true JOIN bwt b ON b.text_id = p.text_id AND b.i = p.pos AND b.sym = y.sym")
def exist(spark: SparkSession, d: str) -> DataFrame:
    n = parts(spark, d).select("text_id", (F.length("body") + 1).alias("n"))
    probes = _symbols(joined(_probes(spark, d, "pos", _POS), n, "text_id").where("pos < n").select("text_id", "pos"))
    return nav.exist(_runs(spark, d), probes)


@query("closest_run_break", WITH + f"""SELECT p.text_id, y.sym, p.pos, (SELECT arg_min(x, abs(x - p.pos) * 1000 + x) FROM (SELECT st AS x FROM runs r WHERE r.text_id = p.text_id AND r.sym = y.sym UNION ALL SELECT en - 1 FROM runs r WHERE r.text_id = p.text_id AND r.sym = y.sym)) AS break_pos
  FROM (SELECT text_id, {_UNNEST} AS pos FROM t) p, {_SYM}""")
def closest_run_break(spark: SparkSession, d: str) -> DataFrame:
    return nav.closest_run_break(_runs(spark, d), _symbols(_probes(spark, d, "pos", _POS)))


@query("mark_gaps", WITH + """SELECT text_id, mark, row_number() OVER w - 1 AS "order", mark - lag(mark) OVER w AS gap FROM lb WINDOW w AS (PARTITION BY text_id ORDER BY mark)""")
def mark_gaps(spark: SparkSession, d: str) -> DataFrame:
    return nav.gaps(c.links_backward(_runs(spark, d)).select("text_id", "mark"))


@query("expand_runs", WITH + "SELECT text_id, string_agg(printf('%02X', sym), '' ORDER BY i) AS bwt FROM bwt GROUP BY 1")
def expand_runs(spark: SparkSession, d: str) -> DataFrame:
    return nav.expand_runs(_runs(spark, d))


_FOUND = f"found AS (SELECT text_id, pattern_id, sa, i FROM sa, {_values(PATTERNS)} WHERE starts_with(substr(h, 2 * sa + 1), hex(encode(pattern))))"
_FOUND = _FOUND.replace("starts_with(substr(h, 2 * sa + 1), hex(encode(pattern)))", "substr(h, 2 * sa + 1, 2 * octet_length(encode(pattern))) = hex(encode(pattern))")


def _index(spark: SparkSession, d: str, s: int = RATE) -> TextIndex:
    return TextIndex.build(parts(spark, d), s)


@query("count_patterns", WITH + f", {_FOUND} SELECT text_id, pattern_id::BIGINT AS pattern_id, count(*) AS occ FROM found GROUP BY ALL")
def count_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).count(patterns(spark, PATTERNS)).select("text_id", "pattern_id", "occ")


@query("sa_range", WITH + f", {_FOUND} SELECT text_id, pattern_id::BIGINT AS pattern_id, min(i) AS sa_start, max(i) + 1 AS sa_end FROM found GROUP BY ALL")
def sa_range(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).count(patterns(spark, PATTERNS)).select("text_id", "pattern_id", "sa_start", "sa_end")


_LOCATE_SQL = WITH + f", {_FOUND} SELECT text_id, pattern_id::BIGINT AS pattern_id, sa::BIGINT AS pos FROM found"


def _locate(strategy: str) -> Query:
    return lambda spark, d: _index(spark, d).locate(patterns(spark, PATTERNS), strategy)


for _name in STRATEGIES:
    query(f"locate_{_name}", _LOCATE_SQL)(_locate(_name))


@query("locate_scan", _LOCATE_SQL)
def locate_scan(spark: SparkSession, d: str) -> DataFrame:
    return search.scan_locate(parts(spark, d), patterns(spark, PATTERNS))


@query("locate_slice_join", _LOCATE_SQL)
def locate_slice_join(spark: SparkSession, d: str) -> DataFrame:
    return search.slice_locate(c.suffix_array(parts(spark, d)), _index(spark, d).count(patterns(spark, PATTERNS)))


@query("toehold_backward", WITH + f", {_FOUND} SELECT text_id, pattern_id::BIGINT AS pattern_id, arg_max(sa, i)::BIGINT AS pos FROM found GROUP BY ALL")
def toehold_backward(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).first_occurrences(patterns(spark, PATTERNS), "tails_sampled")


@query("toehold_forward", WITH + f", {_FOUND} SELECT text_id, pattern_id::BIGINT AS pattern_id, arg_min(sa, i)::BIGINT AS pos FROM found GROUP BY ALL")
def toehold_forward(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).first_occurrences(patterns(spark, PATTERNS), "heads_psi_sampled")


BORDERLESS = ["the", "ation", "ción", "heit", "Licensed under"]
_COUNT_DOCS = f"""SELECT doc_id AS text_id, pattern_id::BIGINT AS pattern_id, occ FROM (SELECT doc_id, pattern_id, ((length(text) - length(replace(text, pattern, ''))) // length(pattern))::BIGINT AS occ FROM documents, {_values(BORDERLESS)}) WHERE occ > 0"""


@query("count_patterns_docs", _COUNT_DOCS)
def count_patterns_docs(spark: SparkSession, d: str) -> DataFrame:
    return TextIndex.build(documents(spark, d), 64, False, False).count(patterns(spark, BORDERLESS)).select("text_id", "pattern_id", "occ")


@query("count_scan_docs", _COUNT_DOCS)
def count_scan_docs(spark: SparkSession, d: str) -> DataFrame:
    return search.scan_count(documents(spark, d), patterns(spark, BORDERLESS))


_LOCATE_DOCS = f"""
WITH cut AS (SELECT doc_id, pattern_id, pattern, string_split(text, pattern) AS parts FROM documents, {_values(BORDERLESS)} WHERE contains(text, pattern)),
each AS (SELECT doc_id, pattern_id, octet_length(encode(pattern)) AS m, generate_subscripts(parts, 1) AS k, unnest(parts) AS part FROM cut),
placed AS (SELECT doc_id, pattern_id, k, m, sum(octet_length(encode(part)) + m) OVER (PARTITION BY doc_id, pattern_id ORDER BY k) - m AS pos, count(*) OVER (PARTITION BY doc_id, pattern_id) AS n FROM each)
SELECT doc_id AS text_id, pattern_id::BIGINT AS pattern_id, pos::BIGINT AS pos FROM placed WHERE k < n
"""


@query("locate_docs", _LOCATE_DOCS)
def locate_docs(spark: SparkSession, d: str) -> DataFrame:
    return TextIndex.build(documents(spark, d), 64, False, False).locate(patterns(spark, BORDERLESS), "heads")


@query("locate_each_docs", "WITH found AS (" + _LOCATE_DOCS + ") SELECT strategy, text_id, pattern_id, count(*) AS occ, sum(pos)::BIGINT AS positions FROM found, (VALUES " + ", ".join(f"('{k}')" for k in STRATEGIES) + ") AS k(strategy) GROUP BY ALL")
def locate_each_docs(spark: SparkSession, d: str) -> DataFrame:
    """By strategy, document and pattern: occurrences, and the sum of their positions."""
    found = TextIndex.build(documents(spark, d), 16).sums_by_each(patterns(spark, BORDERLESS))
    return found.groupBy("strategy", "text_id", "pattern_id").agg(F.sum("occ").alias("occ"), F.sum("positions").alias("positions"))


@query("locate_scan_docs", _LOCATE_DOCS)
def locate_scan_docs(spark: SparkSession, d: str) -> DataFrame:
    return search.scan_locate(documents(spark, d), patterns(spark, BORDERLESS))


def _greedy_sql(backward: bool, rates: tuple[int, ...] = (RATE,)) -> str:
    """CTEs of sub-sampling over whole items for every rate s: a recursive walk from kept value to kept value, each jump given by windows.

    seq_: run ends in walk order with where a jump from each leads; kept_: (s, text_id, run); sub_: the kept marks; full_ and valid_: with their neighbours.
    """
    x = "b" if backward else "f"
    value, links, key, run = ("tail_tpos", "lb", "sample_run", "run") if backward else ("head_tpos", "lfw", "sample_prun", "prun")
    up, order = (value, "mark") if backward else (f"-{value}", "mark DESC")
    reach = " ".join(f"WHEN {s} THEN max(k) OVER (PARTITION BY s, text_id ORDER BY a RANGE BETWEEN CURRENT ROW AND {s} FOLLOWING)" for s in rates)
    return f"""ends_{x} AS (SELECT text_id, min(mark) AS lo, max(mark) AS hi FROM {links} GROUP BY 1),
must_{x} AS (SELECT DISTINCT l.text_id, {key} AS run FROM {links} l JOIN ends_{x} e ON e.text_id = l.text_id AND l.mark IN (e.lo, e.hi)),
placed_{x} AS (SELECT s, pr.text_id, pr.run, {up} AS a, must_{x}.run IS NOT NULL AS req, row_number() OVER (PARTITION BY s, pr.text_id ORDER BY {up}) - 1 AS k, count(*) OVER (PARTITION BY s, pr.text_id) - 1 AS last
   FROM (VALUES {", ".join(f"({s})" for s in rates)}) AS rates(s), pr LEFT JOIN must_{x} ON must_{x}.text_id = pr.text_id AND must_{x}.run = pr.{run}),
seq_{x} AS (SELECT s, text_id, run, k, last, CAST(least(greatest(CASE s {reach} END, k + 1), min(CASE WHEN req OR k = last THEN k END) OVER (PARTITION BY s, text_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS BIGINT) AS jump FROM placed_{x}),
walk_{x} AS (SELECT s, text_id, run, k, last, jump FROM seq_{x} WHERE k = 0 UNION ALL SELECT q.s, q.text_id, q.run, q.k, q.last, q.jump FROM walk_{x} w JOIN seq_{x} q ON q.s = w.s AND q.text_id = w.text_id AND q.k = w.jump WHERE w.k < w.last),
kept_{x} AS (SELECT s, text_id, run FROM walk_{x}),
sub_{x} AS (SELECT kept.s, l.text_id, l.mark, l.sample, pr.run, pr.prun FROM {links} l JOIN pr ON pr.text_id = l.text_id AND pr.{run} = l.{key} JOIN kept_{x} kept ON kept.text_id = l.text_id AND kept.run = pr.run),
full_{x} AS (SELECT text_id, mark, lead(mark) OVER (PARTITION BY text_id ORDER BY {order}) AS f FROM {links}),
valid_{x} AS (SELECT s, text_id, mark, f IS NOT DISTINCT FROM n AS valid, CASE WHEN f IS DISTINCT FROM n THEN abs(f - mark) END AS area
   FROM (SELECT s, text_id, mark, lead(mark) OVER (PARTITION BY s, text_id ORDER BY {order}) AS n FROM sub_{x}) JOIN full_{x} USING (text_id, mark))"""


_ITEMS = "WITH RECURSIVE " + _base("SELECT item_id AS text_id, text AS txt FROM benchmark") + ", "


def _kept(spark: SparkSession, d: str, backward: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, kept samples with their places, kept marks, of whole items."""
    texts = items(spark, d)
    runs2 = c.ordered_runs(c.bwt_runs(c.bwt(c.suffix_array(texts))))
    places = c.subsample_places(c.subsamples(texts, RATE, backward), runs2)
    links, key, number = (c.links_backward(runs2), "sample_run", "run") if backward else (c.links_forward(runs2), "sample_prun", "prun")
    return links, places, c.submarks(links, places.select("text_id", F.col(number).alias(key)), key)


def _subsampling(backward: bool) -> None:
    side, x, value = ("backward", "b", "tail_tpos") if backward else ("forward", "f", "head_tpos")
    head = _ITEMS + _greedy_sql(backward)
    number = "row_number() OVER (PARTITION BY {0} ORDER BY {1}) - 1"
    places = f"places AS (SELECT text_id, run, st AS start, prun, {number.format('text_id', 'run')} AS row_order, {number.format('text_id', 'prun')} AS symbol_order FROM kept_{x} JOIN pr USING (text_id, run))"
    query(f"subsamples_{side}", f"{head} SELECT text_id, run, pr.{value} AS tpos FROM kept_{x} JOIN pr USING (text_id, run)")(lambda spark, d: c.subsamples(items(spark, d), RATE, backward))
    query(f"subsample_places_{side}", f"{head}, {places} SELECT * FROM places")(lambda spark, d: _kept(spark, d, backward)[1])
    query(f"submarks_{side}", f"{head} SELECT text_id, mark, sample FROM sub_{x}")(lambda spark, d: _kept(spark, d, backward)[2])
    query(f"submark_links_{side}", f"{head}, {places} SELECT text_id, mark, {number.format('text_id', 'mark')} AS mark_order, row_order, symbol_order FROM sub_{x} JOIN places USING (text_id, run)")(
        lambda spark, d: c.submark_links(*_kept(spark, d, backward)[:2], backward)
    )
    query(f"validity_{side}", f"{head} SELECT text_id, mark, valid, area FROM valid_{x}")(lambda spark, d: c.validity(*_kept(spark, d, backward)[::2], backward))


_subsampling(True)
_subsampling(False)


@query("cross_variant_diff", "SELECT 0::BIGINT AS text_id, 0::BIGINT AS pattern_id, 0::BIGINT AS pos, '' AS strategy WHERE false")
def cross_variant_diff(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences that not every strategy finds exactly once, with one that does: none, of any pattern."""
    found = _index(spark, d).locate_by_each(patterns(spark, PATTERNS))
    once = found.groupBy("text_id", "pattern_id", "pos").agg(F.count("*").alias("n"), F.count_distinct("strategy").alias("k"), F.min("strategy").alias("strategy"))
    return once.where(f"n <> {len(STRATEGIES)} OR k <> {len(STRATEGIES)}").select("text_id", "pattern_id", "pos", "strategy")


@query("occurrence_stats", WITH_ITEMS + f", {_FOUND}, n AS (SELECT text_id, pattern_id, count(*) AS occ FROM found GROUP BY ALL) SELECT count(DISTINCT pattern_id) AS patterns, coalesce(sum(occ), 0)::BIGINT AS total, min(occ) AS least, max(occ) AS most, avg(occ) AS mean FROM n")
def occurrence_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.occurrence_stats(TextIndex.build(items(spark, d)).count(patterns(spark, PATTERNS)))


@query("occurrences_per_pattern", WITH_ITEMS + f", {_FOUND}, n AS (SELECT text_id, pattern_id, count(*) AS occ FROM found GROUP BY ALL) SELECT pattern_id::BIGINT AS pattern_id, count(*) AS texts, sum(occ)::BIGINT AS total, min(occ) AS least, max(occ) AS most FROM n GROUP BY 1")
def occurrences_per_pattern(spark: SparkSession, d: str) -> DataFrame:
    return stats.per_pattern(TextIndex.build(items(spark, d)).count(patterns(spark, PATTERNS)))


@query("mark_density", WITH + "SELECT text_id, (mark // 8)::BIGINT AS bin, count(*) AS n, count(*)::DOUBLE / any_value(r.r) AS share FROM lb JOIN r USING (text_id) GROUP BY 1, 2")
def mark_density(spark: SparkSession, d: str) -> DataFrame:
    return stats.mark_density(c.links_backward(_runs(spark, d)), 8)


@query("repetitiveness", WITH_ITEMS + "SELECT t.text_id, n, r.r AS r, n::DOUBLE / r.r AS ratio FROM t JOIN r USING (text_id)")
def repetitiveness(spark: SparkSession, d: str) -> DataFrame:
    return stats.repetitiveness(c.counters(items(spark, d)))


@query("pattern_base64", WITH + ", p AS (SELECT (row_number() OVER ()) - 1 AS pattern_id, unnest(['ZWQ=', 'YW4=', 'IGw=']) AS e), found AS (SELECT text_id, pattern_id FROM sa, p WHERE substr(h, 2 * sa + 1, 2 * octet_length(from_base64(e))) = hex(from_base64(e))) SELECT text_id, pattern_id::BIGINT AS pattern_id, count(*) AS occ FROM found GROUP BY ALL".replace("(SELECT (row_number() OVER ()) - 1 AS pattern_id, unnest(['ZWQ=', 'YW4=', 'IGw=']) AS e)", "(SELECT * FROM (VALUES (0, 'ZWQ='), (1, 'YW4='), (2, 'IGw=')) x(pattern_id, e))"))
def pattern_base64(spark: SparkSession, d: str) -> DataFrame:
    coded = spark.createDataFrame(list(enumerate(ENCODED)), "pattern_id long, encoded string")
    return _index(spark, d).count(decode_patterns(coded, True)).select("text_id", "pattern_id", "occ")


_SIDES = {"b": True, "f": False}
_RATES = (4, 8, 16, 32, 64, 128, 256, 512)


def _counted_sql(rates: tuple[int, ...]) -> str:
    """CTE counted: n, r, and kept samples and valid marks of both directions, by rate."""
    both = ", ".join(_greedy_sql(backward, rates) for backward in _SIDES.values())
    kept = " ".join(f"JOIN (SELECT s, text_id, count(*) AS kept_{x} FROM kept_{x} GROUP BY ALL) USING (s, text_id) JOIN (SELECT s, text_id, count(*) AS subs_{x}, count(*) FILTER (valid) AS valid_{x} FROM valid_{x} GROUP BY ALL) USING (s, text_id)" for x in _SIDES)
    listed = ", ".join(f"({s})" for s in rates)
    return f"{both}, counted AS (SELECT text_id, s, n, r, kept_b, kept_f, subs_b, subs_f, valid_b, valid_f FROM (SELECT rates.s, t.text_id, t.n, r.r FROM t JOIN r USING (text_id), (VALUES {listed}) AS rates(s)) {kept})"


@query("sampling_sweep", f"{_ITEMS}{_counted_sql(_RATES)} SELECT text_id, s::BIGINT AS s, n, r, kept_b, kept_f, valid_b, valid_f FROM counted")
def sampling_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweep(items(spark, d), _RATES)


@query("index_counters", f"{_ITEMS}{_counted_sql((8,))} SELECT text_id, n, r, s::INT AS s, kept_b AS b_kept_n, kept_f AS f_kept_n, valid_b AS b_valid, valid_f AS f_valid FROM counted")
def index_counters(spark: SparkSession, d: str) -> DataFrame:
    return TextIndex.build(items(spark, d), 8).counters()


_SIZE = {k: "r" for k in ("run_start", "head_tpos", "tail_tpos", "p_start", "p_size", "p_head", "p_tail")} | {"b_kept": "kept_b", "f_kept": "kept_f", "f_rows": "kept_f", "f_places": "kept_f", "f_heads": "kept_f", "sa": "n"}
_SIZE |= {k: "subs_b" for k in ("b_mark", "b_sample", "b_area")} | {k: "subs_f" for k in ("f_mark", "f_sample", "f_area", "f_link")}


@query("index_sizes", f"{_ITEMS}{_counted_sql((8,))} SELECT text_id, unnest([{', '.join(repr(k) for k in _SIZE)}, 'run_sym', 'p_sym']) AS part, unnest([{', '.join(f'4 * {v}' for v in _SIZE.values())}, r, r]) AS bytes FROM counted")
def index_sizes(spark: SparkSession, d: str) -> DataFrame:
    return TextIndex.build(items(spark, d), 8).sizes()


_BITS = {"tails": "3 * r", "heads_sampled_areas": "2 * r + 2 * kept_f + 3 * subs_f", "heads_psi_sampled": "2 * r + 2 * kept_f + 3 * subs_f", "sa_slice": "r + n"}


@query("index_bits", f"{_ITEMS}{_counted_sql((8,))} " + " UNION ALL ".join(f"SELECT '{k}' AS strategy, text_id, (({v}) * ceil(log2(n + 1)) + 8 * r)::DOUBLE / n AS bits FROM counted" for k, v in _BITS.items()))
def index_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bits a symbol that some strategies read."""
    index = TextIndex.build(items(spark, d), 8)
    return reduce(DataFrame.union, [index.bits_per_symbol(k).select(F.lit(k).alias("strategy"), "text_id", "bits") for k in _BITS])


@query("mark_quartiles", WITH_ITEMS + "SELECT text_id, count(*) AS n, min(mark) AS least, quantile_cont(mark, 0.25) AS q1, quantile_cont(mark, 0.5) AS median, quantile_cont(mark, 0.75) AS q3, max(mark) AS most FROM lb GROUP BY 1")
def mark_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.mark_quartiles(c.links_backward(c.bwt_runs(c.bwt(c.suffix_array(items(spark, d))))))


@query("mark_kde", WITH_ITEMS + "SELECT text_id, k / 20 AS x, round(sum(exp(-pow((k / 20 - mark / n) / 0.05, 2) / 2)) / count(*) / (0.05 * sqrt(2 * pi())), 9) AS density FROM lb JOIN t USING (text_id), range(0, 21) AS p(k) GROUP BY 1, 2")
def mark_kde(spark: SparkSession, d: str) -> DataFrame:
    texts = items(spark, d)
    marks = c.links_backward(c.bwt_runs(c.bwt(c.suffix_array(texts))))
    return stats.mark_kde(marks, texts.select("text_id", (F.length("body") + 1).cast("long").alias("n")), 20).withColumn("density", F.round("density", 9))
