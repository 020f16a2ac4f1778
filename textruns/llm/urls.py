"""URL filters (operator 8): redirect equivalence.

A URL's *name* is what it is without scheme, user, default port, fragment, a www/m/mobile/amp prefix of the host, tracking parameters and trailing slashes;
the host is lower-cased. Pages declare aliases: ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``, resolved against their URL; a table of
redirects (src, dst) may add more. Connected components over these edges are the equivalence classes. A name is blocked by its host (a host label
in ``BLOCK``) unless it is explicitly allowed (a prefix in ``ALLOW``); a blocked name blocks its whole class, except explicitly allowed names.

Defined cases: a NULL or blank URL has no name and passes; NULL html declares nothing; an alias of a page to itself does nothing; repeated
rows get a row each, alike; extra columns are ignored; empty tables give no rows. All declarations of a page count, with attribute values up to their
own closing delimiter and entities decoded. The SQL does the same for tags whose quotes are closed, and knows the entities of XML only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._job import arrow_map, materialize
from .components import components

BLOCK = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")
ALLOW = ("casino-win.example.org/en/",)

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def name_sql(url: str) -> str:
    """DuckDB SQL of a URL's name; NULL where there is none."""
    every = ", 'g'"

    def sub(s: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({s}, '{pattern}', '{by}'{every})"

    bare = sub(sub(f"trim({url})", "#.*$"), _SCHEME)
    host = sub(sub(sub(f"lower(regexp_extract({bare}, '^([^/?]*)', 1))", "^.*@"), ":(80|443)$"), "^(www|m|mobile|amp)[.]")
    rest = f"regexp_extract({bare}, '^[^/?]*(.*)$', 1)"
    path = sub(sub(rest, "[?].*$"), "/+$")
    query = sub(sub(f"concat('&', regexp_extract({rest}, '[?](.*)$', 1))", "&(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"), "^&")
    return f"nullif(concat({host}, {path}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END), '')"


def with_name(df: DataFrame, url: str, out: str) -> DataFrame:
    """``df`` with the name of a URL column, in steps, as its SQL in one expression would repeat itself beyond what is compiled."""

    def sub(c: Column, pattern: str, by: str = "") -> Column:
        return F.regexp_replace(c, pattern, by)

    bare = sub(sub(F.trim(F.col(url)), "#.*$"), _SCHEME)
    df = df.withColumn("_bare", bare)
    host = sub(sub(sub(F.lower(F.regexp_extract("_bare", "^([^/?]*)", 1)), "^.*@"), ":(80|443)$"), "^(www|m|mobile|amp)[.]")
    df = df.withColumns({"_host": host, "_rest": F.regexp_extract("_bare", "^[^/?]*(.*)$", 1)})
    query = sub(sub(F.concat(F.lit("&"), F.regexp_extract("_rest", "[?](.*)$", 1)), "&(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"), "^&")
    df = df.withColumns({"_path": sub(sub(F.col("_rest"), "[?].*$"), "/+$"), "_query": query})
    name = F.concat("_host", "_path", F.when(F.col("_query") == "", "").otherwise(F.concat(F.lit("?"), "_query")))
    return df.withColumn(out, F.when(name != "", name)).drop("_bare", "_host", "_rest", "_path", "_query")


def with_resolved(df: DataFrame, target: str, url: str, out: str) -> DataFrame:
    """``df`` with a declared target as an absolute URL; NULL where it is ''."""
    df = df.withColumn("_bare", F.regexp_replace(F.regexp_replace(F.trim(F.col(url)), "[#?].*$", ""), _SCHEME, ""))
    df = df.withColumns({"_host": F.regexp_extract("_bare", "^([^/]*)", 1), "_folder": F.regexp_replace(F.regexp_extract("_bare", "^[^/]*(.*)$", 1), "[^/]*$", "")})
    t, root = F.col(target), F.concat(F.lit("http://"), "_host")
    folder = F.when(F.col("_folder") == "", "/").otherwise(F.col("_folder"))
    whole = F.when(t == "", None).when(t.rlike(_SCHEME), t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(root, t)).otherwise(F.concat(root, folder, t))
    return df.withColumn(out, whole).drop("_bare", "_host", "_folder")


_W = r"[ \t\n\f\r]"
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>]*))"""
_NAME = r"""[^ \t\n\f\r"'>/=]+"""
_INNER = rf"""(?:={_W}*"[^"]*"|={_W}*'[^']*'|[^>])*"""
_TAG = re.compile(rf"<(link|meta)(?:[ \t\n\f\r/]({_INNER}+))?>", re.I | re.A)
_ATTRIBUTE = re.compile(rf"({_NAME}){_W}*={_W}*{_VALUE}")
_REFRESH_TARGET = rf"""[ \t\n\f\r0-9.]*[;,]?{_W}*(?:url{_W}*={_W}*)?(?:"([^"]*)|'([^']*)|(.*))"""
_REFRESH = re.compile(_REFRESH_TARGET, re.I | re.S | re.A)


def targets(page: str) -> list[str]:
    """Every target that a page declares, as canonical link or by refresh."""
    out = []
    for tag, body in _TAG.findall(page):
        given: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(body):
            given.setdefault(name.lower(), html.unescape("".join(values)))
        target = ""
        if tag.lower() == "link" and "canonical" in given.get("rel", "").lower().split():
            target = given.get("href", "")
        elif tag.lower() == "meta" and given.get("http-equiv", "").strip().lower() == "refresh":
            target = "".join(x or "" for x in _REFRESH.match(given.get("content", "")).groups())
        if target := re.sub(r"[\t\r\n]", "", target).strip():
            out.append(target)
    return out


def declarations(pages: DataFrame) -> DataFrame:
    """(url, target) for each declaration of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(u, t) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True) for t in targets(h)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["url", "target"])

    some = pages.select("url", "html").where(F.col("url").isNotNull() & F.col("html").rlike("(?i)<link|<meta"))
    return arrow_map(some, run, "url string, target string")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _groups_sql(value: str, pattern: str) -> str:
    """Whatever of a pattern's three groups matched."""
    return "concat(" + ", ".join(f"regexp_extract({value}, {_q(pattern)}, {i})" for i in (1, 2, 3)) + ")"


def _given_sql(name: str) -> str:
    """Value of a tag's first attribute of a name, decoded; '' if there is none."""
    raw = _groups_sql(f"list_filter(attributes, lambda a: lower(regexp_extract(a, {_q('^' + _NAME)})) = '{name}')[1]", f"^{_NAME}{_W}*={_W}*{_VALUE}")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#x27;", "''"), ("&#38;", "&"), ("&amp;", "&")):
        raw = f"replace({raw}, '{entity}', '{by}')"
    return f"coalesce({raw}, '')"


_ATTRIBUTES = rf"""{_NAME}{_W}*={_W}*(?:"[^"]*"|'[^']*'|[^ \t\n\f\r>]*)"""
#: CTEs in DuckDB: declared (url, target) of every declaration of every page.
DECLARED_SQL = f"""
tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), {_q(f"(?i)<(?:link|meta)(?:[ {chr(92)}t{chr(92)}n{chr(92)}f{chr(92)}r/]{_INNER})?>")})) AS tag FROM pages WHERE url IS NOT NULL),
attributed AS (SELECT url, lower(tag[2:5]) AS kind, regexp_extract_all(tag[6:-2], {_q(_ATTRIBUTES)}) AS attributes FROM tags),
given AS (SELECT url, kind, {_given_sql("rel")} AS rel, {_given_sql("href")} AS href, {_given_sql("http-equiv")} AS equiv, {_given_sql("content")} AS content FROM attributed),
declared AS (SELECT url, trim(regexp_replace(CASE WHEN kind = 'link' AND list_contains(string_split_regex(lower(rel), '[ {chr(92)}t{chr(92)}n{chr(92)}f{chr(92)}r]+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(trim(equiv)) = 'refresh' THEN {_groups_sql("content", "(?is)^" + _REFRESH_TARGET)} ELSE '' END, '[{chr(92)}t{chr(92)}r{chr(92)}n]', '', 'g')) AS target FROM given)
"""


def resolved_sql(target: str, url: str) -> str:
    """DuckDB SQL of a declared target as an absolute URL; NULL where it is ''."""
    every = ", 'g'"
    bare = f"regexp_replace(regexp_replace(trim({url}), '[#?].*$', ''{every}), '{_SCHEME}', ''{every})"
    host = f"regexp_extract({bare}, '^([^/]*)', 1)"
    folder = f"regexp_replace(regexp_extract({bare}, '^[^/]*(.*)$', 1), '[^/]*$', ''{every})"
    return f"""CASE WHEN {target} = '' THEN NULL WHEN regexp_matches({target}, '{_SCHEME}') THEN {target} WHEN starts_with({target}, '//') THEN concat('http:', {target})
    WHEN starts_with({target}, '/') THEN concat('http://', {host}, {target}) ELSE concat('http://', {host}, CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, {target}) END"""


def _blocked_sql(name: str) -> str:
    host = f"concat('.', regexp_extract({name}, '^([^/?]*)', 1), '.')"
    return "(" + " OR ".join(f"{host} LIKE '%.{label}.%'" for label in BLOCK) + ")" if BLOCK else "false"


def _allowed_sql(name: str, duck: bool = False) -> str:
    return "(" + " OR ".join(f"starts{'_' if duck else ''}with({name}, '{prefix}')" for prefix in ALLOW) + ")" if ALLOW else "false"


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, name, class (the smallest name of it), decision: allow, block or pass."""
    known = materialize(with_name(pages.select("page_id", "url"), "url", "name"), "names")
    declared = with_resolved(materialize(declarations(pages), "declared"), "target", "url", "target")
    edges = materialize(with_name(with_name(declared, "url", "a"), "target", "b").select("a", "b"), "edges")
    if redirects is not None:
        # written first: a filter moved below the names would repeat them
        edges = edges.union(materialize(with_name(with_name(redirects.select("src", "dst"), "src", "a"), "dst", "b").select("a", "b"), "redirects"))
    member = materialize(components(edges.dropna().where("a <> b")), "classes")
    bad = member.groupBy("component").agg(F.max(F.expr(f"{_blocked_sql('node')} AND NOT {_allowed_sql('node')}")).alias("bad"))
    classed = member.join(bad, "component").select(F.col("node").alias("name"), "component", "bad")
    out = known.select("page_id", "url", "name").join(classed, "name", "left")
    decision = f"CASE WHEN {_allowed_sql('name')} THEN 'allow' WHEN coalesce(bad, {_blocked_sql('name')}) THEN 'block' ELSE 'pass' END"
    return out.select("page_id", "url", "name", F.coalesce("component", "name").alias("class"), F.expr(decision).alias("decision"))


SQL = f"""
WITH RECURSIVE {DECLARED_SQL.strip()},
known AS (SELECT page_id, url, {name_sql("url")} AS name FROM pages),
edges AS (SELECT {name_sql("url")} AS a, {name_sql(f"({resolved_sql('target', 'url')})")} AS b FROM declared),
linked AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM linked UNION SELECT r.node, e.b FROM reach r JOIN linked e ON r.other = e.a),
member AS (SELECT node, min(other) AS component, bool_or({_blocked_sql("other")} AND NOT {_allowed_sql("other", True)}) AS bad FROM reach GROUP BY node)
SELECT page_id, url, name, coalesce(component, name) AS class,
       CASE WHEN {_allowed_sql("name", True)} THEN 'allow' WHEN coalesce(bad, {_blocked_sql("name")}) THEN 'block' ELSE 'pass' END AS decision
FROM known LEFT JOIN member ON name = node
"""
