"""URL filters by redirect equivalence, in DataFrame operations only.

A rule decides the URLs that it fits; the longest rule wins. Decisions then spread to aliases: every URL has a key (its
canonical form), redirects (``meta refresh``) and canonical links give edges between keys, and connected components over
those edges are the aliases of one another. A URL that no rule fits takes an allow from its component if any member is
explicitly allowed, else a block if any is blocked, else the default.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, scratch, staged, table

Rule = tuple[str, str, str]
#: (verdict, host, path prefix)
RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MAX_RULES = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that never change a page.
_TRACKING = r"(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&#]*"
_REFRESH = r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh)[^>]*content\s*=\s*[\"'][^\"'>]*url\s*=\s*([^\"'>]+)"
_CANONICAL = r"(?is)<link\b(?=[^>]*rel\s*=\s*[\"']?canonical)[^>]*href\s*=\s*[\"']?([^\"'\s>]+)"


def with_parts(df: DataFrame, url: str, tag: str = "") -> DataFrame:
    """``df`` with host_, path_ and key_ of a URL column (each name behind ``tag``).

    host_: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path_: from there up to ``?``,
    ``#`` or the end; both empty for null and for no ``://``. key_: the canonical form, which has no ``www.``, no last
    ``/`` or ``.html`` and no tracking parameters; null for null and for no ``://``. Steps are columns of their own, so
    no expression is evaluated twice.
    """
    rest, query, name, trail = (f"{tag}{x}_" for x in ("rest", "query", "name", "trail"))
    host, path, key = (f"{tag}{x}_" for x in ("host", "path", "key"))
    at = F.locate("://", F.col(url))
    df = df.withColumn(rest, F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))))
    df = df.withColumns(
        {
            host: F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit("")),
            path: F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
            query: F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), _TRACKING, ""),
        }
    )
    df = df.withColumns({name: F.regexp_replace(host, r"^www\.", ""), trail: F.regexp_replace(path, r"(\.html?)?/*$", ""), query: F.regexp_replace(query, "^&+", "")})
    df = df.withColumn(key, F.when(F.col(rest).isNotNull(), F.concat(name, trail, F.when(F.col(query) != "", F.concat(F.lit("?"), query)).otherwise(""))))
    return df.drop(rest, query, name, trail)


def matched(pages: DataFrame, rules: list[Rule], url: str) -> DataFrame:
    """``pages`` with host_, path_, and rule_ (action, text) of the longest rule that fits, else null.

    Rules are a parameter of at most MAX_RULES entries. Equal length cannot fit twice unless a rule is listed twice; an
    allow wins then.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    df = with_parts(pages, url)
    if not rules:
        return df.withColumn("rule_", F.lit(None).cast("struct<size:int,allow:boolean,text:string>"))
    known = F.array(
        *(F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("text"), F.lit("." + h).alias("dot"), F.lit(p).alias("path")) for v, h, p in rules)
    )
    dotted = F.concat(F.lit("."), F.col("host_"))
    fits = F.filter(known, lambda r: dotted.endswith(r["dot"]) & F.col("path_").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"), r["text"].alias("text"))))
    return df.withColumn("rule_", best)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between the keys of pages and of what they redirect to or declare as canonical."""
    # a cheap test keeps both patterns off pages that hold neither
    rows = pages.select(F.col(url).alias("from_"), F.col(html).alias("html_")).where(F.col("html_").rlike("(?i)canonical|refresh"))
    with scratch(pages.sparkSession) as keep:
        out = _links(rows)
        keep(out)
    return out.where("a != b")


def _links(rows: DataFrame) -> DataFrame:
    found = F.array(F.regexp_extract("html_", _REFRESH, 1), F.regexp_extract("html_", _CANONICAL, 1))
    # tables in between, else filters that the optimizer moves down repeat every step of with_parts in each condition
    rows = staged(rows.select("from_", F.explode(found).alias("link_")), "links").where("link_ != ''")
    rows = with_parts(rows, "from_")
    link = F.trim(F.regexp_replace("link_", "&amp;", "&"))
    site = F.concat(F.lit("x://"), "host_")
    to = (
        F.when(F.col("link_").contains("://"), link)
        .when(F.col("link_").startswith("//"), F.concat(F.lit("x:"), link))
        .when(F.col("link_").startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.regexp_replace("path_", "[^/]*$", ""), link))
    )
    rows = with_parts(rows.select("key_", to.alias("to_")), "to_", "to_")
    return staged(rows.select(F.col("key_").alias("a"), F.col("to_key_").alias("b")), "links")


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, default: str = "allow", edges: DataFrame | None = None) -> DataFrame:
    """``pages`` with the columns host_, path_, rule_ (text), alias_ (component) and verdict_.

    ``redirects`` adds rows (src, dst) of URLs to what the pages' own html tells, ``edges`` rows (a, b) that ``links`` has made; a null or malformed URL has no key, so it
    has no aliases and takes its own rule or the default. Repeated rows are judged alike. Empty tables give no rows. The
    decision of each key is pre-aggregated (a partial maximum), so a key with a third of all rows costs one row after the
    shuffle; the join back has one row per key on its right, and adaptive execution splits hot keys. Columns of ``pages``
    stay, whatever their names, unless they end in ``_`` like those added.
    """
    df = matched(pages, rules, url)
    told = df.where("key_ is not null and rule_ is not null").groupBy("key_").agg(F.max(F.col("rule_.allow").cast("int")).alias("allow_"), F.max((~F.col("rule_.allow")).cast("int")).alias("block_"))
    known = [links(pages, url, html)] if html else []
    if redirects is not None:
        rows = with_parts(with_parts(redirects.select("src", "dst"), "src", "a_"), "dst", "b_")
        known.append(staged(rows.select(F.col("a_key_").alias("a"), F.col("b_key_").alias("b")), "links"))
    if edges is not None:
        known.append(edges)
    if known:
        groups = components(functools.reduce(DataFrame.unionByName, known))
        told = told.withColumnRenamed("key_", "node").join(groups, "node", "left").withColumn("alias_", F.coalesce("component", "node"))
        told = told.groupBy("alias_").agg(F.max("allow_").alias("allow_"), F.max("block_").alias("block_"))
        df = df.join(groups.withColumnsRenamed({"node": "key_", "component": "alias_"}), "key_", "left").withColumn("alias_", F.coalesce("alias_", "key_"))
    else:
        told, df = told.withColumnRenamed("key_", "alias_"), df.withColumn("alias_", F.col("key_"))
    df = df.join(told, "alias_", "left")
    own = F.when(F.col("rule_.allow"), "allow").when(~F.col("rule_.allow"), "block")
    spread = F.when(F.col("allow_") == 1, "allow").when(F.col("block_") == 1, "block")
    return df.withColumns({"verdict_": F.coalesce(own, spread, F.lit(default)), "rule_": F.col("rule_.text")}).drop("key_", "allow_", "block_")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; edges come from their html, and the joins then shuffle addresses and not pages."""
    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages.select("page_id", "url"), RULES, html=None, edges=links(pages))
    return out.select("page_id", F.col("host_").alias("host"), F.col("path_").alias("path"), F.col("rule_").alias("rule"), F.col("verdict_").alias("verdict"))


def _sql() -> str:
    """DuckDB SQL for ``op1_url_filters``. Its expressions have no look-ahead, so either order of attributes is a pattern."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    link = "coalesce(nullif(regexp_extract(html, '(?is){0}', 1), ''), regexp_extract(html, '(?is){1}', 1))"
    canonical = link.format("""<link\\b[^>]*rel\\s*=\\s*["'']?canonical[^>]*href\\s*=\\s*["'']?([^"''\\s>]+)""", """<link\\b[^>]*href\\s*=\\s*["'']?([^"''\\s>]+)[^>]*rel\\s*=\\s*["'']?canonical""")
    refresh = link.format("""<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh[^>]*content\\s*=\\s*["''][^"''>]*url\\s*=\\s*([^"''>]+)""", """<meta\\b[^>]*content\\s*=\\s*["''][^"''>]*url\\s*=\\s*([^"''>]+)[^>]*http-equiv\\s*=\\s*["'']?refresh""")

    def parts(source: str, url: str, keep: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END"
        return f"""SELECT {keep}, host, path, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html?)?/*$', '')
            || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
            regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '{_TRACKING}', '', 'g'), '^&+', '') AS query
            FROM (SELECT *, {rest} AS rest FROM {source}))"""

    return f"""WITH RECURSIVE p AS MATERIALIZED ({parts("pages", "url", "page_id, url, html")}),
        found AS (SELECT key, host, path, trim(replace(x, '&amp;', '&')) AS x FROM (SELECT key, host, path, unnest([{refresh}, {canonical}]) AS x FROM p) WHERE x <> ''),
        target AS (SELECT key AS a, CASE WHEN x LIKE '%://%' THEN x WHEN x LIKE '//%' THEN 'x:' || x WHEN x LIKE '/%' THEN 'x://' || host || x
            ELSE 'x://' || host || regexp_replace(path, '[^/]*$', '') || x END AS url FROM found),
        edge AS MATERIALIZED (SELECT a, key AS b FROM ({parts("target", "url", "a")}) WHERE a <> key),
        both_ AS MATERIALIZED (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
        fit AS MATERIALIZED (SELECT page_id, url, key, host, path, r.verdict, r.text FROM p LEFT JOIN (SELECT page_id AS id, url AS u, arg_max(verdict, length(h || f)) AS verdict, arg_max(h || f, length(h || f)) AS text
            FROM p JOIN (VALUES {rules}) t(verdict, h, f) ON ends_with('.' || host, '.' || h) AND starts_with(path, f) GROUP BY page_id, url) r ON page_id = r.id AND url = r.u),
        reach(node, member) AS (SELECT DISTINCT key, key FROM p WHERE key IS NOT NULL UNION SELECT node, b FROM reach JOIN both_ ON member = a),
        told AS (SELECT node, max((verdict = 'allow')::INT) AS allowed, max((verdict = 'block')::INT) AS blocked FROM reach JOIN fit ON member = key GROUP BY node)
        SELECT page_id, host, path, text AS rule, coalesce(verdict, CASE WHEN allowed = 1 THEN 'allow' WHEN blocked = 1 THEN 'block' ELSE 'allow' END) AS verdict
        FROM fit LEFT JOIN told ON key = node"""


OP1_SQL = _sql()
