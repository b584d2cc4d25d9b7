"""URL filtering with redirect equivalence, in DataFrame functions only.

Rules decide hosts and paths, the longest first. Pages that name each other by a canonical link or a redirect
are the same resource: connected components over these edges pass a block on to all aliases, but for pages
that a rule allows explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import connected_components, lower_ascii
from blendwise.session import durable

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for NULL or without it."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL if none does; at equal length allow wins.

    The rules are part of the plan: a list of the size that people maintain by hand.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    ]
    return F.coalesce(*fits)


def query_of(url: Column) -> Column:
    """The query string with its question mark, up to any fragment."""
    return F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)


def alias_key(url: Column) -> Column:
    """Host, path and query without default port and the path's final slash: what two spellings of one address share."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.xxhash64(F.concat(host, path, query_of(url))))


def named_targets(url: Column, html: Column) -> Column:
    """Absolute addresses in canonical links and refresh redirects; comments and scripts do not count."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    found = F.transform(
        tags,
        lambda t: F.when(
            t.rlike(r"(?i)^<link\b") & t.rlike(r"(?i)\brel\s*=\s*[\"']?\s*canonical\b"),
            F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
        ).when(
            t.rlike(r"(?i)^<meta\b") & t.rlike(r"(?i)http-equiv\s*=\s*[\"']?\s*refresh\b"),
            F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
        ),
    )
    scheme = F.regexp_extract(url, r"^[^:/?#]+", 0)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    page = F.concat(scheme, F.lit("://"), host_of(url), path_of(url))
    whole = F.transform(
        # Ampersands between parameters are often escaped in attributes.
        F.transform(
            F.filter(found, lambda a: F.coalesce(a, F.lit("")) != ""),
            lambda a: F.regexp_replace(a, r"(?i)&(?:amp|#0*38|#x0*26);", "&"),
        ),
        lambda a: F.when(a.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), a)
        .when(a.startswith("//"), F.concat(scheme, F.lit(":"), a))
        .when(a.startswith("?"), F.concat(page, a))
        .when(a.startswith("#"), F.concat(page, query_of(url), a))
        .when(a.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), a))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(url), F.when(folder == "", "/").otherwise(folder), a)),
    )
    none = F.array().cast("array<string>")
    return F.when(html.rlike(r"(?i)canonical|refresh"), whole).otherwise(none)


def judge_urls(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict, propagated per page.

    ``redirects`` (from_url, to_url) adds edges to those found in the pages. A page takes the verdict of its rule;
    without one it is blocked if any address in its component, page or target, is blocked by a rule, and
    allowed otherwise. NULL urls and such without ``://`` have empty host and path, no rule and no aliases; NULL pages
    name no targets. Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        alias_key(url).alias("node"),
        F.coalesce(named_targets(url, F.col(html_col)), F.array().cast("array<string>")).alias("targets"),
    )
    rows = durable(rows.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules)))  # pages are read once
    edges = rows.select(F.col("node").alias("a"), F.explode("targets").alias("to"))
    if redirects is not None:
        edges = edges.union(redirects.select(alias_key(F.col("from_url")), "to_url"))
    edges = durable(
        edges.select(
            "a",
            alias_key(F.col("to")).alias("b"),
            matching_rule(host_of(F.col("to")), path_of(F.col("to")), rules)["verdict"].alias("verdict"),
        ).where("a IS NOT NULL AND b IS NOT NULL")
    )
    roots = connected_components(edges)
    blocked = rows.where("own.verdict = 'block'").select("node").union(edges.where("verdict = 'block'").select("b")).distinct()
    hit = blocked.join(roots, "node").select("root").distinct()
    hit = roots.join(hit, "root", "left_semi").select(F.col("node").alias("hit"))
    return rows.join(hit, F.col("node") == F.col("hit"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        (F.col("hit").isNotNull() & F.col("own").isNull()).alias("propagated"),
    )
