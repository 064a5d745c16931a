"""URL filters with redirect equivalence.

A rule (action, host, path) fits its host and all subdomains where the path
starts with the rule's; the longest rule wins. URLs that redirect to each other
or name one canonical address are one thing: components over those links carry
a block to aliases without a rule of their own, and an explicit allow on any
alias comes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .stage import Scratch

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_AZ)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What makes two URLs the same: host, path (at least ``/``) and query, without scheme and fragment."""
    path = path_of(url)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), _query_of(url)))


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), whole).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """A link on a page of that URL, or below that ``base``, as an absolute URL; null for other schemes (``mailto:``) and empty links."""
    scheme = F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit(":"))
    root = F.concat(scheme, F.lit("//"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), base)
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .when(link.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), rest))
    )


def _tags(html: Column, pattern: str, value: str) -> Column:
    """The values that a pattern finds in all tags of another one."""
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda tag: F.regexp_extract(tag, value, 1))


def _fixed(value: Column) -> Column:
    """Generator of one row with the value. The planner puts a plain expression in place of each of its uses when it moves a
    filter; steps that each use the one before several times then grow to a plan that fills the driver's memory."""
    return F.explode(F.array(value))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) addresses: a page and where its canonical links and its refreshes lead.

    Links are resolved against the page's URL or its ``base``; fragments lead to
    the page itself, and comments have no links.
    """
    html = F.col(html_col)
    some = pages.where(F.col(url_col).contains("://") & (F.lower(html).contains("canonical") | F.lower(html).contains("refresh")))
    some = some.select(F.col(url_col).alias("u"), _fixed(F.regexp_replace(html, r"(?s)<!--.*?(-->|$)", "")).alias("h"))
    href = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    canonical = _tags(F.col("h"), r"""(?is)<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>""", href)
    refresh = _tags(F.col("h"), r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""")
    own_base = F.element_at(F.concat(_tags(F.col("h"), r"(?is)<base\b[^>]*>", href), F.array(F.lit(""))), 1)
    links = some.select("u", "h", F.explode(F.concat(canonical, refresh)).alias("link")).where("link <> ''")
    links = links.select("u", F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link"), _fixed(own_base).alias("own"))
    links = links.select("u", "link", _fixed(F.coalesce(resolve(F.col("u"), F.col("own")), F.col("u"))).alias("base"))
    links = links.select("u", _fixed(resolve(F.col("base"), F.col("link"))).alias("target"))
    ends = links.select("target", _fixed(address(F.col("u"))).alias("a")).select("a", _fixed(address(F.col("target"))).alias("b"))
    return ends.where("a IS NOT NULL AND b IS NOT NULL")


def apply_rules(urls: DataFrame, rules: DataFrame, key: str, host: str, path: str) -> DataFrame:
    """(key, rule, action) of the longest rule for each key that has one.

    Every host is joined by its suffixes, so that any number of rules is one
    equi-join. Rules of equal length: the longer host wins, then block.
    """
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = urls.where(F.col(host) != "").select(F.col(key), F.col(path).alias("__path"), F.explode(suffixes).alias("__suffix"))
    known = rules.select(F.col("action").alias("__action"), F.col("host").alias("__host"), F.col("path").alias("__rule_path"))
    fits = wide.join(known, F.col("__suffix") == F.col("__host")).where("startswith(__path, __rule_path)")
    rank = F.struct(F.length(F.concat("__host", "__rule_path")), F.length("__host"), F.col("__action") == "block")
    best = fits.groupBy(key).agg(F.max_by(F.struct(F.concat("__host", "__rule_path").alias("rule"), F.col("__action").alias("action")), rank).alias("w"))
    return best.select(key, "w.rule", "w.action")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, host, path, rule, verdict, aliases) for every row of ``pages``.

    The verdict is the page's own rule's; without one, allow if an alias has an
    allow rule, else block if an alias has a block rule, else allow. aliases is
    the number of addresses in the page's component (1 without links). Null
    URLs, or URLs without ``://``, have empty host and path and are allowed.
    Null html has no links. Repeated rows are rows of their own; other columns
    are ignored, whatever their names. Empty tables give an empty result, and
    without rules everything is allowed.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    base = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    edges = scratch.save(link_edges(base, "u", "h").where("a <> b").distinct(), "edges")
    parts = connected_components(edges, "a", "b", scratch)
    nodes = parts.select("node", "component", F.concat(F.lit("http://"), "node").alias("u"))
    nodes = nodes.select("node", "component", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    ruled = nodes.join(apply_rules(nodes, rules, "node", "host", "path"), "node", "left")
    spread = ruled.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allows"), F.max(F.col("action") == "block").alias("blocks"), F.count("*").alias("aliases"))
    spread = parts.join(spread, "component").select("node", "allows", "blocks", "aliases")
    urls = base.select("u").where("u IS NOT NULL").distinct().select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), address(F.col("u")).alias("node"))
    best = apply_rules(urls, rules, "u", "host", "path")
    known = urls.join(best, "u", "left").join(spread, "node", "left")
    judged = known.select(
        F.col("u").alias("__u"),
        "rule",
        F.coalesce("action", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("aliases", F.lit(1).cast("long")).alias("aliases"),
    )
    out = base.drop("h").join(judged, F.col("u") == F.col("__u"), "left")
    return out.select(
        F.col("i").alias(id_col),
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("aliases", F.lit(1).cast("long")).alias("aliases"),
    )
