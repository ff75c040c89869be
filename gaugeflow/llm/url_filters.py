"""URL filters with redirect equivalence, in DataFrame functions only.

Rules name a host and a path; the longest rule that fits a URL decides.  A URL
that no rule fits takes the decision of its aliases: redirects and canonical
links are edges, the components of which are found by a distributed algorithm.
A component with an explicitly allowed member is allowed, else one with a blocked
member is blocked; all else is allowed.

Rules are grouped by host, so a URL is joined with one row per suffix of its host;
only the distinct hosts are matched.  An alias is its URL without scheme and
fragment, its host in lower case.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule, has no aliases and is allowed; of equal rules the allowing one
counts; rules without a host are ignored; repeated rows are judged alike; all
canonical and refresh tags of a page count, relative targets are resolved against
its URL, and targets of schemes without ``://`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.components import connected_components
from gaugeflow.llm.runtime import materialize, sided

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_of(url: Column) -> Column:
    """The URL without scheme and fragment, its host in lower case; null without ``://``."""
    return F.when(_rest(url).isNotNull(), F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


#: Character references of URLs in HTML, the ampersand last, so that nothing is decoded twice.
_REFERENCES = [
    (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;|&#0*34;|&#x0*22;", '"'), (r"(?i)&apos;|&#0*39;|&#x0*27;", "'"),
    (r"(?i)&amp;|&#0*38;|&#x0*26;", "&"),
]


def _decoded(link: Column) -> Column:
    for pattern, char in _REFERENCES:
        link = F.regexp_replace(link, pattern, char)
    return link


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, its segments ``.`` and ``..`` resolved."""
    parts = F.slice(F.split(path, "/", -1), 2, F.length(path) + 1)
    step = lambda done, part: (
        F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))
    )
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a last segment of dots leaves a folder
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolved(source: Column, link: Column) -> Column:
    """The URL that ``link`` on the page ``source`` names; null if it names none with ``://``."""
    scheme = F.regexp_extract(source, r"^[^:]*:", 0)
    site = F.concat(scheme, F.lit("//"), host_of(source))
    path, query = path_of(source), F.regexp_extract(_rest(source), r"^[^/?#]*[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(link, r"^[^?#]*", 0)
    behind = F.substring(link, F.length(own) + F.lit(1), F.length(link))
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/", 0), F.lit("")), F.lit("/"))
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), link)
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), None)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, _without_dots(own), behind))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(site, path, query, link))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), behind))
    )


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (source, target) of URLs: all canonical links and refresh redirects in the HTML."""
    tags = lambda pattern: F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(0))
    canonical = F.transform(
        tags(r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""),
        lambda tag: F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    refresh = F.transform(
        tags(r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""),
        lambda tag: F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    url = F.col(url_col)
    found = pages.where(_rest(url).isNotNull()).select(
        url.alias("source"), F.explode(F.concat(canonical, refresh)).alias("link")
    )
    found = found.where("link <> ''").select("source", _decoded(F.col("link")).alias("link"))
    return found.select("source", resolved(F.col("source"), F.col("link")).alias("target")).where("target IS NOT NULL")


def apply_rules(urls: DataFrame, rules: DataFrame, *, url_col: str = "url") -> DataFrame:
    """``urls`` with ``__host``, ``__path`` and ``__rule``, a struct (rule, action) or null.

    ``rules`` has action (allow or block), host and path.
    """
    named = rules.where("host IS NOT NULL AND host <> ''")
    by_host = materialize(
        named.select(
            F.col("host").alias("__suffix"),
            F.struct(
                (F.length("host") + F.length(F.coalesce("path", F.lit("")))).alias("length"),
                F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"),
                F.coalesce("path", F.lit("")).alias("path"),
                F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
            ).alias("r"),
        )
        .groupBy("__suffix")
        .agg(F.collect_set("r").alias("rs")),
        "rules",
    )
    parsed = urls.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    labels = F.split(F.col("__host"), r"\.")
    # no rule has more labels, so longer suffixes can't match
    deepest = by_host.agg(F.max(F.size(F.split("__suffix", r"\.")))).first()[0] or 1
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    hosts = parsed.select("__host").where("__host <> ''").distinct().withColumn("__suffix", F.explode(suffixes))
    known = materialize(
        hosts.join(sided(by_host), "__suffix").groupBy("__host").agg(F.flatten(F.collect_list("rs")).alias("__rules")), "known-hosts"
    )
    fitting = F.filter("__rules", lambda r: F.startswith(F.col("__path"), r.path))
    best = F.array_max(fitting)
    return (
        parsed.join(sided(known), "__host", "left")
        .withColumn(
            "__rule",
            F.when(
                best.isNotNull(),
                F.struct(best.rule.alias("rule"), F.when(best.allow == 1, "allow").otherwise("block").alias("action")),
            ),
        )
        .drop("__rules")
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``redirects`` (source, target: URLs) are edges besides the pages' own links.
    """
    links = page_links(pages, url_col=url_col, html_col=html_col)
    if redirects is not None:
        links = links.union(redirects.select("source", "target"))
    links = materialize(links, "links")
    light = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    judged = apply_rules(light, rules, url_col="__url")
    own = F.col("__rule.action")
    if links.isEmpty():
        verdict = F.coalesce(own, F.lit("allow"))
    else:
        edges = links.select(alias_of(F.col("source")).alias("a"), alias_of(F.col("target")).alias("b"))
        parts = connected_components(edges, local_edges=0)
        # the explicit decisions of all URLs in a component, those of pages and of link ends
        ends = links.select(F.explode(F.array("source", "target")).alias("__url")).distinct()
        decided = (
            apply_rules(light.select("__url").union(ends).distinct(), rules, url_col="__url")
            .where("__rule IS NOT NULL")
            .select(alias_of(F.col("__url")).alias("node"), F.col("__rule.action").alias("action"))
            .join(parts, "node")
            .groupBy("component")
            .agg(F.max(F.when(F.col("action") == "allow", "allow")).alias("allow"), F.max("action").alias("any"))
            .select("component", F.coalesce("allow", "any").alias("__inherited"))
        )
        of_node = parts.join(decided, "component").select(F.col("node").alias("__alias"), "__inherited")
        judged = judged.withColumn("__alias", alias_of(F.col("__url"))).join(of_node, "__alias", "left")
        verdict = F.coalesce(own, F.col("__inherited"), F.lit("allow"))
    return judged.select(
        "page_id",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        verdict.alias("verdict"),
    )
