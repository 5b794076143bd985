"""URL block lists with redirect equivalence (DataFrame operations only).

Urls that lead to the same page share their fate.  The links are canonical links and refresh
redirects found in the pages, redirects from a table if one is given, and the
common spellings of one address (scheme, ``www.``, fragment, tracking parameters, last slash).
Connected components over these links carry a block to every alias; an explicit
allow goes before a block that was only carried over.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Query parameters that say where a visitor came from, not which page is meant.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def plain_spelling(url: Column) -> Column:
    """One spelling for the addresses that sites redirect to each other as a rule."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(
        p, F.lit(f"^({TRACKING})(=|$)"))), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    return F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def decoded(value: Column) -> Column:
    """An attribute's value with its character references replaced; unknown ones stay as they are."""
    names = F.str_to_map(F.lit("\x01".join(f"&{k}\x02{v}" for k, v in sorted(html5.items()))), F.lit("\x01"), F.lit("\x02"))

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, "^&#[xX]?0*([0-9a-fA-F]{1,7});?$", 1)
        code = F.conv(digits, 16, 10).cast("long")
        code = F.when(F.regexp_like(part, F.lit("^&#[xX]")), code).otherwise(F.conv(digits, 10, 10).cast("long"))
        valid = (digits != "") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.length(part) < 2, part).when(~part.startswith("&"), part).when(valid, letter).when(
            part.startswith("&#"), part).otherwise(F.coalesce(F.try_element_at(names, part), part))

    # names without a semicolon count unless a letter, digit or equals sign follows
    parts = F.regexp_extract_all(value, F.lit(
        "(?s)&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|[^&]+|&"), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(value)


def _attribute(tag: Column, name: str) -> Column:
    # the value of a tag's attribute, quoted or not
    got = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.trim(decoded(F.regexp_replace(got, "^[\"']|[\"']$", "")))


def page_targets(html: Column) -> Column:
    """Addresses that a page names as its canonical form or sends its visitors on to."""
    links = F.filter(F.regexp_extract_all(html, F.lit("(?is)<link\\b[^>]*>"), F.lit(0)),
                     lambda t: F.lower(_attribute(t, "rel")) == "canonical")
    metas = F.filter(F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*>"), F.lit(0)),
                     lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    canonical = F.transform(links, lambda t: _attribute(t, "href"))
    refresh = F.transform(metas, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), "(?is)url\\s*=\\s*(.*)$", 1)))
    return F.array_distinct(F.filter(F.concat(canonical, refresh), lambda x: x != ""))


def _without_dots(address: Column) -> Column:
    """A full address without the segments ``.`` and ``..`` of its path."""
    pattern = "(?s)^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$"
    path = F.regexp_extract(address, pattern, 2)
    segments = F.split(path, "/")
    left = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), F.array().cast("array<string>"), lambda kept, s: F.when(
        s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s))))
    end = F.when(F.regexp_like(path, F.lit("/\\.{1,2}$")) & (F.size(left) > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(F.regexp_extract(address, pattern, 1), F.lit("/"), F.array_join(left, "/"), end, F.regexp_extract(address, pattern, 3))
    return F.when(F.regexp_like(path, F.lit("/\\.{1,2}(/|$)")), plain).otherwise(address)


def resolved(url: Column, target: Column) -> Column:
    """A target as a full address, seen from the page at ``url``."""
    scheme = F.substring_index(url, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "^.*/", 0)
    return _without_dots(
        F.when(F.regexp_like(target, F.lit("^[^:/?#]+://")), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .when(target.startswith("#"), F.concat(F.substring_index(url, "#", 1), target))
        .otherwise(F.concat(site, F.when(folder != "", folder).otherwise(F.lit("/")), target)))


def rules_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def match_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``nodes(url)`` with the longest rule that fits each: ``url, rule, rule_verdict``; others are left out.

    A host is looked up under each of its parent domains, so the rule list can be of any length.
    Of rules of one length, the longer host, then allow before block, decides.
    """
    labels = F.split(F.col("host"), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    asked = nodes.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    asked = asked.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    r = rules.where("rule_verdict in ('allow', 'block')").select(
        F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", "rule_verdict").distinct()
    fit = asked.join(r, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("m"),
                          (F.col("rule_verdict") == "allow").alias("a"), F.concat("rule_host", "rule_path").alias("rule"),
                          "rule_verdict"))
    return fit.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id",
          url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """The verdict on every page's url.

    Returns one row per row of ``pages``: the id column, ``host``, ``path``, ``rule`` (the rule that fits, else
    null), ``verdict``, ``decided_by`` (``rule``, ``alias``, ``allowed alias`` or ``none``) and ``alias_of``
    (smallest url of the component).

    The url's own rule decides.  Without one: ``allow`` if an alias is explicitly allowed, else ``block`` if an alias is
    blocked, else ``allow``.  A null url, or one without ``://``, has an empty host and path, no alias and no rule: it is
    allowed.  Null html names no target.  Repeated rows get the same verdict.  ``redirects(src, dst)`` may
    add links; null ends are ignored.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = pages.sparkSession
    t = Scratch(spark, "url-filter")
    if not isinstance(rules, DataFrame):
        rules = rules_frame(spark, rules)
    url = F.col("url")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                       (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("html"))
    named = src.where(F.contains(url, F.lit("://")))
    links = named.select(url.alias("u"), F.explode(page_targets(F.col("html"))).alias("to")).select(
        "u", resolved(F.col("u"), F.col("to")).alias("v"))
    spelled = named.select(url.alias("u"), plain_spelling(url).alias("v"))
    edges = links.unionByName(spelled)
    if redirects is not None:
        more = redirects.select(F.col("src").alias("u"), F.col("dst").alias("v")).where(
            F.contains("u", F.lit("://")) & F.contains("v", F.lit("://")))
        edges = edges.unionByName(more).unionByName(more.select(
            F.explode(F.array("u", "v")).alias("u")).select("u", plain_spelling(F.col("u")).alias("v")))
    # a target's spelling joins it to the other spellings of that address
    edges = edges.unionByName(links.select(F.col("v").alias("u"), plain_spelling(F.col("v")).alias("v")))
    edges = edges.where("u <> v").distinct()
    roots = connected_components(edges, t)
    # every url that takes part, alone or in a component, once
    nodes = named.select("url").unionByName(roots.select(F.col("node").alias("url"))).distinct()
    ruled = t.put(nodes.join(match_rules(nodes, rules), "url", "left")
                  .join(roots.withColumnRenamed("node", "url"), "url", "left")
                  .withColumn("root", F.coalesce("root", "url")))
    said = (ruled.where("rule is not null").groupBy("root")
            .agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("some_allow")))
    fate = ruled.join(said, "root", "left").select(
        "url", "rule", F.col("root").alias("alias_of"),
        F.when(F.col("rule").isNotNull(), F.col("rule_verdict"))
        .when(F.col("some_allow") == 0, "block").otherwise("allow").alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("some_allow") == 0, "alias")
        .when(F.col("some_allow") == 1, "allowed alias").otherwise("none").alias("decided_by"))
    out = src.select("id", "url").join(fate, "url", "left")
    return out.select(F.col("id").alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), "rule",
                      F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                      F.coalesce("decided_by", F.lit("none")).alias("decided_by"), "alias_of")
