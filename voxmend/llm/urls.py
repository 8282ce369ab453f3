"""URL filters: rules by host and path, and redirect equivalence that carries blocks to aliases. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.llm.common import only, written
from voxmend.llm.components import components

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def alias_key(url: Column) -> Column:
    """Host, path and query: what names one resource under http and https, with or without a fragment. Null if no host."""
    host = host_of(url)
    query = F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), F.coalesce(query, F.lit(""))))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and every subdomain, if the
    path starts with the rule's; of rules of one length, the one with the longer host wins. The rules are a short list
    given by the caller, tried from the longest down in one expression without a join."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path that starts with /, its . and .. segments carried out."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)))
    last = F.element_at(segments, -1)

    def one(kept: Column, s: Column) -> Column:
        return F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), one)
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolved(url: Column, target: Column) -> Column:
    """target as a link on the page url. Null for an empty one, a bare fragment, and schemes without :// (mailto:)."""
    on_host = F.concat(F.lit("http://"), host_of(url))
    base = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    path, rest = F.regexp_extract(target, "(?s)^[^?#]*", 0), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(base, "[^/]*$", "")
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(on_host, without_dots(path), rest))
        .when(target.startswith("?"), F.concat(on_host, base, target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(on_host, without_dots(F.concat(folder, path)), rest))
    )


#: What holds no tags: comments, and elements whose content is text.
_NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript|iframe|xmp)\b.*?(?:</\1\s*>|\z)"
_NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&"}


def decoded(text: Column) -> Column:
    """text with its numeric character references and the five named ones of XML decoded, the ampersand's last."""

    def number(so_far: Column, reference: Column) -> Column:
        digits = F.regexp_extract(reference, "(?i)^&#x?([0-9a-f]+);?$", 1)
        code = F.when(reference.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
        known = (F.length(digits) < 8) & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.replace(so_far, reference, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(so_far)

    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&#(?:x[0-9a-f]+|[0-9]+);"), F.lit(0)))
    out = F.when(F.contains(text, F.lit("&#")), F.aggregate(numbers, text, number)).otherwise(text)
    for name, letter in _NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): all canonical links and refresh redirects in the tags of pages (url, html), resolved against the
    page's url. Comments and the text of scripts and the like have no tags; attribute values may be quoted, or hold >, and
    their character references are decoded; rel may name canonical among other relations."""

    def tags(name: str) -> Column:
        return F.regexp_extract_all("bare", F.lit(rf"(?is)<{name}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))

    def value(tag: Column, name: str) -> Column:
        found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
        return decoded(F.regexp_replace(found, "^[\"']|[\"']$", ""))

    canonical = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(F.trim(value(t, "rel"))), "\\s+"), "canonical"))
    refresh = F.filter(tags("meta"), lambda t: F.lower(F.trim(value(t, "http-equiv"))) == "refresh")
    to = F.concat(
        F.transform(canonical, lambda t: value(t, "href")),
        F.transform(refresh, lambda t: F.regexp_extract(value(t, "content"), "(?is)url\\s*=\\s*[\"']?([^\"']+)", 1)),
    )
    # Most pages name neither, and are not looked at more closely.
    some = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|refresh"))
    bare = some.select("url", F.regexp_replace("html", _NO_TAGS, " ").alias("bare"))
    found = bare.select("url", F.explode(to).alias("target")).select("url", F.trim("target").alias("target"))
    return found.select(F.col("url").alias("from_url"), resolved(F.col("url"), F.col("target")).alias("to_url")).where("to_url is not null")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    verdict is the longest fitting rule's. A url that no rule fits takes its equivalence class's: classes are connected
    components over the edges of page_links and of redirects (from_url, to_url), between urls without scheme and
    fragment. A class with an allowed url is allowed (explicit allow goes first), else one with a blocked url is
    blocked, else it is allowed. Targets count by the rules too, pages or not.

    Null urls and urls without :// have empty host and path, no class, and are allowed. Repeated rows stay. Null html has
    no links. An empty table gives no rows; extra columns are ignored. Only urls in edges take part in the component
    search; urls on one host are never brought together.
    """
    kept = only(pages, page_id="long", url="string", html="string")
    links = page_links(kept)
    if redirects is not None:
        links = links.unionByName(only(redirects, from_url="string", to_url="string"))
    edges = links.select("from_url", "to_url", alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")).where("a is not null and b is not null and a <> b")
    edges = written(edges, "url-edges")
    ends = edges.select(F.col("from_url").alias("url"), F.col("a").alias("node")).unionByName(edges.select(F.col("to_url").alias("url"), F.col("b").alias("node")))
    rule_here = matched(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    votes = ends.distinct().join(components(edges.select("a", "b")), "node").groupBy("label", "node").agg(F.max(rule_here == "allow").alias("allowed"), F.max(rule_here == "block").alias("blocked"))
    by_class = votes.groupBy("label").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")).where("blocked and not coalesce(allowed, false)").select("label")
    blocked = votes.select("node", "label").join(by_class, "label").select(F.col("node").alias("blocked_node")).distinct()
    parsed = kept.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_key(F.col("url")).alias("node"))
    ruled = parsed.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    out = ruled.join(blocked, ruled["node"] == blocked["blocked_node"], "left")
    verdict = F.coalesce(F.col("m.verdict"), F.when(F.col("blocked_node").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"))
