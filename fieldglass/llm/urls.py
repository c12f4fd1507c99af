"""URL filters with redirect equivalence.

Every url gets the verdict of the longest rule that fits it. Urls that redirect to each other or name each other
canonical are one resource: the classes of these links are found by distributed connected components, and a
block decision on any member carries over to the members without a rule of their own. An explicit rule of a
url's own always comes first, so an allowed alias stays allowed and hands nothing on. What neither a rule nor a
class decides is allowed.

A url is known by host, path and query, whatever its scheme and fragment. Null urls and urls without `://` have
empty host and path and link to nothing. Rules are few and given by hand; they become one expression. Ties in
length go to the longer host, then to the block. Repeated rows get the same verdict. Extra columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import components, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def identity(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    key = F.concat(host(url), path(url), F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1))
    return F.when(host(url) != "", key)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]], give) -> Column:
    """give(verdict, host, path) of the longest fitting rule; null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.lit(give(v, h, p))) for v, h, p in ranked]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


#: A character reference in an attribute; without its semicolon it is none before = or a letter or digit.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")


def resolved(url: str, to: str, base: str = "") -> str | None:
    """The url that the attribute value `to` means on the page at `url`, whose base element names `base`."""

    def against(page: str, value: str) -> str:
        value = _REFERENCE.sub(lambda m: entities.unescape(m[0]), value).strip()
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
            return value
        _, mark, rest = page.partition("://")
        return urljoin(f"http://{rest}", value) if mark else value  # the scheme tells nothing apart

    try:
        return against(against(url, base) if base else url, to)
    except ValueError:  # no url
        return None


def links(pages: DataFrame) -> DataFrame:
    """a, b: the url of a page and the one it redirects to or calls canonical, references resolved."""
    html = F.col("html")
    tag = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    named = pages.where("html is not null and url is not null").select("url", F.array(tag, refresh).alias("both"), "html")
    named = named.where("array_max(both) <> ''").select("url", base.alias("base"), F.explode("both").alias("to")).where("to <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [resolved(*x) for x in zip(*(b.column(c).to_pylist() for c in ("url", "to", "base")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array(to, pa.string())], names=["url", "to"])

    both = named.mapInArrow(run, "url string, to string")
    return both.select(identity(F.col("url")).alias("a"), identity(F.col("to")).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, more_links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; more_links: further pairs of urls (a, b)."""
    found = links(pages)
    if more_links is not None:
        found = found.unionByName(more_links.select(identity(F.col("a")).alias("a"), identity(F.col("b")).alias("b")))
    found = cut(found.distinct())
    url = F.col("url")
    own = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), identity(url).alias("key"))
    own = own.select("*", fitting(F.col("host"), F.col("path"), rules, lambda v, h, p: h + p).alias("rule"), fitting(F.col("host"), F.col("path"), rules, lambda v, h, p: v).alias("own"))
    if found.isEmpty():
        blocked = F.lit(False)
    else:
        groups = cut(components(found))
        node = F.concat(F.lit("://"), F.col("node"))
        decided = groups.withColumn("own", fitting(host(node), path(node), rules, lambda v, h, p: v))
        bad = decided.groupBy("component").agg(F.max(F.col("own") == "block").alias("bad")).where("bad")
        aliases = groups.join(bad, "component").select(F.col("node").alias("key"), "bad").distinct()
        own = own.join(aliases, "key", "left")
        blocked = F.coalesce("bad", F.lit(False))
    verdict = F.coalesce("own", F.when(blocked, "block").otherwise("allow"))
    return own.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
