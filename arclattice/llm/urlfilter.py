"""URL filtering: host and path rules, and block decisions that follow redirects and canonical links.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's;
the longest that fits decides. Pages that no rule fits take the decision of their aliases: URLs are
joined by all canonical links and refresh redirects that their pages name, relative ones resolved
against the page's URL or its base tag, and the connected components of these edges are equivalent. An alias that a rule allows wins over one that a rule
blocks; without either the page is allowed.

Rules are configuration, a short list that becomes part of the plan. URLs are compared without
scheme and fragment, an empty path is "/". Null URLs, or ones without "://", have an empty host and
path, meet no rule and have no aliases. Null html names no alias; html and URLs may be of any length.
Repeated rows are judged alike; of equally long rules an allowing one wins. Other columns are not
read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, components, key_join, table

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag of a page that may name another URL, to its end or to that of the page: no start is tried twice, so time follows the page's length.
_TAG = r"(?is)<(?:link|meta|base)\b[^>]*+(?:>|\z)"
_CANONICAL = r"""(?is)\brel\s*=\s*(?:["'][^"'>]*)?\bcanonical\b"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
#: An attribute's value: to its quote, else to a space.
_VALUE = r"""(?is)(?<![\w-])%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: The URL of a refresh: to its own quote, else to the end of the content.
_URL = r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
_BARE_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty without it or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null; of equally long ones an allowing one."""
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def node(rest: Column) -> Column:
    """A URL's name: its host, path ("/" if empty) and query; null without a host."""
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(rest) == "", "/").otherwise(path_of(rest))
    return F.when(host_of(rest) != "", F.concat(host_of(rest), path, query))


def first_of(text: Column, pattern: str) -> Column:
    """The one of the pattern's three groups that fits first in the text, or an empty string."""
    return F.concat(*[F.regexp_extract(text, pattern, g) for g in (1, 2, 3)])


def decoded(text: Column) -> Column:
    """The text with its references to ASCII characters, by number or by the names of quotes, ampersand, slash, colon and others that URLs hold, replaced."""
    given = text
    names = {"quot": '"', "apos": "'", "sol": "/", "colon": ":", "quest": "?", "equals": "=", "num": "#", "period": ".", "lowbar": "_", "percnt": "%", "amp": "&"}
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#0*\d{1,3};|&#[xX]0*[0-9a-fA-F]{1,2};"), F.lit(0)))
    code = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, r"(\d+);", 1)).cast("int")
    # the ampersand last, so that what it makes is not read as a reference again
    plain = F.filter(seen, lambda e: (code(e) < 128) & (code(e) > 0) & (code(e) != 38))
    text = F.aggregate(plain, text, lambda t, e: F.replace(t, e, F.char(code(e))))
    for name, char in names.items():
        text = F.regexp_replace(text, f"&{name};" if name != "amp" else "&amp;|&#0*38;|&#[xX]0*26;", char)
    return F.when(given.contains("&"), text).otherwise(given)


def without_dots(path: Column) -> Column:
    """The path, which starts with a slash, without its segments "." and ".."."""
    parts = F.split(path, "/", -1)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    step = lambda got, p: F.when(p == ".", got).when(p == "..", F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0)))).otherwise(F.concat(got, F.array(p)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))).otherwise(path)


def resolved(base: Column, to: Column) -> Column:
    """The URL `to` as named in a document at `base`, both after their scheme; empty for schemes without "://"."""
    host, path = host_of(base), path_of(base)
    own, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    out = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), after_scheme(to)).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "")
    out = out.when(to.startswith("//"), F.substring(to, 3, 1 << 30)).when(to.startswith("/"), F.concat(host, without_dots(own), rest))
    out = out.when(to.startswith("#") | (to == ""), base).when(to.startswith("?"), F.concat(host, path, to))
    return out.otherwise(F.concat(host, without_dots(F.concat(folder, own)), rest))


def links(pages: DataFrame) -> DataFrame:
    """(from_rest, to_rest): URLs after their scheme that pages call equivalent; to_rest may be null or without a host.

    Each tag becomes a row, whose references are decoded once.
    """
    kind = lambda tag, name: tag.rlike(rf"(?i)^<{name}\b")
    tags = F.filter(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), lambda t: t.endswith(">"))
    named = pages.select(after_scheme(F.col("url")).alias("from_rest"), tags.alias("tags")).filter((F.size("tags") > 0) & node(F.col("from_rest")).isNotNull())
    bases = F.transform(F.filter("tags", lambda t: kind(t, "base")), lambda t: first_of(t, _VALUE % "href"))
    base = F.coalesce(F.try_element_at(F.filter(bases, lambda x: F.trim(x) != ""), F.lit(1)), F.lit(""))
    rows = named.select("from_rest", base.alias("base"), F.explode("tags").alias("tag"))
    tag = F.col("tag")
    rows = rows.withColumn("refresh", kind(tag, "meta")).filter((F.col("refresh") & tag.rlike(_REFRESH)) | (kind(tag, "link") & tag.rlike(_CANONICAL)))
    rows = rows.withColumn("text", F.when(F.col("refresh"), first_of(tag, _VALUE % "content")).otherwise(first_of(tag, _VALUE % "href")))
    rows = rows.withColumns({"text": decoded(F.col("text")), "base": F.trim(decoded(F.col("base")))})
    rows = rows.withColumn("url", F.when(F.col("refresh"), first_of(F.col("text"), _URL)).otherwise(F.col("text")))
    bare = F.when(F.col("refresh") & (F.col("url") == ""), F.regexp_extract(tag, _BARE_URL, 1)).otherwise("")
    rows = rows.withColumn("bare", decoded(bare))
    rows = rows.select("from_rest", "base", F.nullif(F.trim(F.when(F.col("url") != "", F.col("url")).otherwise(F.col("bare"))), F.lit("")).alias("to"))
    rows = rows.withColumn("base", F.when(F.col("base") == "", F.col("from_rest")).otherwise(resolved(F.col("from_rest"), F.col("base"))))
    return rows.select("from_rest", resolved(F.col("base"), F.col("to")).alias("to_rest"))


def judged(pages: DataFrame, stage: Stage, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages (page_id, url, html)."""
    # filtered when it is written: a filter on a computed column would write out all that it is computed from several times
    edges = stage.put(links(pages), "links").filter(node(F.col("to_rest")).isNotNull())
    key = lambda c: F.unhex(F.md5(node(F.col(c))))  # noqa: E731  # 128 bits, so that no two URLs share a name
    joined = components(edges.select(key("from_rest").alias("a"), key("to_rest").alias("b")), stage)
    # what rules say of the URLs that have aliases, pages or not
    urls = edges.select(F.explode(F.array("from_rest", "to_rest")).alias("rest")).distinct()
    said = urls.select(key("rest").alias("id"), ruling(host_of(F.col("rest")), path_of(F.col("rest")), rules)["verdict"].alias("verdict"))
    by = said.join(joined, "id").groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("allow"), F.bool_or(F.col("verdict") == "block").alias("block"))
    by = by.select("component", F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block").alias("inherited"))
    names = stage.put(joined.join(stage.put(by, "said"), "component").select(F.col("id").alias("node"), "inherited"), "inherited")
    rest = after_scheme(F.col("url"))
    rows = pages.select("page_id", rest.alias("rest")).select("page_id", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"), F.when(node(F.col("rest")).isNotNull(), key("rest")).alias("node"))
    rows = key_join(stage.put(rows, "pages"), names, "node", stage, "page_id")
    rule = ruling(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.col("inherited"), F.lit("allow")).alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"), Stage(spark))
