"""URL filters with redirect equivalence.

Pages that redirect to one another, or name one another as canonical, are one
site's aliases.  Their links are edges between addresses; connected components of
the edges are classes of equivalent addresses.  A rule decides for the pages it
fits.  Any other page takes its class's decision: allow if a page or a linked
address of the class is allowed by a rule (an explicit allow precedes), else block
if one is blocked, else the default, allow.

Edges of a page: its address to the target of a ``refresh`` redirect, of a
canonical link, and to its own plain form (no query or fragment, no ``www.`` or
``m.``, no trailing slash or ``.html``, https).  Other redirects may be given as a
table.  Built-in expressions only.

Defined results: a null address, or one without ``://``, has an empty host and
path, fits no rule, has no edges and is allowed; repeated pages are judged each;
an empty page has only its plain form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .staging import small, stage

#: (verdict, host, path): longest match wins
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, with A-Z lower-cased."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits (else null).

    The rules are an argument, a handful; of equally long ones that with the longer
    host wins."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    name = verdict = None
    for decided, of, begins in ranked:
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(begins)
        name = F.when(fits, f"{of}{begins}") if name is None else name.when(fits, f"{of}{begins}")
        verdict = F.when(fits, decided) if verdict is None else verdict.when(fits, decided)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def plain_form(url: Column) -> Column:
    """The address without what seldom tells pages apart."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), r"/+$", "")
    return F.when(host_of(url) != "", F.concat(F.lit("https://"), host, path))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    return F.regexp_replace(F.regexp_replace(value, r"(?is)^[^=]*=\s*", ""), "^[\"']|[\"']$", "")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` taken away."""
    # those at the end leave a slash
    parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    step = lambda done, p: F.when(p == ".", done).when(p == "..", up(done)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _absolute(target: Column, url: Column) -> Column:
    """A target as an address: full, without a scheme, from the root, or beside the
    page; none for a place within the page or another scheme without a host."""
    origin = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    own = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    path, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)[?#].*$", 0)
    beside = F.concat(F.regexp_extract(own, r"(?s)^.*/", 0), path)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("https:"), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(target.startswith("?"), F.concat(origin, own, target))
        .otherwise(F.concat(origin, _without_dots(beside), rest))
    )


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, target) of all canonical links and refresh redirects of the pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    canonical = every(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>")
    refresh = every(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>")
    onward = lambda tag: F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s;]+)", 1)
    some = pages.where(F.col("url").contains("://"))
    found = F.concat(F.transform(canonical, lambda tag: _attribute(tag, "href")), F.transform(refresh, onward))
    named = some.select("url", F.explode(found).alias("named"))
    return named.select("url", _absolute(F.trim("named"), F.col("url")).alias("target")).where("target != ''")


def classes(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(address, class) of addresses with an alias; both are MD5 digests."""
    own = pages.select("url", plain_form(F.col("url")).alias("target")).where(F.col("target").isNotNull())
    edges = [own, link_targets(pages)]
    if redirects is not None:
        edges.append(redirects.select(F.col("source").alias("url"), "target"))
    pairs = reduce(DataFrame.unionByName, edges).where("url != target")
    # a target's plain form joins addresses that differ in nothing that counts
    further = pairs.select(F.col("target").alias("url"), plain_form(F.col("target")).alias("target")).where("url != target")
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    every = pairs.unionByName(further).select(digest("url").alias("u"), digest("target").alias("v"))
    return components(every).select(F.col("node").alias("address"), F.col("component").alias("class"))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    url = F.col("url")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    address = F.unhex(F.md5(F.coalesce(url, F.lit("")).cast("binary")))
    rows = stage(rows.withColumns({"rule": name, "own": verdict, "address": address}).drop("url"), "pages")
    known = stage(classes(pages, redirects), "classes")
    # decisions of a class, from its pages and from the addresses they lead to
    explicit = rows.where(F.col("own").isNotNull()).select("address", "own").distinct()
    # the pages vote themselves
    linked = link_targets(pages).select(F.col("target").alias("url"))
    if redirects is not None:
        for end in ("source", "target"):
            linked = linked.unionByName(redirects.select(F.col(end).alias("url")))
    named, decided = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    beyond = linked.select(F.unhex(F.md5(F.col("url").cast("binary"))).alias("address"), decided.alias("own")).where("own is not null")
    voted = explicit.unionByName(beyond).join(known, "address").groupBy("class")
    votes = voted.agg(F.max(F.col("own") == "allow").alias("allowed")).withColumnRenamed("class", "_class")
    told = stage(known.join(votes, F.col("class") == F.col("_class")).select("address", "allowed"), "decisions")
    open_ = rows.join(small(told), "address", "left")
    passed = F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block").otherwise("allow")
    return open_.select("page_id", "host", "path", "rule", F.coalesce("own", passed).alias("verdict"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
