"""URL rules whose block decisions reach aliases over redirect and canonical-link edges."""

from __future__ import annotations

from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, rows_of, scratch
from .components import components

LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?|'(?:[^'>]*\s)?)?canonical\b[^>]*>"
META_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
LINK_TO = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_TO = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"
#: Character references by name, with their semicolon.
NAMED = {f"&{name}": to for name, to in html5.items() if name.endswith(";")}


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def unescape(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with the character references in `column` resolved; what is none stays.

    Named references join the table of names, one row each; a plan that held the
    table in every expression about the column would outgrow the driver.
    """
    spark, names = rows.sparkSession, rows.columns
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    parts = numbered.where(F.contains(column, F.lit("&"))).select("_id", F.posexplode(F.regexp_extract_all(column, F.lit(REFERENCE), F.lit(0))).alias("_at", "_part"))
    known = F.broadcast(spark.createDataFrame(pa.table({"_part": list(NAMED), "_to": list(NAMED.values())})))
    hex_part = F.conv(F.regexp_extract("_part", r"^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
    code = F.coalesce(F.nullif(F.regexp_extract("_part", r"^&#([0-9]+);$", 1), F.lit("")), hex_part).cast("long")
    parts = parts.join(known, "_part", "left").withColumn("_code", code)
    real = F.col("_code").between(1, 0x10FFFF) & ~F.col("_code").between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(real, F.col("_code")).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    told = F.when(F.col("_part").startswith("&#") & F.col("_part").endswith(";"), char).otherwise(F.coalesce("_to", "_part"))
    whole = parts.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", told.alias("_told")))), lambda p: p["_told"]), "").alias("_whole"))
    return numbered.join(whole, "_id", "left").select(*[F.coalesce("_whole", column).alias(c) if c == column else F.col(c) for c in names])


def plain_path(path: Column) -> Column:
    """`path` without . and .. steps; the empty path is /."""
    steps = F.split(path, "/")
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    # the first step is the empty one before the first slash and stays
    walk = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    walked = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), walked).otherwise(path)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*(\?[^#]*)", 1)


def node_of(url: Column) -> Column:
    """One string for addresses that differ in scheme, host case, fragment, . and .. steps or the slash after a bare host; null if there is no host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), plain_path(path_of(url)), query_of(url)))


def path_of_node(node: Column) -> Column:
    return F.regexp_extract(node, r"^[^/?]*([^?]*)", 1)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of the address its canonical link or meta refresh names.

    Character references in the address are resolved, and addresses without a
    scheme are taken relative to the page. Pages without a host, without html or
    without such tags give no edge, nor do addresses of a scheme without a host.
    """
    base = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where("html is not null")
    base = base.where(F.col("html").rlike(f"{LINK_TAG}|{META_TAG}"))
    link = F.transform(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)), lambda t: F.regexp_extract(t, LINK_TO, 1))
    meta = F.transform(F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda t: F.regexp_extract(t, META_TO, 1))
    # few rows are left; tables between the steps keep the next one's expressions as short as its own
    found = scratch(base.select("url", F.explode(F.concat(link, meta)).alias("to")).where("to <> ''"))
    from_page = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"), node_of(F.col("url")).alias("a")]
    found = scratch(unescape(found, "to").select("to", *from_page))
    root = F.concat(F.lit("x://"), F.col("host"))
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    to = (
        F.when(F.col("to").rlike("(?i)^[a-z][a-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(root, "to"))
        .when(F.col("to").startswith("?"), F.concat(root, path, "to"))
        .when(F.col("to").startswith("#"), F.concat(root, path, F.col("query")))
        .otherwise(F.concat(root, F.regexp_replace(path, r"[^/]*$", ""), "to"))
    )
    found = scratch(found.where("a is not null").select("a", to.alias("to")).where("to is not null"))
    return found.select("a", node_of(F.col("to")).alias("b")).where("b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, via) for every row of `pages`.

    `rules` are (allow or block, host, path). A rule fits its host and all
    subdomains where the path starts with the rule's; the longest fitting rule
    decides, allow before block on equal length. `redirects` (from_url, to_url)
    adds edges, such as a crawler's log. Pages that no rule fits take the verdict
    of a rule for another spelling of their address, else that of their aliases, the connected component over all edges: block if a rule
    blocks one of them and no rule allows one, else allow. `via` is rule, alias
    or default.

    A null address, or one without ://, has empty host and path, no rule and no
    aliases, and is allowed. Repeated rows are judged one by one. An empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null"))
    alias = components(edges)

    # nodes under the paths of their rows and under their own, those only linked to included
    own_path = path_of_node(F.col("node"))
    every = base.where("node is not null").select("node").unionByName(alias.select("node"))
    nodes = base.where("node is not null").select("node", "host", "path").unionByName(
        every.select("node", F.regexp_extract("node", r"^([^/?]*)", 1).alias("host"), own_path.alias("path"))
    ).distinct()
    table = rows_of(spark, [(h + p, h, p, a) for a, h, p in rules], "rule string, rule_host string, rule_path string, action string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = nodes.select("node", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action"))
    ruled = fits.groupBy("node", "path").agg(best.alias("best")).select("node", "path", "best.rule", "best.action")
    same = ruled.where(F.col("path") == own_path).select("node", F.col("action").alias("same"))

    spread = alias.join(same, "node").groupBy("component").agg(F.max(F.col("same") == "allow").alias("allowed"), F.max(F.col("same") == "block").alias("blocked"))
    passed = alias.join(spread, "component").select("node", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("passed"))
    known = same.join(passed, "node", "full_outer").select("node", F.coalesce("same", "passed").alias("passed"))
    return base.join(ruled, ["node", "path"], "left").join(known, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise("default").alias("via"),
    )
