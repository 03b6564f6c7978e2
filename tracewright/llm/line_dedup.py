"""Boilerplate lines by their share of a site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Boilerplate rows up to which the table goes to every executor: 16 bytes of key and the site's name each.
BROADCAST_ROWS = 100_000


def line_key(line: Column) -> Column:
    """128 bits of the line without blanks at its ends."""
    return F.unhex(F.md5(F.trim(line, F.lit(" \t\r"))))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = 0.1) -> DataFrame:
    """(site, line, pages, ratio): lines on more than `max_ratio` of their site's pages, and on more than one.

    Exact copies within a site count as one page, above and below the line: a page
    that was crawled often is no template. Empty lines don't count. A null site is a
    site of its own, as is the empty one.

    A site has at most (mean lines of a page) / max_ratio such lines.
    """
    base = docs.select(F.col(site).alias("site"), F.col(text).alias("text")).where("text is not null").select("site", F.xxhash64("text").alias("page"), "text")
    lines = base.select("site", "page", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.where(F.trim("line", F.lit(" \t\r")) != "").select("site", "page", line_key(F.col("line")).alias("line"))
    # spread by line and page, so that a site's or a line's rows don't meet before they are counts
    counts = lines.distinct().groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") > 1)
    totals = base.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("total")).withColumnRenamed("site", "of")
    # a site's total goes to all its counts: few rows against many, split by adaptive execution
    found = counts.join(totals, counts["site"].eqNullSafe(totals["of"])).where(F.col("pages") > F.lit(max_ratio) * F.col("total"))
    return found.select("site", "line", "pages", (F.col("pages") / F.col("total")).alias("ratio"))


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = 0.1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` with `text` less its boilerplate lines, and `_lines` and `_dropped`, their numbers.

    A document of nothing else becomes empty. Other lines keep their order and exact
    text. Null text stays null with 0 lines; empty text has one empty line, which
    stays, as do all empty lines. Rows that repeat lose the same lines. An empty table
    gives an empty result. Other columns pass through; own columns named _lines or
    _dropped are replaced.
    """
    bad = boilerplate(docs, site, text, max_ratio)
    per_site = scratch(bad.groupBy("site").agg(F.collect_set("line").alias("_bad")).withColumnRenamed("site", "_site"))
    size = per_site.agg(F.sum(F.size("_bad"))).first()[0] or 0
    side = F.broadcast(per_site) if size <= broadcast_rows else per_site
    names = [c for c in docs.columns if c not in ("_lines", "_dropped")]
    # the document's columns stay in a struct meanwhile, so that none clashes with those made here
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")).withColumn("text", F.col(f"doc.`{text}`"))
    joined = joined.join(side, F.col(f"doc.`{site}`").eqNullSafe(F.col("_site")), "left")
    lines = F.split("text", "\n")
    is_bad = lambda x: (F.trim(x, F.lit(" \t\r")) != "") & F.array_contains("_bad", line_key(x))
    hit = joined.withColumn("cut", F.when(F.col("_bad").isNotNull() & F.col("text").isNotNull(), F.filter(lines, is_bad)))
    hit = hit.withColumn("cuts", F.coalesce(F.size("cut") > 0, F.lit(False)))
    kept = F.array_join(F.filter(lines, lambda x: ~is_bad(x)), "\n")
    out = [F.when(F.col("cuts"), kept).otherwise(F.col("text")).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in names]
    return hit.select(
        *out, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_lines"),
        F.when(F.col("cuts"), F.size("cut")).otherwise(0).cast("long").alias("_dropped"),
    )
