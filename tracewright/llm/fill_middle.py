"""Fill-in-the-middle rearrangement, cut between the units of one repeated capture."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A run of letters or any other single character.
UNITS = regex.compile("([A-Za-z]+|[^A-Za-z])*")
LETTERS = regex.compile("[A-Za-z]+")
#: Characters of one match: each repetition it retains takes some 200 bytes. Longer texts are matched part by part.
PART = 1 << 18


def parts(text: str, size: int = PART) -> list[tuple[int, int]]:
    """Consecutive stretches of about `size` characters that no run of letters crosses."""
    out, at = [], 0
    while at < len(text):
        to = min(at + size, len(text))
        if to < len(text) and (run := LETTERS.match(text, to)):
            to = run.end()
        out.append((at, to))
        at = to
    return out


def unit_cuts(text: str, a: int, b: int, size: int = PART) -> tuple[int, int, int]:
    """(n, first, second): the number of units, and the characters before the end of the smaller and larger of a % (n + 1) and b % (n + 1) units."""
    ends = [UNITS.fullmatch(text, i, j).ends(1) for i, j in parts(text, size)] if len(text) > size else [UNITS.fullmatch(text).ends(1)]
    n = sum(map(len, ends))
    cuts = []
    for unit in sorted((a % (n + 1), b % (n + 1))):
        found = 0
        for part in ends:
            if 0 < unit <= len(part):
                found = part[unit - 1]
            unit -= len(part)
        cuts.append(found)
    return n, *cuts


def _cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unit_cuts(*row) for row in zip(text, a, b)], columns=["n", "first", "second"])


def hashes(seed: int, key: Column) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `seed:key`, as numbers; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of `docs`.

    A text is n units, runs of A-Z and a-z or other single characters. Two draws
    from the hash of the id cut it between units into prefix, middle and suffix. Of
    all texts `percent` take the form psm (prefix, suffix, middle) or, `spm_percent`
    of those, spm (suffix, prefix, middle), each part behind its sentinel. The
    others stay plain, as do empty texts and those that hold a sentinel.

    Null text is empty; a null id draws as an empty one. Rows that repeat are taken
    one by one and give equal results. Only id and text are read, so other columns
    don't clash. An empty table gives an empty result. A text of any length is
    matched whole, in parts between units, so that a match stays small.
    """
    small_batches(docs)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = hashes(seed, F.col("doc_id"))
    cut = base.select("doc_id", "text", F.pandas_udf(_cuts, "n long, first long, second long")("text", h1, h2).alias("cut")).select("doc_id", "text", "cut.*")
    held = F.lit(False)
    for mark in SENTINELS:
        held = held | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | held | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    prefix, suffix = F.substring("text", F.lit(1), F.col("first")), F.substring("text", F.col("second") + 1, F.length("text"))
    middle = F.substring("text", F.col("first") + 1, F.col("second") - F.col("first"))
    p, s, m = (F.lit(mark) for mark in SENTINELS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"), F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that `rearrange` took: only its sentinels stand in a form other than plain, as a text with one of its own is plain."""
    part = F.split(output, "|".join(re.escape(mark) for mark in SENTINELS))
    get = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)
