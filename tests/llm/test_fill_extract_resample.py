"""Fill-in-the-middle, main text of pages and importance resampling against plain versions."""

import hashlib
import html
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import fill_middle, main_text, resample
from tracewright.llm.common import read
from tracewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, cut string, output string, rank int, found string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], DOCS)


# -- fill in the middle


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle_against_a_plain_version(spark):
    odd = [None, "", "a", "\n", "<P>", "x<S>y", "<M", "<<P>", "é ü\U0001f600 word", "word\r\n\r\nword <P", "aé" * 400]
    rows = [(i, t) for i, t in enumerate(odd * 12)] + [(None, "no id here"), (7, "again"), (7, "again")]
    got = fill_middle.rearrange(docs_of(spark, rows)).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    want = [(i, *plain_fill(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.rearrange(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_parts_of_a_long_text_give_the_same_units(size):
    text = "ab cd" + "x" * 60 + " 1é\n" + "word " * 40 + "end"
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(text[a:b] for a, b in fill_middle.parts(text, size)) == text
    for a, b in [(0, 0), (3, 1), (len(units), 5), (10**9, 123456789), (len(units) + 1, 2)]:
        x, y = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        want = (len(units), len("".join(units[:x])), len("".join(units[:y])))
        assert fill_middle.unit_cuts(text, a, b, size) == fill_middle.unit_cuts(text, a, b) == want


def test_a_very_long_text_is_matched_in_parts(spark):
    text = ("some words, " * 100_000) + "x" * 700_000
    got = fill_middle.rearrange(docs_of(spark, [(1, text)])).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).first()
    assert (got["n"], got["back"]) == (len(re.findall("[A-Za-z]+|[^A-Za-z]", text)), text)


# -- main text

LONG = "Some plain words that a paragraph of an article has. " * 4
PARA, TEXT = f"<p>{LONG}</p>", LONG.strip()


def plain_article(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", body))
    return "\n".join(b for b in blocks if b)


def test_given_pages_against_their_articles(spark):
    pages = {r["page_id"]: r for r in read(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = QUERIES["op12_main_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"])
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("words  without\n a tag", "words without a tag"),
    ("<nav><a>x</a></nav><footer>y</footer><script>z</script>", ""),
    # named by class and id
    (f"<body><div id=header><a href=/>Site</a></div><div class='nav menu'><a>x</a></div><div class=content><h1>T</h1>{PARA}<p>Short.</p></div><div class=sidebar>{PARA * 3}</div><div id=footer>c</div>", f"T\n{TEXT}\nShort."),
    # no names at all: the ratio tells
    (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div><h1>T</h1>{PARA}<p>S.</p>{PARA}</div><div><ul><li><a>x</a><li><a>y</a></ul></div>", f"T\n{TEXT}\nS.\n{TEXT}"),
    # reader comments, even as articles, bylines and footers of the article
    (f"<article><header><h1>T</h1><p>by me</p></header>{PARA}<section class='comments'><article class=comment>{PARA}</article></section><footer>f</footer></article><section id=comments>{PARA * 4}</section>", f"T\n{TEXT}"),
    (f"<div class='cookie-notice'>{PARA * 5}</div><main><h2>H</h2><p>a<p>b</main>", "H\na\nb"),
    ("<body class='has-sidebar'><article class='post no-comments'><p>x</article>", "x"),
    # inside a block: references, white space, line breaks, inline elements and asides
    ("<article><p>f<b>oo</b>&amp;&eacute;&#233;&nbsp; x<br>y<span class=ad>buy</span>z</p></article>", "foo&éé x yz"),
    ("<article><p>a<script>if (1 < 2) '</article>'</script>b<!-- c --></p><p>1 &lt;b&gt; 2 < 3</p></article>", "ab\n1 <b> 2 < 3"),
    ("<article><p hidden>h</p><p style='display: none'>h<p aria-hidden=true>h<p>seen</p></article>", "seen"),
    ("<article><p>x</p><form><p>f<input><button>go</button></form><p>y</p><textarea>t</textarea><p>z</article>", "x\ny\nz"),
    # unclosed and cut off
    ("<article><p>one<p>two<li>three<li>four<table><tr><td>a<td>b<tr><td>c</table><script>var a='</article>';", "one\ntwo\nthree\nfour\na\nb\nc"),
    ("<article><p>one<span class=ad>buy</p><p>two</p></article><aside><p>x</as", "one\ntwo"),
    ("<article><p>R&am", "R&am"),
])
def test_odd_pages(page, text):
    assert main_text.main_text(page) == text


def test_null_repeated_and_long_pages(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "t"), (1, "u", "<p>x", "t"), (1, "u", "<p>x", "t"), (None, "u", "", "t"), (2, "u", long, "t")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r["page_id"] or 0, r["url"], r["n_chars"]) for r in got), key=repr) == sorted([(1, None, 0), (1, "u", 1), (1, "u", 1), (0, "u", 0), (2, "u", 20_000 * (len(TEXT) + 1) - 1)], key=repr)
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# -- resampling


def plain_resample(docs, target, percent=25, min_words=20, buckets=10_000):
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for b in found(text)[1]:
                out[b] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, got = found(text)
        weight = sum(gain[b] for b in got) // len(got) if got else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(order[: len(order) * percent // 100])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows]


def test_resampling_against_a_plain_version(spark):
    base = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    same = [(5000, "one text of many words " * 6)] * 9
    docs = [*base, *same, (None, "no id " * 30), (None, None), (6000, None), (6001, ""), (6002, "?!"), (6003, "ÀB straße x9_Z\x7f a" * 40)]
    target = [r["text"] for r in read(spark, SF, "benchmark").collect()] + [None, ""]
    targets = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(docs_of(spark, docs), targets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_resample(docs, target), key=repr)


def test_resampling_empty_tables_and_other_orders(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs_of(spark, []), none).collect() == []
    docs = [(i, f"w{i} " * 25) for i in range(8)]
    assert sorted(map(tuple, resample.resample(docs_of(spark, docs), none).collect())) == sorted(plain_resample(docs, []))
    words = resample.words_of("a bc D".encode())
    assert resample.buckets_of(words, 1 << 20, 3).tolist() == [zlib.crc32(r) % (1 << 20) for r in (b"a", b"bc", b"d", b"a bc", b"bc d", b"a bc d")]


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), F.lit(3).alias("doc_id")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.ranked(rows, [F.col("score").desc(), F.col("doc_id")]).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [r["score"] for r in got] == sorted((i % 7 for i in range(5000)), reverse=True)
