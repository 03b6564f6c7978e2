"""URL rules, licence diagonals and boilerplate lines."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import license_scan, line_dedup, url_filter
from tracewright.llm.components import components
from tracewright.llm.queries import SQL, URL_RULES

PAGES = "page_id long, url string, html string, node string, rule string"


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], PAGES)
    moved = spark.createDataFrame(redirects, "from_url string, to_url string") if redirects else None
    return {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, moved).collect()}


def test_rules_and_odd_addresses(spark):
    got = judged(spark, [("http://A.example.ORG/es/1?x", None), ("https://example.org/en/12", ""), ("https://b.org", None), ("https://b.org/#t", None), (None, None), ("no address", None), ("x://notexample.org/es/", None), ("http://c.com/de/1", None)])
    assert [got[i]["verdict"] for i in range(8)] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("a.example.org", "/es/1", "example.org/es/")
    assert got[2]["rule"] is None and got[2]["path"] == "" and got[3]["rule"] == "org/" and got[6]["rule"] == "org/"
    assert (got[4]["host"], got[4]["path"], got[5]["host"]) == ("", "", "")


def test_blocks_reach_aliases_and_allow_wins(spark):
    link = '<LINK href="{}" rel=canonical>'
    rows = [
        ("http://a.net/1", link.format("http://x.com/de/9")),  # blocked through its target, which is no page
        ("http://a.net/2", link.format("/1")),  # and one step further, relative
        ("http://a.net/3", '<meta http-equiv="refresh" content="0; url=http://c.com/de/2">'),
        ("http://c.com/fr/7", link.format("http://c.com/de/2")),  # allowed itself, so its component is
        ("http://d.net/4", None),
    ]
    got = judged(spark, rows, [("https://d.net/4#z", "http://a.net/2"), (None, "http://a.net/2")])
    assert [got[i]["verdict"] for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert [got[i]["via"] for i in range(5)] == ["alias", "alias", "alias", "rule", "alias"]
    assert judged(spark, []) == {}


def test_repeated_pages_and_a_hot_target(spark):
    rows = [("http://a.net/s", f'<link rel="canonical" href="http://x.com/de/{i % 2}">') for i in range(60)] + [(f"http://b.net/{i}", '<link rel="canonical" href="http://a.net/s">') for i in range(60)]
    assert {r["verdict"] for r in judged(spark, rows).values()} == {"block"}


@pytest.mark.parametrize("page, html", [
    ("http://a.net/1", '<link rel="canonical" href="http://x.com/de/?page=2&amp;ref=x">'),
    ("http://a.net/1", '<link rel="canonical" href="http://x.com/de/?page=2&#38;ref=x">'),
    ("http://a.net/1", '<link rel="canonical" href="http://x.com/de/?page=2&#x26;ref=x">'),
    ("http://a.net/1", '<meta http-equiv="refresh" content="0; url=http://x.com/de/?page=2&amp;ref=x">'),
    ("http://a.net/1", '<link rel="alternate canonical" href="http://x.com/de/?page=2&ref=x">'),
    ("http://a.net/1", "<link href='http://x.com/de/?page=2&ref=x' rel='alternate\tcanonical home'>"),
    ("http://x.com/de/?page=1", '<link rel="canonical" href="?page=2&amp;ref=x">'),
    ("http://x.com/de/a/b/c", '<link rel="canonical" href="../../?page=2&ref=x">'),
    ("http://x.com/de/a", '<link rel="canonical" href="../../../de/./?page=2&ref=x">'),
    ("http://x.com", '<link rel="canonical" href="de/?page=2&ref=x">'),
    ("http://a.net/1", '<link rel="canonical" href="http://x.com/fr/../de/?page=2&ref=x">'),
])
def test_spellings_of_a_link_name_the_page(spark, page, html):
    pages = spark.createDataFrame([(page, html)], "url string, html string")
    node = "x.com/de/?page=2&ref=x"
    assert [r["b"] for r in url_filter.page_edges(pages).collect()] == [node]
    assert spark.createDataFrame([("https://X.com/de/?page=2&ref=x",)], "url string").select(url_filter.node_of(F.col("url"))).first()[0] == node


def test_sql_reads_the_same_spellings(spark):
    marks = [m for m in test_spellings_of_a_link_name_the_page.pytestmark if m.name == "parametrize"]
    rows = [("http://a.net/q" + str(i), h.replace("x.com/de/", f"x{i}.com/de/")) for i, (_, h) in enumerate(marks[0].args[1])]
    rows += marks[0].args[1] + [
        ("http://c.com", None), ("http://c.com/", None), ("http://example.org", '<link rel="canonical" href="./es/../es/1">'), ("http://d.net/2", '<link rel="canonical" href="http://example.org">'),
        ("http://c.com/fr/7", '<link rel=canonical href="http://c.com/de/&eacute;&nosuch;&#xD800;">'), ("http://d.net/3", '<link rel=canonical href="http://c.com/de/\u00e9&nosuch;\ufffd">'),
        ("http://e.net/4", '<link rel="canonical" href="#x">'), ("http://e.net/5", '<link rel="canonical" href="mailto:a@b">'), (None, "<link rel=canonical href=/x>"), ("nothing", None), ("http://f.com/de/1", ""),
    ]
    pages = pa.table({"page_id": range(len(rows)), "url": [r[0] for r in rows], "html": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(SQL["op6_url_filter"]).to_arrow_table().select(["page_id", "host", "path", "rule", "verdict", "via"]).to_pylist()
    got = url_filter.judge(spark.createDataFrame(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "via").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((tuple(r.values()) for r in want), key=repr)
    assert {r["via"] for r in got} == {"rule", "alias", "default"}


def test_the_plan_of_the_edges_stays_short(spark):
    edges = url_filter.page_edges(spark.createDataFrame([("http://a.net/1", "<link rel=canonical href=/2>")], "url string, html string"))
    assert len(edges._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_links_that_name_no_other_page(spark):
    rows = [("http://a.net/p?q", '<link rel="canonical" href="#top">'), ("http://a.net/p", '<link rel="canonical" href="mailto:x?u=http://y.com/">'),
            ("http://a.net/p", '<link rel="noncanonical" href="/z">'), ("http://a.net/p", '<link rel="canonical" href="/go?to=http://y.com/&nosuch;&#xD800;&eacute;">')]
    got = url_filter.page_edges(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(r["a"] + " " + r["b"] for r in got) == ["a.net/p a.net/go?to=http://y.com/&nosuch;\ufffd\u00e9", "a.net/p?q a.net/p?q"]


def test_bare_host_and_slash_are_one_address(spark):
    rules = [("block", "bad.net", "/")]
    link = '<link rel="canonical" href="{}">'
    rows = [("http://bad.net", None), ("http://c.net", link.format("https://d.net")), ("http://d.net/", link.format("http://bad.net/1")), ("http://c.net/", None), ("http://e.net", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert [got[i]["verdict"] for i in range(5)] == ["block", "block", "block", "block", "allow"]
    assert got[0]["path"] == "" and got[0]["rule"] is None and got[4]["via"] == "default"


@pytest.mark.parametrize("edges", [[], [(1, 1), (2, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100), (100, 101)], [(None, 3), (3, 4)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


LICENSES = [
    ("Released under the MIT License. mit-license again", 2, "mit", "mit"),
    ("General Public\nLicense and the Apache license", 2, "apache,gpl", "apache,gpl"),
    ("Licensed under the very Apache License, Version 2.0", 1, "apache", "apache,apache-2.0"),
    ("mit licenses general public licence", 0, "", ""),
    ("", 0, "", ""), (None, 0, "", ""), ("éMIT license", 0, "", ""), ("MIT " * 5000 + "license", 1, "mit", "mit"),
]


def test_license_spans(spark):
    docs = spark.createDataFrame([(7, t, 1, "w") for t, *_ in LICENSES], "doc_id long, text string, pos int, words string").coalesce(1)
    found = license_scan.scan_licenses(docs).collect()
    assert len(found) == len(LICENSES)
    got = sorted((r["n_words"], sum(s["kind"] == "phrase" for s in r["spans"]), ",".join(sorted({s["label"] for s in r["spans"] if s["kind"] == "phrase"})), ",".join(sorted({s["label"] for s in r["spans"]}))) for r in found)
    sizes = [8, 7, 9, 5, 0, 0, 2, 5001]
    assert got == sorted((n, *case[1:]) for n, case in zip(sizes, LICENSES))
    assert license_scan.scan_licenses(docs.where("doc_id < 0")).count() == 0


DOCS = "doc_id long, text string, source string, _bad string, doc string, _site int"


def test_boilerplate_lines(spark):
    rows = [(i, f"own {i}\nand more of {i}\n  Menu  \n\nlast {i}", "a") for i in range(20)]
    rows += [(100 + i, f"Menu\nshort {i}", "b") for i in range(2)]  # a site of two pages
    rows += [(110, "Menu\nalone", "c")]  # on one page nothing repeats
    rows += [(200 + i, "the same page\nwith two lines", "a") for i in range(30)]  # exact copies are one page
    rows += [(300, "Menu", "a"), (301, "", "a"), (302, None, None), (303, "Menu\n" + "x" * 200_000, None)]
    docs = spark.createDataFrame([(*r, "b", "d", 3) for r in rows], DOCS)
    for limit in (line_dedup.BROADCAST_ROWS, 0):
        got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, broadcast_rows=limit).collect()}
        assert len(got) == len(rows) and set(docs.columns) < set(got[0].asDict())
        assert got[3]["text"] == "own 3\nand more of 3\n\nlast 3" and got[3]["_dropped"] == 1 and got[3]["_lines"] == 5
        assert got[100]["text"] == "short 0" and got[110]["_dropped"] == 0 and got[205]["text"] == "the same page\nwith two lines"
        assert got[300]["text"] == "" and got[300]["_dropped"] == 1  # nothing else was there
        assert (got[301]["text"], got[301]["_lines"]) == ("", 1) and (got[302]["text"], got[302]["_lines"]) == (None, 0)
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_ratio_is_by_site(spark):
    rows = [(i, f"foot\nbody {i} {'z' * 9}", "small") for i in range(10)] + [(100 + i, (f"foot\nbody {i} {'z' * 9}" if i < 5 else f"body {i}"), "large") for i in range(100)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("_dropped").alias("n"))
    assert {r["source"]: r["n"] for r in out.collect()} == {"small": 10, "large": 0}
