"""Column functions against fixed expectations."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions import url as U
from pageloom.functions.html import attr, split_tokens, without_raw_text
from pageloom.operators.links import filter_safe
from pageloom.operators.markdown import (
    collapse_blank_lines, escape_bracket_newlines, remove_data_images, remove_skip_links,
)


def values(spark, rows, expr):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r.x for r in frame.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_url_join_follows_the_standard_resolver(spark):
    bases = ["https://h.example.org:8080/a/b/c.html?x=1#f", "http://a/b/c/d;p?q", "http://h.org",
             "http://h/a//b/c"]
    refs = ["/r", "r", "./r", "../r", "../../r", "../../../r", "?q=2", "#g", "", "//o.example.net/z",
            "HTTP://E.org/x", "mailto:a@e.org", "r/../s", "g;x", "g?y#s", "..", "../", "./g/.", "g/./h",
            "g/../h", "/./g", "/../g", "g.", "..g", "./../g", "/a//b", "x//y"]
    rows = [(b, r, urljoin(b, r)) for b in bases for r in refs]
    frame = spark.createDataFrame(rows, "b string, r string, want string")
    wrong = frame.withColumn("got", U.url_join(F.col("b"), F.col("r"))).filter("got <> want")
    assert wrong.collect() == []


def test_url_join_without_base_keeps_the_reference(spark):
    assert values(spark, ["/x"], lambda c: U.url_join(F.lit(""), c)) == ["/x"]


@pytest.mark.parametrize("url,safe", [
    ("http://9.255.255.255/", True), ("http://11.0.0.0/", True), ("http://10.0.0.0/", False),
    ("http://10.255.255.255/", False), ("http://172.15.255.255/", True), ("http://172.16.0.0/", False),
    ("http://172.31.255.255/", False), ("http://172.32.0.0/", True), ("http://192.167.255.255/", True),
    ("http://192.168.0.0/", False), ("http://192.168.255.255/", False), ("http://192.169.0.0/", True),
    ("http://127.0.0.1/", False), ("http://127.1/", False), ("http://2130706433/", False),
    ("http://0x7f000001/", False), ("http://0177.0.0.1/", False), ("http://169.254.169.254/", False),
    ("http://169.253.255.255/", True), ("http://169.255.0.0/", True), ("http://user@10.0.0.1:80/x", False),
    ("http:///x", False), ("http://[::1]/", False), ("http://1.2.3.256/", False),
    ("ftp://8.8.8.8/", False), ("javascript:x", False), ("/rel", False), ("", False),
    ("HTTP://8.8.8.8/", True),
])
def test_safe_url_literals(spark, url, safe):
    assert values(spark, [url], lambda c: U.safe_url(c)) == [safe]


def test_safe_url_hosts_and_suffixes(spark):
    hosts = spark.createDataFrame(
        [("ok.example.org", "93.184.216.34"), ("in.example.org", "10.0.0.5")], "host string, ipv4 string")
    urls = ["http://ok.example.org/", "https://in.example.org/", "http://none.example.org/",
            "ftp://ok.example.org/", "HTTP://ok.example.org/", "http://x.onion/", None]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    kept = lambda t: {r.u for r in filter_safe(frame, "u", t, hosts).collect()}
    assert kept(()) == {"http://ok.example.org/", "HTTP://ok.example.org/"}
    assert kept((".onion",)) == {"http://ok.example.org/", "HTTP://ok.example.org/", "http://x.onion/"}


def test_decode_entities_once(spark):
    assert values(spark, ["a &lt; b &amp;lt; c &#39;d&#x41; &bogus; &#xD800;", "a &amp; b", "x", None],
                  T.decode_entities) == ["a < b &lt; c 'dA &bogus; �", "a & b", "x", None]


def test_pystrip_matches_python(spark):
    rows = ["  a b \n", "\x1c\x85x　", "plain", " \t"]
    assert values(spark, rows, T.pystrip) == [r.strip() for r in rows]


def test_invisible_characters(spark):
    yes = "​‌‍⁠﻿­\x00\x08\x0b\x0c\x0e\x1f"
    no = "\t\n\r ‎\x7f"
    rows = [f"a{c}b" for c in yes + no] + ["x" * 600 + "​"]
    assert values(spark, rows, T.has_invisible) == [True] * len(yes) + [False] * len(no) + [True]


def test_tokens_and_attributes(spark):
    html = ("""<p>a < b<a title="x > y" href="/q">t</a><!-- <b> --><script>var t="</p>";</script>"""
            """<img alt=it's src='a b'><a data-href=x HREF=/z?a=1&amp;b=2>""")
    frame = spark.createDataFrame([(html,)], "h string")
    rows = frame.select(F.explode(split_tokens(without_raw_text(F.col("h")))).alias("t")).select(
        "t", attr(F.col("t"), "href").alias("href"), attr(F.col("t"), "src").alias("src")).collect()
    assert [r.t for r in rows] == ["<p>", "a ", "<", " b", '<a title="x > y" href="/q">', "t", "</a>",
                                   "<img alt=it's src='a b'>", "<a data-href=x HREF=/z?a=1&amp;b=2>"]
    assert [r.href for r in rows if r.href] == ["/q", "/z?a=1&b=2"]
    assert [r.src for r in rows if r.src] == ["a b"]


def test_markdown_text_rules(spark):
    assert values(spark, ["[a\nb](u) [c] x\ny", "[open\n"], escape_bracket_newlines) == [
        "[a\\\nb](u) [c] x\ny", "[open\n"]
    assert values(spark, ["a\n\n\n\nb\n"], collapse_blank_lines) == ["a\n\nb"]
    assert values(spark, ["[Skip to content](#c)x", "[skip to main content](#m)", "[skip to content](/c)"],
                  remove_skip_links) == ["x", "", "[skip to content](/c)"]
    assert values(spark, ["a![x](data:image/png;base64,AA)b"], remove_data_images) == ["ab"]


def test_small_url_helpers(spark):
    assert values(spark, ["http://h/x//"], U.trim_slashes) == ["http://h/x"]
    assert values(spark, ["a | b | http://h/x", "http://h/y"], U.item_url) == ["http://h/x", "http://h/y"]
    assert values(spark, ["two words&more"], lambda c: U.search_url(F.lit("http://h/"), F.lit("q"), c)) == [
        "http://h/?q=two+words%26more"]
    assert values(spark, ["two words"], lambda c: U.plus_search_url(F.lit("http://h/"), c)) == [
        "http://h/?q=two+words"]
