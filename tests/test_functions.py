import datetime as dt
import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import html as H
from pressgauge.functions import text as T
from pressgauge.functions import times as D
from pressgauge.functions import urls as U
from pressgauge.functions.registry import register


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://paper.example/story/77?utm_campaign=z&ref=home", "https://paper.example/story/77"),
        ("https://www.paper.example/Item.php?Id=31&utm_term=x", "https://paper.example/Item.php?Id=31"),
        ("http://www.a.com/x/#c", "https://a.com/x"), ("https://a.com/x?gclid=1", "https://a.com/x"),
        ("https://www.paper.example/", "https://paper.example/"), ("https://paper.example:443/q", "https://paper.example/q"),
        ("https://paper.example:9001/q", "https://paper.example:9001/q"), ("http://u:p@Host.org", "https://host.org/"),
        ("https://e.com/?b=2&a=1&c=~*%20x", "https://e.com/?a=1&b=2&c=~%2A+x"), ("  no host  ", "no host"), ("//a.com:443/x", "https://a.com/x"),
        ("ftp://a.com:443/x", "https://a.com/x"), ("https://a.com:0/x", "https://a.com:0/x"), ("https://a.com///", "https://a.com"), ("http://a.com:443/x", "https://a.com:443/x"),
        ("https://e.com:99999/x", None), ("https://e.com:abc/x", None), ("https://e.com/新聞?q=新", "https://e.com/新聞?q=%E6%96%B0"), (None, None), ("", ""),
    ],
)
def test_canonicalize(spark, url, want):
    assert one(spark, url, U.canonicalize) == want


@pytest.mark.parametrize("href", ["/n/1", "//c.d/e", "https://q/../", "k", "?p=2", "../x", "./x/./y", "../../../x?a=../b", "/a/b/../..", "a/..", "", "#f", "../", "..", "/./x//y"])
def test_resolve(spark, href):
    base = "https://a.b/x/y?z=1"
    assert one(spark, f" {href} ", lambda c: U.resolve(base, c)) == urljoin(base, href)


def test_titles(spark):
    assert one(spark, "號外」7:05", T.strip_trailing_clock) == "號外」"
    assert T.segment("早報 news，天文台x", ("早報", "天文台")).split() == ["早報", "news", "，", "天文台", "x"]
    assert T.segment("") is None and T.segment(None) is None


def test_dictionary_file(tmp_path):
    f = tmp_path / "terms.txt"
    f.write_text("# comment\n天文台 5 n\n\n早報\n", encoding="utf-8")
    assert T.load_terms(str(f)) == ("天文台", "早報")


def test_dates(spark):
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "2025/03/09 18:30:00", lambda c: show(D.listing_datetime(c))) == "2025-03-09 10:30:00"
    assert one(spark, "nonsense", lambda c: show(D.listing_datetime(c))) is None
    assert one(spark, "Fri, 05 Jan 2024 10:00:00 +0800", lambda c: show(D.feed_datetime(c))) == "2024-01-05 02:00:00"
    assert one(spark, "2025-03-09 18:30 +00:00", lambda c: show(D.free_datetime(c))) == "2025-03-09 18:30:00"
    assert one(spark, "2025-03-09 18:30 +00:00", lambda c: show(D.free_datetime(c, F.lit(True)))) == "2025-03-09 10:30:00"
    assert one(spark, "2025-03-09 09:00:00", lambda c: show(D.free_datetime(c))) == "2025-03-09 01:00:00"


def test_lenient_dates():
    good = {"Mar 9, 2025 9:00 AM": "2025-03-09 09:00:00", "9 March 2025 09:00": "2025-03-09 09:00:00", "20250309T090000Z": "2025-03-09 09:00:00+00:00", "Sun Mar  9 09:00:00 2025": "2025-03-09 09:00:00"}
    assert {t: H.iso_date(t) for t in good} == good
    assert [H.iso_date(t) for t in ("9:00", "Sunday", "soon", "", None, "2025-03-09 09:00", "9" * 400, "March")] == [None] * 8


PAGE = """<html><head><meta property="article:published_time" content="2025-03-09 09:00:00">
<script type="application/ld+json">{"datePublished": "2025-03-09T20:54:00+00:00"}</script></head>
<form><article><script>no</script><nav>menu</nav><p>one <b>two</p><p>three<style>x</style></article></form>"""


def test_html():
    assert H.body_text(PAGE) == "onetwo\nthree"
    assert H.body_text("<div>a</div><div>longer <i>text</i></div>") == "longer\ntext"
    assert H.body_text("<div>ab<section>cd</section></div><div>abcde</div>") == "abcde"
    assert H.body_text(None) == "" and H.body_text("plain") == ""
    assert H.time_candidates(PAGE) == ["2025-03-09T20:54:00+00:00", "2025-03-09 09:00:00"]
    assert H.article(PAGE) == {"body": "onetwo\nthree", "times": H.time_candidates(PAGE)}
    assert H.untagged({"rows": [1, [[0, {"a": [0, 3]}], [7, [0, 1]], [1, [[0, 4], [0, 5]]]]], "plain": [3, 4, 5]}) == {"rows": [{"a": 3}, [0, 1], [4, 5]], "plain": [3, 4, 5]}
    assert H.island_rows("<p>")["error"]


def island(props: str) -> dict:
    return H.island_rows(f'<astro-island component-url="RealTimeList" props="{props.replace(chr(34), "&quot;")}">')


def test_readers_never_raise():
    entry = lambda at: '{"initialArticles":[0,{"data":[1,[[0,{"articleId":[0,5],"title":[0,"T"],"publishedAt":[0,%s]}],"odd",[0,null],[0,[0,7]]]]}]}' % at
    for at, epoch in (('"x"', None), ("null", None), ("true", None), ("1700000000", 1700000000), ('"1700000000"', 1700000000), ("1e999", None), ("[0,[]]", None), ("0", None)):
        assert island(entry(at)) == {"error": None, "rows": [{"href": "/news/5", "title": "T", "epoch": epoch}]}, at
    for bad in ("", "[", "3", "[0,[0,3]]", '{"initialArticles":5}', '{"initialArticles":[0,{"data":[0,3]}]}', "[0," * 100_000):
        assert island(bad)["rows"] == []
    deep = "[" * 100_000
    assert H.time_candidates(f'<script type="application/ld+json">{deep}</script><time datetime=t>') == ["t"]
    assert H.untagged(json.loads("[0," * 900 + "1" + "]" * 900)) == 1
    assert len(H.body_text("<div>" * 20_000 + "x")) == 1


def test_registered(spark):
    register(spark, ("天文台",))
    assert spark.sql("SELECT segment_text('天文台x') AS s, article_body('<article>b</article>') AS b, island_rows('') AS i").first()[:2] == ("天文台 x", "b")


def test_future_time_is_skipped(spark):
    df = spark.createDataFrame([(["2025-03-09T20:54:00+00:00", "2025-03-09 09:00:00"], dt.datetime(2025, 3, 9, 12))], "c array<string>, seen timestamp")
    got = df.select(F.date_format(D.first_acceptable(F.col("c"), F.col("seen")), "HH:mm").alias("r")).first().r
    assert got == "01:00"
