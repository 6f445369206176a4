import random

from pyspark.sql import functions as F
import pytest

from tapeloom.functions.markup import (Outline, outline_attr, outline_links, outline_text, page_outline, stored_attr, stored_links,
                                       stored_text)
from tapeloom.plans import jobs
from tapeloom.sources import articles as art, pages as pg

SELECTORS = {"article_link_selector": "a.item", "title_selector": "h2.head",
             "publish_time_selector": "time.when", "content_selector": "section.body p",
             "channel_selector": "em.desk"}
LISTING = """<ul class="list"><li><a class="item" href="a1.html">one</a></li>
<li><a class="item" href="/n/a2.html#x">two</a><li><a href="skip.html">no</a><a class="item" href=" ">blank</a>
<a class="big item" href="a1.html">again</a><a class="item" href="https://other.test/a3">three</a></ul>"""


def article(title, time, attribute=True):
    stamp = f'<time class="when" datetime="{time}">x</time>' if attribute else f'<time class="when">{time}</time>'
    return f"""<html><main><p>outside</p><h2 class="head">{title}</h2>
    <section class="body"><p>first <b>bold</b></p><p>second</p></section><footer>{stamp}<em class="desk"> rates </em></footer></main></html>"""


def test_outline():
    page = Outline("<div class='x y'>a<p>b<p>c</div><p>d &amp; e<br>f<script>no</script></p>")
    assert outline_text(page, "div.x p", "|") == "b|c"
    assert outline_text(page, "p", "|") == "b|c|d & e f"
    assert outline_text(page, "div.y.x") == "a b c" and outline_text(page, ".y") == "a b c"
    assert outline_text(page, "span") == "" and outline_attr(page, "div", "class") == "x y" and outline_attr(page, "p", "id") == ""
    assert outline_links(Outline(LISTING), "a.item", "http://h.test/d/list.html") == [
        "http://h.test/d/a1.html", "http://h.test/n/a2.html#x", "https://other.test/a3"]


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame([
        ("http://h.test/d/list.html", LISTING), ("http://h.test/d/a1.html", article("T1", "2024-03-11 09:12:00")),
        ("http://h.test/n/a2.html#x", article("T2", "2024-03-11 11:05:00", attribute=False)),
        ("https://other.test/a3", article("", "2024-03-12 08:00:00"))], "url string, html string")
    sources = spark.createDataFrame([
        ("s", "html_list_detail", True, "", 10, SELECTORS), ("off", "html_list_detail", False, "", 10, SELECTORS),
        ("odd", "other", True, "", 10, SELECTORS)], pg.SOURCES_SCHEMA)
    starts = spark.createDataFrame([("s", 0, "http://h.test/d/list.html"), ("s", 1, "http://h.test/d/list.html")],
                                   "source string, start_idx int, url string")
    return pages, sources, starts


def test_pages_to_articles(site):
    pages, sources, starts = site
    active = pg.enabled_sources(sources)
    assert [r.source for r in active.collect()] == ["s"] and [r.source for r in pg.unknown_adapters(sources).collect()] == ["odd"]
    links = pg.listing_links(pages, active, starts)
    assert {r.link for r in links.collect()} == {"http://h.test/d/a1.html", "http://h.test/n/a2.html#x", "https://other.test/a3"}
    assert pg.missing_details(links, pages.where("url not like '%a1%'")).count() == 1
    out = pg.parse_articles(pg.fetch_details(links, pages), active, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    rows = {r.url: r for r in out.collect()}
    one = rows["http://h.test/d/a1.html"]
    assert (one.title, one.content, one.channel, one.source) == ("T1", "first bold\nsecond", "rates", "s")
    assert str(one.publish_time) == "2024-03-11 09:12:00" and one.reject_reason is None and one.news_id.startswith("news_")
    assert str(rows["http://h.test/n/a2.html#x"].publish_time) == "2024-03-11 11:05:00"
    assert rows["https://other.test/a3"].reject_reason == "news_id is required"
    good = out.where("reject_reason is null")
    assert art.first_per_id(good).count() == 2


def test_broken_adapter_is_reported(site):
    pages, sources, starts = site

    def broken(html, selectors):
        raise KeyError("title")

    active = pg.enabled_sources(sources)
    details = pg.fetch_details(pg.listing_links(pages, active, starts), pages)
    out = pg.parse_articles(details, active, adapters={"html_list_detail": broken})
    assert out.where("parse_error = \"KeyError: 'title'\"").count() == 3


def test_extract_news_reports_what_it_leaves_out(spark, site, tmp_path):
    pages, sources, starts = site
    paths = jobs.Paths(str(tmp_path))
    pages.where("url not like '%a2%'").write.parquet(paths.pages)
    out = jobs.extract_news(spark, paths, sources, starts, F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")).collect()
    assert [r.title for r in out] == ["T1"]
    count = lambda name: spark.read.parquet(getattr(paths, name)).count()
    assert (count("missing_pages"), count("rejected_pages"), count("unknown_sources"), count("surplus_pages")) == (1, 1, 1, 0)


def test_limit_holds_for_a_source_with_most_links(spark):
    body = "".join(f'<a class="item" href="/x{i}">x</a>' for i in range(300))
    pages = spark.createDataFrame([("http://h.test/l", body), ("http://h.test/m", body)], "url string, html string")
    rows = [("hot", "html_list_detail", True, "", 7, SELECTORS), ("all", "html_list_detail", True, "http://b.test/", 0, SELECTORS)]
    sources = spark.createDataFrame(rows, pg.SOURCES_SCHEMA)
    starts = spark.createDataFrame([(s, i, u) for s in ("hot", "all") for i, u in enumerate(["http://h.test/m", "http://h.test/l"])],
                                   "source string, start_idx int, url string")
    got = pg.listing_links(pages, sources, starts, spread=4)
    assert sorted(r.link for r in got.where("source = 'hot'").collect()) == sorted(f"http://h.test/x{i}" for i in range(7))
    assert got.where("source = 'all' and link like 'http://b.test/x%'").count() == 300


def test_stored_outline_answers_as_the_parsed_page(spark):
    rng = random.Random(5)
    tags = ["<div class='x y'>", "<div class=x>", "</div>", "<p>", "</p>", "<p class='y'>", "<ul>", "<li>", "</ul>", "<a href='/q'>", "</a>",
            "<a class='x' href=' z#1 '>", "<script>", "</script>", "<template>", "</template>", "<br>", "<hr/>", "a", " b ", "\u00a0c", "&amp;"]
    pages = ["".join(rng.choices(tags, k=rng.randrange(0, 25))) for _ in range(250)] + [None, "", LISTING]
    selectors = ["p", "div p", ".x", "div.x.y", "div .x", "ul li a", "div div p", "a.x", "script", "template p", " div  p ", "a..x", "b"]
    rows = [(i, h, s) for i, h in enumerate(pages) for s in selectors]
    df = spark.createDataFrame(rows, "id int, h string, s string").withColumn("o", page_outline("h"))
    o, s = F.col("o"), F.col("s")
    got = df.select("h", "s", stored_text(o, s, "|").alias("text"), stored_attr(o, s, "class").alias("attr"),
                    stored_links(o, s, F.lit("http://h.test/d/")).alias("links")).collect()
    for r in got:
        page = Outline(r.h)
        want = outline_text(page, r.s, "|"), outline_attr(page, r.s, "class"), outline_links(page, r.s, "http://h.test/d/")
        assert (r.text, r.attr, r.links) == want, (r.h, r.s)


def test_articles_from_stored_outlines(site):
    pages, sources, starts = site
    active = pg.enabled_sources(sources)
    listed = pg.outline_pages(pages.where("url like '%list%'"))
    links = pg.listing_links(listed, active, starts)
    assert sorted(links.collect()) == sorted(pg.listing_links(pages, active, starts).collect())
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    plain = pg.parse_articles(pg.fetch_details(links, pages), active, now)
    stored = pg.parse_articles(pg.fetch_details(links, pg.outline_pages(pages, listed)), active, now)
    assert stored.columns == plain.columns and sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
    assert "MapInPandas" not in stored._jdf.queryExecution().executedPlan().toString()
    bare = active.withColumn("selectors", F.map_filter("selectors", lambda k, _: k != "content_selector"))
    for some in (pages, listed.unionByName(pg.outline_pages(pages.where("url not like '%list%'")))):
        out = pg.parse_articles(pg.fetch_details(links, some), bare, now)
        assert {r.parse_error for r in out.collect()} == {"KeyError: 'content_selector'"}
    own = {"html_list_detail": pg.read_list_detail, "other": lambda html, chosen: ("own", "2024-03-01 10:00:00", "c", "")}
    both = pg.fetch_details(links.unionByName(links.withColumn("source", F.lit("odd"))), pg.outline_pages(pages))
    found = pg.parse_articles(both, pg.enabled_sources(sources, own), now, own)
    assert found.where("source = 'odd' and title = 'own'").count() == 3 and found.where("source = 's'").count() == 3
