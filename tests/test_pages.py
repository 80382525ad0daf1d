import time
import tracemalloc

import pyarrow as pa
import pytest

from moodspark import fixed_values as fv
from moodspark.plans import collect
from moodspark.sources import pages as p
from moodspark.sources.scan import Scan, visible
from tests.conftest import rows

VOTED = """<html><head><script>var x = '<h1 id="article_title">no</h1>';</script></head><body>
<!-- <p dir="ltr">hidden</p> -->
<a href="/ru/2025/01/one">1</a> <a class='x' href='/ru/2025/01/one'>again</a> <a href="/en/2025/02">en</a>
<a href="/ru/news/2024/1">old</a> <a href="/ru/x/2025/7?a=1&amp;b=2">two</a>
<h1 class="big" id="article_title">Title &amp; <b>more</b> &#1078;</h1>
<p dir="ltr">First <i>line</i></p><p dir="ltr">   </p><p dir="rtl">skipped</p><p dir="ltr">Second<br>part</p>
<div class="comment-body extra"><h4 class="comment-user">Ann</h4><div><p>Good <b>one</b></p></div>
  <span class="up-votes-count">12</span><span class="down-votes-count">3</span></div>
<div class="comment-body"><p>No author</p><span class="up-votes-count">1</span><span class="down-votes-count">1</span></div>
<div class="comment-body"><h4 class="comment-user">Bob</h4><p>No votes</p></div>
<div class="comment-body"><h4 class="comment-user">Eve</h4><p>Odd votes</p>
  <span class="up-votes-count">many</span><span class="down-votes-count"> 4 </span></div>
<div class="not-comment-body"><h4 class="comment-user">Z</h4><p>Other</p></div>
</body></html>"""

REACTED = """<h2 class="sh-title"><a href="https://other.org/a">A</a></h2><a href="/cat/b">B</a><a href="c/d">C</a>
<a href="//cdn.org/cat/x">X</a><a href="#top">T</a><a href="">empty</a>
<h1 class="post-title"> Head </h1><div class="detail-text">Body <p>in two</p> parts</div>
<div class="comment-content"><p>One</p><p> </p><p>Two</p></div><div class="comment-content"><p>Three</p></div>
<div class="pc-emotions-item" title="Грусть"><span class="pc-emotions-item-counter"> 7 </span></div>
<div title="Радость" class="pc-emotions-item on"><i class="pc-emotions-item-counter">5²</i></div>
<div class="pc-emotions-item"><span class="pc-emotions-item-counter">9</span></div>
<div class="pc-emotions-item" title="Шок"></div>
<div class="pc-emotions-item" title="Нравится"><b class="pc-emotions-item-counter">1k</b></div>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, "https://voted.org/ru/a", VOTED), (2, "https://react.org/x/y", REACTED), (3, "https://empty.org", "")],
        "page_id bigint, url string, html string",
    )


def on(pages, n):
    return pages.where(f"page_id = {n}")


def test_links(pages):
    got = rows(p.extract_links(on(pages, 1), fv.VOTED_LINK))
    assert got == [("https://voted.org/ru/2025/01/one",), ("https://voted.org/ru/x/2025/7?a=1&b=2",)]
    got = rows(p.extract_links(on(pages, 1), "^/ru/.*2025/"))
    assert got == [("https://voted.org/ru/2025/01/one",), ("https://voted.org/ru/x/2025/7?a=1&b=2",)]
    twice = p.extract_links(on(pages, 1), "^/ru/2025", dedupe=False)
    assert twice.count() == 2
    got = rows(
        p.extract_links(on(pages, 2), fv.REACTION_PAGE_LINK, inside=p.Element(*fv.REACTION_PAGE_LINK_HEADING))
    )
    assert got == [("https://other.org/a",), ("https://react.org/cat/b",)]
    got = rows(p.extract_links(on(pages, 2), base="https://b.org/q/"))
    assert ("https://b.org/q/c/d",) in got and ("https://cdn.org/cat/x",) in got
    assert ("https://b.org/q/#top",) in got and len(got) == 5


def test_articles(pages):
    assert rows(p.extract_articles(on(pages, 1), p.VOTED_ARTICLE)) == [
        (1, "https://voted.org/ru/a", "Title & more ж", "First line\nSecond\npart")
    ]
    assert rows(p.extract_articles(on(pages, 2), p.REACTION_PAGE_ARTICLE)) == [
        (2, "https://react.org/x/y", "Head", "Body in two\nparts")
    ]
    assert rows(p.extract_articles(on(pages, 3), p.VOTED_ARTICLE)) == [(3, "https://empty.org", "", "")]
    assert rows(p.extract_articles(on(pages, 3), p.POST_ARTICLE)) == [(3, "https://empty.org", "", "")]


def test_comments(pages):
    got = rows(p.extract_comments(pages, p.VOTED_COMMENTS).drop("url"))
    assert got == [(1, 0, "Good one", 12, 3), (1, 3, "Odd votes", None, 4)]
    got = rows(p.extract_comments(pages, p.REACTION_PAGE_COMMENTS, text_only=True).drop("url"))
    assert got == [(2, 0, 0, "One"), (2, 0, 2, "Two"), (2, 1, 0, "Three")]


def test_reactions(pages):
    got = rows(p.extract_reactions(pages).drop("url"))
    assert got == [(2, 0, "Грусть", 7), (2, 1, "Радость", 0), (2, 4, "Нравится", 0)]


def test_character_references(spark):
    df = spark.createDataFrame([("&lt;a&gt; &#65;&#1f;&#128077; &amp;lt; &#0; x\u0001y",)], "h string")
    got = df.select(p.inner_text(df.h)).collect()[0][0]
    assert got == "<a> A&#1f;👍 &lt; &#0; x\u0001y"


POST = """<h1 class="_ap3a x">A caption</h1><ul><ul><li><h3><a href="/me">me</a></h3>
<span class="_ap3a">A comment that is long enough</span></li><li><span class="_ap3a">short</span></li>
<li><span class="_ap3a">@someone @else @third</span></li><li><span class="_ap3a">👍👍👍👍👍👍👍👍👍👍👍👍👍</span></li></ul></ul>"""


def test_posts(spark):
    df = spark.createDataFrame([(1, "https://p.org/p/1", POST)], "page_id bigint, url string, html string")
    got = collect.collect_posts(df, p.POST_ARTICLE, p.POST_COMMENTS, "acc").drop("id")
    assert rows(got) == [("acc", "https://p.org/p/1", "A caption", "A comment that is long enough")]


def test_outlet_and_refresh(spark):
    visits = [
        (1, "https://r.org/1", '<h1 class="post-title">first</h1><div class="comment-content"><p>a</p></div>'),
        (2, "https://r.org/2", '<h1 class="post-title">two</h1><div class="comment-content"><p>b</p><p>c</p></div>'
            '<div class="pc-emotions-item" title="Грусть"><i class="pc-emotions-item-counter">3</i></div>'),
        (3, "https://r.org/1", '<h1 class="post-title">again</h1><div class="comment-content"><p>d</p></div>'),
    ]
    schema = "page_id bigint, url string, html string"
    rules = (p.REACTION_PAGE_ARTICLE, p.REACTION_PAGE_COMMENTS, p.REACTIONS, True)
    old = collect.collect_outlet(spark.createDataFrame(visits, schema), *rules)
    assert rows(old.articles.select("url", "title")) == [("https://r.org/1", "first"), ("https://r.org/2", "two")]
    named = old.articles.select("id", "url").withColumnRenamed("id", "article_id")
    assert rows(old.comments.join(named, "article_id").select("url", "comment")) == [
        ("https://r.org/1", "d"), ("https://r.org/2", "b"), ("https://r.org/2", "c"),
    ]
    assert rows(old.reactions.select("emotion", "count")) == [("Грусть", 3)]
    later = [(9, "https://r.org/2", '<h1 class="post-title">two, changed</h1>'), (10, "https://r.org/3", "")]
    new = collect.collect_outlet(spark.createDataFrame(later, schema), *rules)
    both = collect.refresh(old, new)
    assert rows(both.articles.select("url", "title")) == [
        ("https://r.org/1", "first"), ("https://r.org/2", "two"), ("https://r.org/3", ""),
    ]
    assert rows(both.comments.select("comment")) == [("d",)]
    assert both.reactions.count() == 0


def test_nested_elements_belong_to_their_own(spark):
    html = """<div class="detail-text"><p>first</p><div>pic</div><p>second</p></div><p>not body</p>
<div class="comment-content"><div>by <div>x</div></div><p>One</p></div>
<div class="comment-content">empty</div><p>FOOTER TEXT</p>"""
    df = spark.createDataFrame([(1, "https://r.org", html)], "page_id bigint, url string, html string")
    assert rows(p.extract_articles(df, p.REACTION_PAGE_ARTICLE))[0][3] == "first\npic\nsecond"
    assert rows(p.extract_comments(df, p.REACTION_PAGE_COMMENTS).drop("url")) == [(1, 0, "One")]
    assert rows(p.extract_comments(df, p.REACTION_PAGE_COMMENTS, text_only=True).drop("url")) == [(1, 0, 0, "One")]


def test_comments_only_in_inner_lists(spark):
    html = '<span class="_ap3a">menu</span><ul><li><span class="_ap3a">outer</span><ul><li><span class="_ap3a">in <span>it</span></span></li></ul></li></ul>'
    df = spark.createDataFrame([(1, "https://p.org", html)], "page_id bigint, url string, html string")
    assert rows(p.extract_comments(df, p.POST_COMMENTS).drop("url")) == [(1, 0, "in it")]


def test_forms_of_links_and_references(spark):
    html = """<a href=/x>1</a><a href='/it"s'>2</a><a href="/a'b">3</a>"""
    df = spark.createDataFrame([(1, "https://p.org", html)], "page_id bigint, url string, html string")
    assert rows(p.extract_links(df)) == [("https://p.org/a'b",), ('https://p.org/it"s',), ("https://p.org/x",)]
    text = spark.createDataFrame([("&#x27;a&rsquo; &eacute;&#X1F44D; &nothing;",)], "h string")
    assert text.select(p.inner_text(text.h)).collect()[0][0] == "'a’ é👍 &nothing;"


def test_ancestors_of_any_kind(spark):
    html = """<div class="head"><p>no</p></div><div class="main x"><p>one<section><p>two</section><p>three</div><p>four</p>
<div class="main"><section id="s"><div class="main"><p>five</section><p>six</div>"""
    df = spark.createDataFrame([(1, "https://p.org", html)], "page_id bigint, url string, html string")
    main = p.Element("div", "class", "main")
    for inside, want in (
        ((main,), ["one", "two", "three", "five", "six"]),
        ((main, p.Element("section")), ["two", "five"]),
        ((main, p.Element(None, "id", "s"), main), ["five"]),
        ((p.Element("section"), p.Element("section")), []),
    ):
        rule = p.ArticleRule(title=p.Element("h1"), paragraph=p.Element("p", inside=inside))
        assert rows(p.extract_articles(df, rule)) == [(1, "https://p.org", "", "\n".join(want))]


def test_tags_out_of_order():
    def found(html, *elements):
        return [[html[f.start : f.end] for f in each] for each in Scan(list(elements))(html)]

    div, bold, para = p.Element("div"), p.Element("b"), p.Element("P")
    assert found("<div>a<b>c</div>d</b>", div, bold) == [["a<b>c"], ["c"]]
    assert found("<b>a<div>c</b>d</div>e</b>f", div, bold) == [["c</b>d"], ["a<div>c</b>d</div>e"]]
    assert found("</div><p>a<i>b<div>c</p>d</div><p>e<br/>f", div, para) == [["c</p>d"], ["a<i>b", "e<br/>f"]]
    assert found("a < b <DIV\nid='x'>c<div/>d</div></div>", div, p.Element("div", "id", "x")) == [["c<div/>d</div>", "d"], ["c<div/>d</div>"]]
    assert found("<img class='b a'>x", p.Element(None, "class", "a")) == [[""]]
    assert visible("a<!-- <p> -->b<SCRIPT x>c</p></script >d<style>e<scripty>f<!--g") == "abd<style>e<scripty>f<!--g"


@pytest.mark.parametrize("part", ["<b>", "</i>", "<b></i>", "<p><b></i>", "<!--", "<script>", "<div><p>", "<div class='a'>", "<", "<a <"])
def test_long_pages_take_time_in_proportion(part):
    chain = (p.Element("div", "class", "a"),) * 3
    rule = p.PageRules(
        article=p.ArticleRule(title=p.Element("h1", inside=chain), paragraph=p.Element("p", inside=chain[:1])),
        comments=p.CommentRule(block=p.Element("div"), text=p.Element("b")), links=True, links_inside=p.Element("h2"),
    )
    read = p.Reader(rule)

    def seconds(n):
        start = time.process_time()
        read("<i><p><div class='a'>" + part * n)
        return time.process_time() - start

    seconds(100)
    assert min(seconds(40_000), seconds(40_000)) < 0.1 + 14 * max(seconds(5_000), 0.01)


def test_the_last_visit_counts(spark):
    visit = '<h1 class="_ap3a">{}</h1><ul><ul><span class="_ap3a">{} is a long comment</span></ul></ul>'
    seen = [(k, "https://p.org/p/1", visit.format(f"caption {k}", f"this {k}")) for k in (1, 3, 2)]
    df = spark.createDataFrame([*seen, (9, "https://p.org/p/2", None)], "page_id bigint, url string, html string")
    got = collect.collect_posts(df, p.POST_ARTICLE, p.POST_COMMENTS, "acc").drop("id")
    assert rows(got) == [("acc", "https://p.org/p/1", "caption 3", "this 3 is a long comment")]


def test_batches_hold_few_objects():
    """Of a large batch, the Python objects of a few pages are held at a time; results are those of one page after the other."""
    item = "<div class='pc-emotions-item' title='a'><b class='pc-emotions-item-counter'>1</b></div>"
    batch = pa.array([item * 300, None, "", item] * 150)
    reader = p.Reader(p.PageRules(reactions=p.REACTIONS))
    want = [reader(x.as_py()) for x in batch]
    tracemalloc.start()
    got = p._read(batch, reader)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x["reactions"]) for x in got.to_pylist()] == [len(x["reactions"]) for x in want]
    assert got.equals(pa.array(want, p._ARROW))
    assert peak < 6_000_000
