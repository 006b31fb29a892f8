"""Elements of pages against the standard library's parser."""

import html.parser
import random

import duckdb

from gapline import plans
from gapline.sources import markup

SF = "/root/testdata/sf0.01"


class Second(html.parser.HTMLParser):
    """Start tags with attributes and all text, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.text = [], []

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.tags.append((tag, first))

    def handle_data(self, data):
        self.text.append(data)


def second(text):
    parser = Second()
    parser.feed(text)
    parser.close()
    return parser.tags, "".join(parser.text)


def own(text):
    import html as entities

    tags, said = [], []
    for kind, begin, end, *more in markup.tokens(text):
        if kind == "start":
            tags.append(tuple(more))
        elif kind != "end":
            said.append(text[begin:end] if kind == "raw" else entities.unescape(text[begin:end]))
    return tags, "".join(said)


def test_pages_of_the_table_equal_another_parser(spark):
    for row in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        assert own(row.html) == second(row.html)


def test_odd_markup_equals_another_parser():
    odd = ['<a href=x>1<b class="y z"  id=\'q\'>2</B></a>', "a < b && c > d &amp; &eacute;", "<p>x<br/>y<img src=a.png alt>z", "<!-- <p>no</p> --><i>yes</i>", "<script>if (a < b) '</p>'</script>t", "<style>p > a</style>", '<A HREF="a&amp;b" href="second">', "<!DOCTYPE html><x-y z>", "<p title='a > b'>t</p>", "", "plain"]
    for text in odd:
        assert own(text) == second(text), text


def test_anything_is_read_to_its_end():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(["<", ">", "/", "!", "--", "a", "b ", '"', "'", "=", "<p>", "</p>", "<script>", "</script>", "&amp;", "<br>", "\n", "?"], k=rng.randint(0, 25)))
        found = markup.elements(text)
        assert all(0 <= r[7] < r[8] <= len(text) and (r[1] is None or r[1] < r[0]) for r in found)


def test_tree():
    found = markup.elements("<ul><li>1<li><p>2<p>3 <b>x</ul> <div>a<br>b</p></div><p>end")
    assert [(r[3], r[6]) for r in found] == [("ul", ""), ("ul/li", "1"), ("ul/li", ""), ("ul/li/p", "2"), ("ul/li/p", "3"), ("ul/li/p/b", "x"), ("div", "ab"), ("div/br", ""), ("p", "end")]
    assert markup.elements(None) == []
    assert [(r[4], r[6]) for r in markup.elements("<title>x &lt; <b></title>y")] == [("title", "x < <b>")]  # the other parser takes it for markup


def test_table_function_and_what_is_read_from_it(spark):
    rows = [(1, '<html lang="en"><title>T</title><h1>H &amp; I</h1><a href="x">y</a><span data-x="93% of the 1,250 user reviews for this game are positive"></span><script type="application/ld+json">{"a": 1}</script>'), (2, None), (3, "no tags"), (4, "<p>5% of the 10 user reviews are positive</p>"), (5, "<p>50% of the 0 user reviews are positive</p>")]
    found = markup.page_elements(spark.createDataFrame(rows, "id int, page string"), "id", "page")
    assert {r.id for r in found.collect()} == {1, 4, 5}
    assert [tuple(r) for r in markup.heads(found, "id").filter("id = 1").collect()] == [(1, "en", "T", "H & I", 1, 0)]
    assert [tuple(r) for r in markup.linked_data(found, "id").collect()] == [(1, 5, '{"a": 1}')]
    assert sorted(map(tuple, markup.review_summary(found, "id").collect())) == [(1, 1250, 1162, 88), (4, 10, 0, 10)]
    spark.udtf.register("html_elements", markup.HtmlElements)
    assert spark.sql("SELECT tag FROM html_elements('<a><b>')").count() == 2


def test_heads_read_the_entities_of_their_sql(spark, tmp_path):
    """Cut and other entities stay as they are; pages without a title or without any element have a row."""
    rows = [(1, "<title>a &amp;&amp b &quot;c&quot</title><h1>d &amp;lt; &lt;e&#39;&nbsp;f</h1><p>x"), (2, '<html lang="de"><h1> g\n h </h1><a href="x">y</a></html>'), (3, "no tags"), (4, ""), (5, None), (6, '<html lang="">')]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(plans.ORACLE_SQL["SRC-16_page_heads"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"))
    found = plans.QUERIES["SRC-16_page_heads"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall()) and len(found) == 6
