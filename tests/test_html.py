"""The table function and the matching of its rows against a plain walk over trees."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from haggle.functions import html


class Tree(HTMLParser):
    """Nested lists of [tag, attributes, children], for pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node, above=()):
    for child in node[2]:
        if not isinstance(child, str):
            yield child, (*above, child)
            yield from walk(child, (*above, child))


def fits(node, part):
    tag, cls = re.fullmatch(r"(\w*)((?:\.\w+)?)", part).groups()
    return (not tag or node[0] == tag) and (not cls or cls[1:] in node[1].get("class", "").split())


def brute(root, selector):
    *above, last = selector.split()
    out = []
    for node, path in walk(root):
        k = 0
        for x in path[:-1]:
            k += k < len(above) and fits(x, above[k])
        if fits(node, last) and k == len(above):
            out.append(node)
    return out


def text(node):
    return "".join(c if isinstance(c, str) else text(c) for c in node[2])


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth == 5 or rng.random() < 0.3:
            out.append(rng.choice(["x", "yy ", "z&amp;"]))
        else:
            tag = rng.choice(["div", "b", "span"])
            out.append(f'<{tag} class="{rng.choice(["k", "m k", ""])}" href="{rng.randint(0, 99)}">{page(rng, depth + 1)}</{tag}>')
    return "".join(out)


@pytest.mark.parametrize("selector", ["div", "div b", ".k b .m", "div div span", "b.k"])
def test_matches_are_those_of_a_walk(spark, selector):
    rng = random.Random(2)
    pages = [page(rng) for _ in range(25)]
    frame = spark.createDataFrame([(k, p, "tag") for k, p in enumerate(pages)], "place long, page string, tag string").withColumnRenamed("place", "key")
    got = {}
    for r in html.rows(frame, "page", selector, {"href": "= @href", "all": "= string", "own": "= text", "second": "b ~1 > span @href"}).collect():
        got.setdefault(r.key, []).append((r.place, r.href, r["all"], r.own, r.second, r.tag))
    for k, p in enumerate(pages):
        tree = Tree()
        tree.feed(p)
        tree.close()
        want = []
        for n, node in enumerate(brute(tree.root, selector)):
            own = [c for c in node[2] if isinstance(c, str)]
            bold = brute(node, "b")
            spans = brute(bold[1], "span") if len(bold) > 1 else []
            want.append((n, node[1]["href"], text(node), own[0] if own else None, spans[0][1]["href"] if spans else None, "tag"))
        assert sorted(got.get(k, [])) == want
    counted = html.matches(frame, "page", selector, "n").collect()
    assert {r.key: r.n for r in counted} == {k: len(got.get(k, [])) for k in range(len(pages))}


def test_lateral_in_sql(spark):
    spark.udtf.register("html_elements", html.html_elements)
    spark.createDataFrame([(1, '<p>a<br>b<p class="x">c</p><li>d<li>e'), (2, None)], "id int, page string").createOrReplaceTempView("stored_pages")
    out = spark.sql("SELECT id, e.tag, e.place, e.last, e.depth, e.texts.text AS texts FROM stored_pages, LATERAL html_elements(page, 'class') e ORDER BY id, place").collect()
    assert [(r.id, r.tag, r.place, r.last, r.depth, r.texts) for r in out] == [
        (1, "", 0, 10, 0, []), (1, "p", 1, 4, 1, ["a", "b"]), (1, "br", 3, 3, 2, []), (1, "p", 5, 6, 1, ["c"]), (1, "li", 7, 8, 1, ["d"]), (1, "li", 9, 10, 1, ["e"]), (2, "", 0, 0, 0, []),
    ]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT e.tag FROM stored_pages, LATERAL html_elements(page, page) e").collect()


def test_only_elements_that_fit_are_dealt(spark):
    frame = spark.createDataFrame([(1, "<b>1</b>" + "<i>2</i>" * 50)], "id int, page string")
    asked = html._Page()
    asked.add("b text")
    plan = asked.read(frame, "page")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    assert html.fields(frame, "page", {"b": "b text"}).first().b == "1"
    assert html.fields(frame.limit(0), "page", {"b": "b text"}).count() == 0 and html.fields(frame.withColumn("page", F.lit(None).cast("string")), "page", {"b": "b string"}).first().b is None
