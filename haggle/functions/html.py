"""Fields of stored HTML by CSS selectors.

Web pages are no XML, so Spark's xpath functions cannot read them. A table function reads a page once and gives its elements as rows: tag, attributes, texts, and
a place in the order of the page with that of the last thing inside, so that an element lies in another if its place lies in the other's interval. What
fits a selector, which match counts and what lies where are column expressions: every part of a selector is a test of one
element, only elements that pass one go on, and they meet by page. The elements of a page come from one task, so they are put together before they are dealt.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of these ends an open one of the named ones beside it.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_TEXT = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType())])
ELEMENT = T.StructType([
    T.StructField("place", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("texts", T.ArrayType(_TEXT)),
])


class _Reader(HTMLParser):
    """Elements and texts are numbered in order of the page; element 0 is the page itself."""

    def __init__(self, keep: frozenset[str] | None):
        super().__init__(convert_charrefs=True)
        self.keep, self.n, self.after_text = keep, 0, False
        self.elements: list[list] = [[0, 0, 0, "", [], {}, []]]
        self.open = [self.elements[0]]

    def _close(self, upto: int) -> None:
        for element in self.open[upto:]:
            element[1] = self.n
        del self.open[upto:]
        self.after_text = False

    def _add(self, tag: str, attrs: list) -> list:
        self.n += 1
        attrs = dict(attrs)
        element = [self.n, self.n, len(self.open), tag, (attrs.get("class") or "").split(), attrs if self.keep is None else {k: v for k, v in attrs.items() if k in self.keep}, []]
        self.elements.append(element)
        self.after_text = False
        return element

    def handle_starttag(self, tag, attrs):
        if self.open[-1][3] in _ENDS.get(tag, ()):
            self._close(len(self.open) - 1)
        element = self._add(tag, attrs)
        if tag not in _VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][3] == tag:
                self._close(k)
                return

    def handle_data(self, data):
        texts = self.open[-1][6]
        if self.after_text:  # one text, which the parser gives in parts
            texts[-1] = (texts[-1][0], texts[-1][1] + data)
            return
        self.n += 1
        texts.append((self.n, data))
        self.after_text = True


class _Elements:
    """The table function: elements of a page in order, the page itself first. A null page has no other. Attributes but those named go."""

    @staticmethod
    def analyze(page: AnalyzeArgument, attributes: AnalyzeArgument) -> AnalyzeResult:
        if page.dataType not in (T.StringType(), T.NullType()):
            raise ValueError("the page must be a string")
        if not attributes.isConstantExpression or not isinstance(attributes.dataType, (T.StringType, T.NullType)):
            raise ValueError("attributes must be constant: names separated by commas, or null for all")
        return AnalyzeResult(ELEMENT)

    def eval(self, page: str | None, attributes: str | None) -> Iterator[tuple]:
        reader = _Reader(None if attributes is None else frozenset(attributes.split(",")))
        if page is not None:
            reader.feed(page)
            reader.close()
            reader._close(0)
        yield from map(tuple, reader.elements)


html_elements = F.udtf(_Elements)


def as_written(page: Column) -> Column:
    """A page whose texts and attributes come out of the reader as they are written in it, with no character reference read."""
    return F.replace(page, F.lit("&"), F.lit("&amp;"))


def elements(pages: DataFrame, html_col: str, attributes: list[str] | None = None) -> DataFrame:
    """The elements of pages, one row each: own (a struct of the page's other columns) and the columns of ELEMENT; attrs holds the named attributes (all without names)."""
    own = pages.select(F.struct(*(F.col(c) for c in pages.columns if c != html_col), F.monotonically_increasing_id().alias("_page")).alias("own"), F.col(html_col).alias("_html"))
    return own.lateralJoin(html_elements(F.col("_html").outer(), F.lit(None if attributes is None else ",".join(attributes)))).drop("_html")


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\]|:has\([^)]*\))*)")
_TEST = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]|:has\(([^)]*)\)")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inside(c: Column, root: Column) -> Column:
    return (c["place"] > root["place"]) & (c["place"] <= root["last"])


class _Page:
    """What rules ask of a page: a list of the elements that fit each part of a selector, and all texts if a rule wants the whole text of an element."""

    def __init__(self):
        self.parts: dict[str, int] = {}
        self.attributes = {"id"}
        self.whole = False

    def add(self, rule: str) -> None:
        """Note a rule, or a selector with the word after it."""
        steps, what = rule.rsplit(" ", 1)
        if what.startswith("@"):
            self.attributes.add(what[1:])
        self.whole |= what == "string"
        for step in steps.split(" > "):
            selector = step.partition(" ~")[0]
            if selector != "=":
                self._add_parts(selector)

    def _add_parts(self, selector: str) -> None:
        for part in selector.split():
            self.parts.setdefault(part, len(self.parts))
            for _, _, attr, _, within in _TEST.findall(_PART.fullmatch(part)[2]):
                self.attributes |= {attr} - {""}
                if within:
                    self._add_parts(within)

    @staticmethod
    def _fits(part: str) -> Column:
        """Whether an element fits a part of a selector, but for what it must hold."""
        tag, tests = _PART.fullmatch(part).groups()
        fits = F.col("tag") == tag if tag and tag != "*" else F.col("place") > 0
        for sign, name, attr, value, _ in _TEST.findall(tests):
            if sign == ".":
                fits &= F.array_contains("classes", name)
            elif sign == "#":
                fits &= F.coalesce(F.col("attrs")["id"] == name, F.lit(False))
            elif attr:
                fits &= F.coalesce(F.col("attrs")[attr] == value.strip("\"'"), F.lit(False)) if value else F.map_contains_key("attrs", attr)
        return fits

    def read(self, pages: DataFrame, html_col: str) -> DataFrame:
        """A row for each page: own, page (the element that it is), lists (the elements that fit each part) and texts."""
        found = elements(pages, html_col, sorted(self.attributes))
        element = F.struct("place", "last", "attrs", "texts")
        fits = [F.coalesce(self._fits(p), F.lit(False)) for p in self.parts]
        if not self.whole:
            wanted = F.col("place") == 0
            for f in fits:
                wanted |= f
            found = found.where(wanted)
        lists = [F.array_sort(F.collect_list(F.when(f, element)), lambda a, b: a["place"] - b["place"]).alias(f"list{k}") for k, f in enumerate(fits)]
        texts = [F.array_sort(F.flatten(F.collect_list("texts"))).alias("all_texts")] if self.whole else []
        return found.groupBy(F.col("own._page").alias("_page")).agg(F.any_value("own").alias("own"), F.max(F.when(F.col("place") == 0, F.struct("place", "last"))).alias("page"), F.max_by("texts", F.when(F.col("place") == 0, 1)).alias("page_texts"), *lists, *texts)

    def select(self, root: Column, selector: str) -> Column:
        """Elements inside root, in order of the page, that fit a chain of parts: tag, .class, #id, [attr=value], :has(chain)."""
        parts = selector.split()

        def holds(c: Column, part: str) -> Column:
            out = F.lit(True)
            for *_, within in _TEST.findall(_PART.fullmatch(part)[2]):
                if within:
                    out &= F.size(self.select(c, within)) > 0
            return out

        def under(c: Column, k: int) -> Column:
            if k < 0:
                return F.lit(True)
            return F.exists(F.col(f"list{self.parts[parts[k]]}"), lambda a: _inside(a, root) & _inside(c, a) & holds(a, parts[k]) & under(a, k - 1))

        return F.filter(F.col(f"list{self.parts[parts[-1]]}"), lambda c: _inside(c, root) & holds(c, parts[-1]) & under(c, len(parts) - 2))

    def pick(self, root: Column, rule: str) -> Column:
        """A field by a rule of steps `selector ~k > selector ~k what`; ~k takes the k-th match, the first without it.

        what is text (the first text directly in the element; text:1 the second), string (all text inside) or @attribute. The
        selector = stays where it is. A step that finds nothing gives null.
        """
        steps, what = rule.rsplit(" ", 1)

        def value(e: Column) -> Column:
            if what.startswith("@"):
                return e["attrs"][what[1:]]
            if what == "string":
                return F.when(e["place"].isNotNull(), F.array_join(F.transform(F.filter("all_texts", lambda t: _inside(t, e)), lambda t: t["text"]), ""))
            return F.get(e["texts"], F.lit(int(what.partition(":")[2] or 0)))["text"]

        def follow(e: Column, rest: list[str]) -> Column:
            if not rest:
                return value(e)
            selector, _, k = rest[0].partition(" ~")
            if selector == "=":
                return follow(e, rest[1:]) if int(k or 0) == 0 else F.lit(None).cast("string")
            return _bound(F.get(self.select(e, selector), F.lit(int(k or 0))), lambda x: follow(x, rest[1:]))

        return follow(root, steps.split(" > "))


def _whole_page() -> Column:
    return F.struct(F.col("page.place").alias("place"), F.col("page.last").alias("last"), F.create_map().cast("map<string,string>").alias("attrs"), F.col("page_texts").alias("texts"))


def fields(pages: DataFrame, html_col: str, rules: dict[str, str]) -> DataFrame:
    """pages without the HTML, but with a text for each rule (see _Page.pick); what is not there, and all of a null page, is null."""
    page = _Page()
    for rule in rules.values():
        page.add(rule)
    found = page.read(pages, html_col).withColumn("page", _whole_page())
    return found.select(*(F.col("own")[c].alias(c) for c in pages.columns if c != html_col), *(page.pick(F.col("page"), rule).alias(c) for c, rule in rules.items()))


def rows(pages: DataFrame, html_col: str, selector: str, rules: dict[str, str]) -> DataFrame:
    """A row for each match of the selector, with the page's columns but for the HTML, its place among the matches (from 0) and a text for each rule."""
    page = _Page()
    for rule in (f"{selector} match", *rules.values()):
        page.add(rule)
    matches = page.select(F.col("page"), selector)
    read = F.transform(matches, lambda m: F.struct(*(page.pick(m, rule).alias(c) for c, rule in rules.items())))
    found = page.read(pages, html_col).select("own", F.posexplode(read).alias("place", "r"))
    return found.select(*(F.col("own")[c].alias(c) for c in pages.columns if c != html_col), "place", "r.*")


def matches(pages: DataFrame, html_col: str, selector: str, name: str) -> DataFrame:
    """pages without the HTML, but with the number of the selector's matches, null for a null page."""
    page = _Page()
    page.add(f"{selector} match")
    found = page.read(pages.withColumn("_stored", F.col(html_col).isNotNull()), html_col)
    return found.select(*(F.col("own")[c].alias(c) for c in pages.columns if c != html_col), F.when(F.col("own")["_stored"], F.size(page.select(F.col("page"), selector))).alias(name))
