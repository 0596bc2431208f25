"""Listing pages: table rows, anchors and page dates out of HTML, and source-specific adapters."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.functions.text import clean_text

# Text near a page's own modification date.
MODIFIED_CONTEXT = r"(?i)last\s+(?:modified|reviewed|updated)"

ELEMENT = (
    "kind string, table_at int, at int, headers array<string>, cells array<string>, "
    "hrefs array<string>, link_texts array<string>, context string, block_ids array<string>"
)


def _parser():
    """A function from HTML to its elements, as tuples of ``ELEMENT``.

    Made inside a function, so that executors receive the code itself and need no copy of this package.
    """
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    closes = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}

    class Tree(HTMLParser):
        """Element nodes as dictionaries: tag, attributes, parent and child nodes or texts."""

        def __init__(self, html):
            super().__init__(convert_charrefs=True)
            self.root = self.node = {"tag": "", "attrs": {}, "parent": None, "items": []}
            self.links = 0  # open ones
            self.feed(html)
            self.close()

        def handle_starttag(self, tag, attrs):
            while self.node["tag"] in closes.get(tag, ()):
                self.node = self.node["parent"]
            # A link inside a link ends it.
            if tag == "a" and self.links:
                self.handle_endtag("a")
            child = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "parent": self.node, "items": []}
            self.node["items"].append(child)
            if tag not in void:
                self.node = child
                self.links += tag == "a"

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            at = self.node
            while at["parent"] is not None and at["tag"] != tag:
                at = at["parent"]
            if at["parent"] is not None:
                self.links -= tag == "a"
                self.node = at["parent"]

        def handle_data(self, data):
            self.node["items"].append(data)

    def text(node):
        parts, waiting = [], [node]
        while waiting:
            at = waiting.pop()
            if isinstance(at, str):
                parts.append(at)
            elif at["tag"] not in ("script", "style"):
                waiting.extend(reversed(at["items"]))
        return "".join(parts)

    def find(node, *tags):
        waiting = list(reversed(node["items"]))
        while waiting:
            item = waiting.pop()
            if not isinstance(item, str):
                if not tags or item["tag"] in tags:
                    yield item
                waiting.extend(reversed(item["items"]))

    def enclosing(node, test):
        at = node
        while at is not None and not test(at):
            at = at["parent"]
        return at

    def classes(node):
        return node["attrs"].get("class", "").split()

    def page_elements(html):
        root = Tree(html or "").root
        for t, table in enumerate(find(root, "table")):
            headers = [text(h) for head in find(table, "thead") for h in find(head, "th")]
            block = enclosing(table, lambda n: "block" in classes(n))
            first = block is not None and next(find(block, "table"), None) is table
            ids = [n["attrs"]["id"] for n in find(block) if "id" in n["attrs"]] if first else []
            rows = [r for body in find(table, "tbody") for r in find(body, "tr")]
            for at, row in enumerate(rows):
                cells = list(find(row, "td"))
                links = [next((a for a in find(c, "a") if "href" in a["attrs"]), None) for c in cells]
                yield ("row", t, at, headers, [text(c) for c in cells],
                       [a["attrs"]["href"] if a else None for a in links],
                       [text(a) if a else None for a in links], text(row), ids)
        for at, anchor in enumerate(a for a in find(root, "a") if "href" in a["attrs"]):
            item = enclosing(anchor, lambda n: n["tag"] in ("li", "article") or "views-row" in classes(n))
            yield ("anchor", -1, at, [], [], [anchor["attrs"]["href"]], [text(anchor)],
                   text(item) if item else "", [])
        for at, stamp in enumerate(s for s in find(root, "time") if "datetime" in s["attrs"]):
            item = enclosing(stamp, lambda n: n["tag"] in ("p", "li", "div"))
            yield ("time", -1, at, [], [stamp["attrs"]["datetime"]], [], [text(stamp)],
                   text(item) if item else "", [])

    return page_elements


def extract_elements(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of kind ``row``, ``anchor`` and ``time`` for each page (page_id, html), beside the columns ``carry`` of the page.

    A row carries its table's headers, its cells, the first link of each cell and the ids found in
    the enclosing block before the table; an anchor or time carries the text of its nearest
    enclosing item. This is the only step that needs an HTML parser; all that follows is columns.
    """
    page_elements, kept = _parser(), ["page_id", *carry]
    names = [c.split()[0] for c in ELEMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for *page, html in batch[[*kept, "html"]].itertuples(index=False, name=None):
                found.extend((*page, *element) for element in page_elements(html))
                if len(found) > 5000:
                    yield pd.DataFrame(found, columns=[*kept, *names])
                    found = []
            yield pd.DataFrame(found, columns=[*kept, *names])

    rows = pages.select(*kept, "html")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInPandas(run, f"{types}, {ELEMENT}")


def register_page_elements(spark: SparkSession, name: str = "page_elements") -> None:
    """Make the elements of a page a table function of SQL: ``FROM pages p, LATERAL page_elements(p.html) e``.

    Which elements are entries of a source, and what their columns mean, is then plain SQL or a ``ListingSource``.
    """
    page_elements = _parser()

    @F.udtf(returnType=ELEMENT)
    class PageElements:
        def eval(self, html: str):
            yield from page_elements(html)

    spark.udtf.register(name, PageElements)


def page_modified_dates(elements: DataFrame) -> DataFrame:
    """(page_id, modified, modified_raw): the first dated element whose surroundings say last modified/reviewed/updated, with its text."""
    stamped = elements.filter((F.col("kind") == "time") & clean_text(F.col("context")).rlike(MODIFIED_CONTEXT))
    date = F.to_date(clean_text(F.col("cells")[0]).try_cast("timestamp"))
    return (
        stamped.withColumn("modified", date).filter(F.col("modified").isNotNull())
        .groupBy("page_id").agg(F.min_by("modified", "at").alias("modified"), F.min_by(clean_text(F.col("link_texts")[0]), "at").alias("modified_raw"))
    )
