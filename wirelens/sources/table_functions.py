"""Table functions over html for SQL: `SELECT ... FROM pages, LATERAL page_links(html)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wirelens.sources.dom import parsed


class PageLinks:
    """A row for each link with an address, in the page's order: place from 0, href, text."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str, str]]:
        if html:
            with parsed(html) as page:
                for place, link in enumerate(n for n in page.find_all(("a",)) if n.attributes.get("href") is not None):
                    yield place, link.attributes["href"], link.text()


class PageBlocks:
    """A row for each block of text (headlines and paragraphs) that isn't empty: place from 0, tag, text."""

    TAGS = ("h1", "h2", "h3", "p", "li", "blockquote")

    def eval(self, html: str | None) -> Iterator[tuple[int, str, str]]:
        if html:
            with parsed(html) as page:
                found = ((n.tag, n.text()) for n in page.find_all(self.TAGS))
                for place, (tag, text) in enumerate((t, x) for t, x in found if x):
                    yield place, tag, text


page_links = F.udtf(PageLinks, returnType="place int, href string, link string", useArrow=True)
page_blocks = F.udtf(PageBlocks, returnType="place int, tag string, block string", useArrow=True)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL. Null and empty pages give no rows."""
    spark.udtf.register("page_links", page_links)
    spark.udtf.register("page_blocks", page_blocks)
