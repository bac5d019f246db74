"""Web pages as a table of blocks, and as Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_BLOCKS = {"p", "div", "section", "article", "td", "th", "pre", "blockquote", "title", "header", "footer", "nav", "main"}
_HIDDEN = {"script", "style", "noscript", "template"}


class Blocks(HTMLParser):
    """Collects (kind, level, text, href) in document order; a block ends where another begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.text, self.kind, self.level, self.hidden, self.lists, self.href, self.link = [], [], "text", 0, 0, 0, None, []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.rows.append((self.kind, self.level, text, None))
        self.text, self.kind, self.level = [], "text", 0

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists += 1
        elif tag in _HEADINGS:
            self.flush()
            self.kind, self.level = "heading", _HEADINGS[tag]
        elif tag == "li":
            self.flush()
            self.kind, self.level = "item", self.lists
        elif tag in _BLOCKS or tag in ("br", "tr"):
            self.flush()
        elif tag == "a":
            self.href, self.link = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.href is not None:
            self.rows.append(("link", 0, " ".join("".join(self.link).split()), self.href))
            self.href = None
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = max(0, self.lists - 1)
        elif tag in _HEADINGS or tag == "li" or tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.href is not None:
                self.link.append(data)


def blocks_of(html: str | None) -> list[tuple]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.rows


def html_blocks(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> page_id, block_no, kind (heading, item, text, link), level, text, href."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *x) for i, h in zip(b["page_id"], b["html"]) for k, x in enumerate(blocks_of(h))]
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "kind", "level", "text", "href"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, block_no long, kind string, level int, text string, href string")


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown: headings, list items and paragraphs in order."""
    b = html_blocks(pages).where("kind <> 'link'")
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), "text")).otherwise(F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("block_no", line.alias("x"))))
    return b.groupBy("page_id").agg(F.array_join(F.transform(rows, lambda x: x["x"]), "\n\n").alias("markdown"))
