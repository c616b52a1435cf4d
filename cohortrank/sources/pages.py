"""Tables and links out of landed web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


#: Tags whose text makes a block of its own.
BLOCKS = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dt", "dd", "pre", "blockquote"}


class Blocks(HTMLParser):
    """Collects (tag, text) of the innermost blocks of a page; scripts and styles are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.tag, self.text, self.hidden = None, "", 0

    def settle(self):
        if self.tag and (text := " ".join(self.text.split())):
            self.blocks.append((self.tag, text))
        self.tag, self.text = None, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in BLOCKS:
            self.settle()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == self.tag:
            self.settle()

    def handle_data(self, data):
        if not self.hidden and self.tag:
            self.text += data

    def close(self):
        super().close()
        self.settle()


#: What the HTML standard lets a cell span at most.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def whole_number(text: str | None, most: int) -> int:
    """A span as browsers read it: digits, at most so many; 1 where it says nothing."""
    return min(int(text), most) if text and re.fullmatch("[0-9]+", text.strip()) else 1


class Tables(HTMLParser):
    """Collects (table, row, cells, first link, is header) of a page. A cell that spans columns or rows repeats in each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str], str | None, bool]] = []
        self.links: list[tuple[str, str]] = []
        self.table, self.row, self.open = -1, -1, None
        self.cells: list[str] = []
        self.header, self.first, self.href, self.label, self.span = True, None, None, "", (1, 1)
        self.carried: dict[int, tuple[str, int]] = {}  # of a column: the text from above and how many rows it still takes
        self.below: dict[int, tuple[str, int]] = {}

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "table":
            self.table, self.row, self.carried = self.table + 1, -1, {}
        elif tag == "tr":
            self.row, self.cells, self.header, self.first = self.row + 1, [], True, None
            self.below = {}
        elif tag in ("td", "th"):
            columns, rows = whole_number(at.get("colspan"), MOST_COLUMNS), whole_number(at.get("rowspan"), MOST_ROWS)
            self.open, self.span = "", (max(columns, 1), rows or MOST_ROWS)  # 0 rows: all that follow
            self.header = self.header and tag == "th"
        elif tag == "a" and at.get("href"):
            self.href, self.label = at["href"], ""
            if self.open is not None:
                self.first = self.first or at["href"]

    def fill(self):
        """Cells from rows above that stand where the next cell would."""
        while (column := len(self.cells)) in self.carried:
            self.cells.append(self.carried[column][0])

    def handle_data(self, data):
        if self.open is not None:
            self.open += data
        if self.href is not None:
            self.label += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open is not None:
            self.fill()
            text, (columns, rows) = " ".join(self.open.split()), self.span
            if rows > 1:
                self.below |= {c: (text, rows - 1) for c in range(len(self.cells), len(self.cells) + columns)}
            self.cells += [text] * columns
            self.open = None
        elif tag == "tr" and self.table >= 0:
            if self.cells:
                self.fill()
                self.rows.append((self.table, self.row, self.cells, self.first, self.header))
            self.carried = {c: (text, left - 1) for c, (text, left) in self.carried.items() if left > 1} | self.below
            self.cells, self.below = [], {}
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join(self.label.split())))
            self.href = None


def parsed(html: str | None) -> Tables:
    """Commented-out tables count too."""
    reader = Tables()
    reader.feed(re.sub(r"<!--(.*?)-->", lambda m: m[1] if "<table" in m[1] else "", html or "", flags=re.S))
    reader.close()
    return reader


def table_rows(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, table, row, cells, first_link) of every table row; spanned cells repeat, and header rows that repeat the
    first are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                heads: dict[int, list[str]] = {}
                for table, row, cells, link, header in parsed(text).rows:
                    if header and heads.setdefault(table, cells) is not cells and heads[table] == cells:
                        continue
                    out.append((k, table, row, cells, link))
            yield pd.DataFrame(out, columns=[key, "table", "row", "cells", "first_link"])

    return pages.select(key, html).mapInPandas(run, f"{key} string, table int, row int, cells array<string>, first_link string")


def links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, position, href, label) of every link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, href, label) for k, text in zip(pdf[key], pdf[html], strict=True) for i, (href, label) in enumerate(parsed(text).links)]
            yield pd.DataFrame(out, columns=[key, "position", "href", "label"])

    return pages.select(key, html).mapInPandas(run, f"{key} string, position int, href string, label string")


def text_blocks(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, row, tag, text) of every block of text, in the page's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                reader = Blocks()
                reader.feed(text or "")
                reader.close()
                out += [(k, i, tag, x) for i, (tag, x) in enumerate(reader.blocks)]
            yield pd.DataFrame(out, columns=[key, "row", "tag", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} string, row int, tag string, text string")
