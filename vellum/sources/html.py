"""HTML to Markdown.  [SRC9]  Headings, paragraphs, lists, links, emphasis, tables, code and line breaks; scripts, styles,
navigation and page footers are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SKIP = {"script", "style", "head", "nav", "template", "noscript", "svg", "footer"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "ul", "ol", "table", "blockquote", "pre", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "li", "body", "html"}
_VOID = {"br", "img", "meta", "link", "hr", "input", "source", "wbr"}
_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.prefix = ""
        self.links: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell = False

    def end_cell(self) -> None:
        """Close an open table cell; its end tag may be missing."""
        if self.cell and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.line)).strip().replace("|", "\\|"))
            self.line = []
        self.cell = False

    def flush(self) -> None:
        text = "\n".join(re.sub(r"\s+", " ", x).strip() for x in "".join(self.line).split("\x00")).strip()
        text = re.sub(r"\*\*\s*\*\*|``", "", text)
        if text and self.rows is None:
            self.blocks.append(self.prefix + text)
        self.line, self.prefix = [], "" if self.rows is None else self.prefix

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "br":
            self.line.append("\x00")
        elif tag in ("td", "th") and self.rows is not None:
            self.end_cell()
            self.cell = True
        elif tag in _BLOCK:
            self.end_cell()
            self.flush()
            if tag == "table":
                self.rows = []
            elif tag == "tr" and self.rows is not None:
                self.rows.append([])
            elif tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "li" and self.lists:
                self.lists[-1][1] += 1
                self.prefix = "  " * (len(self.lists) - 1) + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. ")
            elif re.fullmatch("h[1-6]", tag):
                self.prefix = "#" * int(tag[1]) + " "
        elif tag in _MARK:
            self.line.append(_MARK[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.line.append("[")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("td", "th", "tr", "table"):
            self.end_cell()
        if tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]))
        elif tag in _BLOCK:
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag in _MARK:
            self.line.append(_MARK[tag])
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.line.append(f"]({href})")

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data)


def to_markdown(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    out: list[str] = []
    for b in reader.blocks:  # items of a list follow each other directly
        item = re.match(r"\s*(?:- |\d+\. )", b)
        if out and item and re.match(r"\s*(?:- |\d+\. )", out[-1].rsplit("\n", 1)[-1]):
            out[-1] += "\n" + b
        else:
            out.append(b)
    return "\n\n".join(out)


@F.pandas_udf(StringType())
def _convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(to_markdown)


def markdown(html: Column) -> Column:
    """Whole pages, in Arrow batches; null: empty."""
    return _convert(html)
