"""Result tables in HTML pages: rows told apart by their class, carried headers, continued rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of a page that are read at once, and rows that a task gives out at once.
PIECE, AT_ONCE = 1 << 20, 10_000


class TableRows(HTMLParser):
    """(class, cells) of every table row. A row that the page never closes ends with the next one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.cell = None
            self.rows.append((dict(attrs).get("class") or "", []))
        elif tag in ("td", "th") and self.rows:
            self.cell = []
            self.rows[-1][1].append("")

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.rows[-1][1][-1] = " ".join(f"{self.rows[-1][1][-1]} {data}".split())

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None


def rows_of(html: str | None) -> Iterator[tuple[str, list[str]]]:
    """(class, cells) of every table row as the page is read: no more than PIECE characters of rows are held. Pieces end before a tag, so a cell's text is whole."""
    parser, text, at = TableRows(), html or "", 0
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else text.rfind("<", at + 1, at + PIECE)
        end = end if end > at else text.find("<", at + PIECE)
        end = end if end > at else len(text)
        parser.feed(text[at:end])
        at = end
        yield from parser.rows[:-1]  # the last one may go on
        del parser.rows[:-1]
    yield from parser.rows


def table_rows(html: str | None) -> list[tuple[str, list[str]]]:
    return list(rows_of(html))


def results_of(html: str | None) -> Iterator[tuple[str | None, list[str]]]:
    """(category, cells) of result rows, with the cells of the rows that continue them."""
    category, last = None, None
    for kind, cells in rows_of(html):
        if kind in ("header", "result"):
            if last is not None:
                yield category, last
            category, last = (" ".join(cells), None) if kind == "header" else (category, list(cells))
        elif kind == "continued" and last is not None:
            last.extend(cells)
    if last is not None:
        yield category, last


def ranking_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, row, category (of the last header row), and the cells of result rows; a continued row adds its cells to the row before."""
    columns = [key, "row", "category", "cells"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for page, text in zip(batch[key], batch[html], strict=True):
                for n, (category, cells) in enumerate(results_of(text)):
                    out.append((page, n, category, cells))
                    if len(out) == AT_ONCE:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    return pages.select(key, html).mapInPandas(run, f"{key} long, row int, category string, cells array<string>")
