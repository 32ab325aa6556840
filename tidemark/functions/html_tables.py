"""HTML tables as rows and grids, with row and column spans filled in. What stands in them is read in operators/statements."""

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Fixed value: the columns that one cell may span, as in browsers.
MOST_SPANNED = 1000
#: Tags of tables that are read without the parser, where there are no others, no attributes and no references.
TAG, PLAIN = re.compile(r"<(/?[a-z]+)>"), frozenset(f"{s}{t}" for t in ("html", "body", "table", "thead", "tbody", "tr", "td", "th", "p", "br") for s in ("", "/"))


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def _close(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("tr", "td", "th"):
            self._close()
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            given = dict(attrs)
            n = lambda k: max(1, int(v)) if (v := (given.get(k) or "1").strip()).isdigit() else 1
            self.cell, self.span = [], (n("rowspan"), min(n("colspan"), MOST_SPANNED))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def grid(html: str) -> list[list[str]]:
    """Rows of cell texts. A spanned cell is repeated in every place that it covers; short rows are filled up with ''."""
    parser = _Cells()
    parser.feed(html)
    parser.close()
    parser._close()
    out: list[list[str]] = []
    above: dict[int, tuple[str, int]] = {}
    for cells in parser.rows:
        row: dict[int, str] = {c: text for c, (text, _) in above.items()}
        below = {c: (text, left - 1) for c, (text, left) in above.items() if left > 1}
        at = 0
        for text, rows, columns in cells:
            while at in row:
                at += 1
            for c in range(at, at + columns):
                row[c] = text
                if rows > 1:
                    below[c] = (text, rows - 1)
            at += columns
        above = below
        out.append([row.get(c, "") for c in range(max(row, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def rows(text: str) -> list[list[str]]:
    """Cells of each table row, spans not repeated; without a table, the words of each line that has some."""
    if "<table" not in text.lower():
        return [words for line in text.splitlines() if (words := line.split())]
    parts = TAG.split(text)
    if PLAIN.issuperset(parts[1::2]) and "&" not in text and not any("<" in data for data in parts[::2]):
        return _plain_rows(parts)
    parser = _Cells()
    parser.feed(text)
    parser.close()
    parser._close()
    return [[cell for cell, _, _ in row] for row in parser.rows if row]


def _plain_rows(parts: list[str]) -> list[list[str]]:
    """What the parser makes of text, tag, text, tag, ..., text."""
    out: list[list[str]] = [[]]
    cell: str | None = None
    for tag, data in zip(parts[1::2], parts[2::2], strict=True):
        if cell is not None and tag in ("tr", "td", "th", "/tr", "/td", "/th", "/table"):
            out[-1].append(" ".join(cell.split()))
            cell = None
        if tag == "tr":
            out.append([])
        elif tag in ("td", "th"):
            cell = data
            continue
        if cell is not None:
            cell += " " + data if tag == "br" else data
    if cell is not None:
        out[-1].append(" ".join(cell.split()))
    return [row for row in out if row]


@pandas_udf(ArrayType(ArrayType(StringType())))
def table_rows(texts: pd.Series) -> pd.Series:
    """Cells of each row of a text's tables; without a table, the words of each line that has some. Null: no rows."""
    return texts.map(lambda t: rows(t) if t else [])


@pandas_udf(ArrayType(ArrayType(StringType())))
def table_grid(texts: pd.Series) -> pd.Series:
    """As table_rows(), spanned cells repeated in every place that they cover and short rows filled up. Without a table, its lines' words."""
    return texts.map(lambda t: (grid(t) if "<table" in t.lower() else rows(t)) if t else [])


def cells(pages: DataFrame, key: str, html: str, spans: bool = True) -> DataFrame:
    """key, row_number, column_number, cell of each page's tables, parsed in Arrow batches."""
    found = pages.select(F.col(key), F.posexplode((table_grid if spans else table_rows)(html)).alias("row_number", "_row"))
    return found.select(key, "row_number", F.posexplode("_row").alias("column_number", "cell"))
