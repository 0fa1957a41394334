"""Tables of published files whose header may stand below a preamble: CSV, and XLSX read from its parts.

Files come through Spark's own readers, so any store that Spark reads will do. A workbook cannot be split, so each one is
a task; its rows are streamed out of the sheet's XML.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file in which its header is looked for; cells of a row that are read.
HEAD, CELLS = 25, 256


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    """A string's text: its own and that of its runs, without phonetic hints."""
    parts = [x.text or "" for x in node if _local(x.tag) == "t"]
    parts += [t.text or "" for run in node if _local(run.tag) == "r" for t in run if _local(t.tag) == "t"]
    return "".join(parts)


def _column(reference: str) -> int:
    """The column of a cell's reference, from 0: `A1` 0, `AB7` 27."""
    at = 0
    for c in re.match("[A-Z]*", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(x for x in tree.iter() if _local(x.tag) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            return "xl/" + link.get("Target").removeprefix("/").removeprefix("xl/")
    raise ValueError("the workbook's first sheet is not among its parts")


def workbook_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells) of the first sheet; rows and cells that are not stored are skipped or null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, node in ElementTree.iterparse(part):
                    if _local(node.tag) == "si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(_first_sheet(book)) as part:
            number = -1
            for _, node in ElementTree.iterparse(part):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", number + 2)) - 1
                cells: dict[int, str] = {}
                for cell in node:
                    at = _column(cell.get("r", "")) if cell.get("r") else max(cells, default=-1) + 1
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        value = next((_text(x) for x in cell if _local(x.tag) == "is"), None)
                    else:
                        value = next((x.text for x in cell if _local(x.tag) == "v"), None)
                        value = shared[int(value)] if kind == "s" and value is not None else value
                    if value is not None:
                        cells[at] = value
                yield number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                node.clear()


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of a CSV or XLSX file, cells as text, rows in the file's order."""
    if path.lower().endswith((".xlsx", ".xlsm")):

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for files in batches:
                for name, content in zip(files["path"], files["content"], strict=True):
                    part = []
                    for row, cells in workbook_rows(content):
                        part.append((name, row, cells))
                        if len(part) == 5000:
                            yield pd.DataFrame(part, columns=["path", "row", "cells"])
                            part = []
                    yield pd.DataFrame(part, columns=["path", "row", "cells"])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row long, cells array<string>")
    names = [f"c{i}" for i in range(CELLS)]
    # cells may hold line breaks, so a file is one task and its rows come in order
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=False, multiLine=True, escape='"')
    return rows.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("row"), F.array(*names).alias("cells"))


def read_sheet(spark: SparkSession, path: str, header_cell: str) -> DataFrame:
    """A table whose header is the first of a file's `HEAD` rows with a cell that starts with `header_cell`, else its first row."""
    rows = raw_rows(spark, path)
    head = rows.orderBy("path", "row").limit(HEAD).collect()
    starts = lambda r: any((c or "").strip().lower().startswith(header_cell.lower()) for c in r.cells)
    top = next((r for r in head if starts(r)), head[0] if head else None)
    if top is None:
        raise ValueError(f"{path!r} has no rows")
    named = {(name or "").strip(): i for i, name in reversed(list(enumerate(top.cells))) if (name or "").strip()}
    body = rows.where((F.col("path") > top.path) | (F.col("row") > top.row))
    return body.select(*[F.get("cells", F.lit(i)).alias(name) for name, i in sorted(named.items(), key=lambda x: x[1])])
