"""Cells of workbooks (.xlsx): the sheets of a zipped folder of XML, and the trial sheets that name a recording's stretches. A workbook is one value of Spark's binary reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row int, col int, text string, number double"
# Name spaces of the parts of a workbook.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _text(node: ElementTree.Element) -> str:
    """Runs of text of a string item; phonetic hints aren't part of it."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == MAIN + "t" else child.iter(MAIN + "t") if child.tag == MAIN + "r" else []))


def cells(raw: bytes, wanted: str | None = None) -> Iterator[tuple[str, int, int, str, float | None]]:
    """(sheet, row, column, text, number) of the cells that hold a value; rows and columns count from 1. Whole numbers have no decimal point in their text; errors are texts, such as #N/A."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        parse = lambda name: ElementTree.fromstring(z.read(name))
        shared = [_text(item) for item in parse("xl/sharedStrings.xml").iter(MAIN + "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels").iter(PACKAGE + "Relationship")}
        for sheet in parse("xl/workbook.xml").iter(MAIN + "sheet"):
            name, target = sheet.get("name"), targets[sheet.get(LINK)]
            if wanted is not None and name != wanted:
                continue
            row = 0
            for line in parse(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(MAIN + "row"):
                row, col = int(line.get("r", row + 1)), 0
                for cell in line.iter(MAIN + "c"):
                    col = column_number(re.match("[A-Z]+", cell.get("r"))[0]) if cell.get("r") else col + 1
                    kind, value = cell.get("t", "n"), cell.find(MAIN + "v")
                    if kind == "inlineStr":
                        text = _text(cell.find(MAIN + "is"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    number = float(text) if kind == "n" else None
                    if number is not None and number.is_integer() and abs(number) < 1e15:
                        text = str(int(number))
                    if text:
                        yield name, row, col, text, number


def read_sheets(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file (its name without ending), sheet, row, col, text, number of the cells with a value in the workbooks below a folder, of all sheets or one. Number is null for texts. What is no workbook is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                stem = where.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame([(stem, *c) for c in cells(content, sheet)], columns=[c.split()[0] for c in CELLS.split(", ")])

    return files.mapInPandas(run, CELLS)


def sheet_rows(found: DataFrame) -> DataFrame:
    """file, sheet, row, values: each row's values, without its empty cells, in order of columns."""
    return found.groupBy("file", "sheet", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("values"))


def trial_segments(found: DataFrame) -> DataFrame:
    """file, sheet, segment, part, begin, end of trial sheets: a row's first value names the segment, the next two are where it begins and ends; lists with commas give several parts.

    Cells that repeat the sheet's name, the heading row Name, and rows without both places are left out. Places that aren't whole numbers, or lists of different lengths, are an error.
    """
    values = F.filter("values", lambda v: v != F.col("sheet"))
    rows = sheet_rows(found).withColumn("values", values).where((F.size("values") >= 3) & (F.get("values", F.lit(0)) != "Name"))
    lists = [F.split(F.get("values", F.lit(i)), r"\s*,\s*") for i in (1, 2)]
    rows = rows.select("file", "sheet", F.get("values", F.lit(0)).alias("segment"), lists[0].alias("b"), lists[1].alias("e"))
    even = F.when(F.size("b") != F.size("e"), F.raise_error(F.concat(F.lit("begins and ends differ in number: "), F.col("segment"))).cast("boolean")).otherwise(True)
    parts = rows.where(even).select("file", "sheet", "segment", F.posexplode(F.arrays_zip("b", "e")).alias("part", "x"))
    return parts.select("file", "sheet", "segment", "part", F.col("x.b").cast("double").cast("long").alias("begin"), F.col("x.e").cast("double").cast("long").alias("end"))


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of rows of texts and numbers (None: an empty cell)."""
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = MAIN.strip("{}")

    def cell(row: int, col: int, x: object) -> str:
        at = f'r="{column_letters(col)}{row}"'
        if isinstance(x, str):
            return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'
        return f"<c {at}><v>{x!r}</v></c>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        book = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        relations = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{relations}{book}{types}</Types>')
        kind = LINK.strip("{}").removesuffix("}id")
        package = PACKAGE.strip("{}")
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{main}" xmlns:r="{kind}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{package}">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, x) for c, x in enumerate(row, 1) if x is not None)}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{xml}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
