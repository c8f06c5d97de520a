"""Workbooks (.xlsx, .xlsm) as a table of cells, read from their XML without further libraries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".xlsx", ".xlsm")
#: kind is string, number, boolean, date or error; sheet for one row a sheet, whose row and col are its size.
CELLS = "workbook string, sheet string, sheet_no int, row int, col int, kind string, value string"
MOST_ROWS = 500
_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def resolve(path: str, folder: str = "data/excel") -> Path:
    """The workbook as given, in the working folder, or by name in ``folder``."""
    for p in (Path(path), Path.cwd() / path, Path.cwd() / folder / Path(path).name):
        if p.is_file():
            if p.suffix.lower() not in SUFFIXES:
                raise ValueError(f"{path}: expected {' or '.join(SUFFIXES)}")
            return p
    raise FileNotFoundError(path)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _iso(serial: float) -> str:
    """A moment, or below one day a time, in ISO format."""
    d = datetime(1899, 12, 30) + timedelta(seconds=round(serial * 86400))
    return d.time().isoformat() if serial < 1 else d.isoformat()


def typed(kind: str | None, value: str | None) -> str | int | float | bool | None:
    """A cell's value as JSON has it; dates stay text in ISO format."""
    if value is None:
        return None
    if kind == "number":
        return int(value) if re.fullmatch(r"-?\d+", value) else float(value)
    return value == "true" if kind == "boolean" else value


def cells_of(data: bytes) -> Iterator[tuple[str, int, int | None, int | None, str, str | None]]:
    """(sheet, sheet_no, row, col, kind, value) of the cells that hold something, and one row of kind ``sheet`` for
    each sheet, empty ones too. A cell without a place stands behind the one before it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in have:
            shared = ["".join(t.text or "" for t in si.iter(f"{_N}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_N}si")]
        dates: set[int] = set()
        if "xl/styles.xml" in have:
            st = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in st.iter(f"{_N}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            xfs = st.find(f"{_N}cellXfs")
            dates = {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for no, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_N}sheet")):
            name, target = s.get("name"), rels[s.get(f"{_R}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            sized = tree.find(f"{_N}dimension")
            corner = re.search(r"([A-Z]+)(\d+)$", sized.get("ref", "")) if sized is not None else None
            high, wide = (int(corner[2]), _column(corner[1])) if corner else (0, 0)
            at = 0
            for line in tree.iter(f"{_N}row"):
                at, col = int(line.get("r") or at + 1), 0
                for c in line.iter(f"{_N}c"):
                    col = _column(c.get("r")) if c.get("r") else col + 1
                    high, wide = max(high, at), max(wide, col)
                    got = _value(c, shared, dates)
                    if got:
                        yield name, no, at, col, *got
            yield name, no, high or None, wide or None, "sheet", None


def _value(c: ElementTree.Element, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    kind, v = c.get("t"), c.find(f"{_N}v")
    if kind == "inlineStr":
        return "string", "".join(t.text or "" for t in c.iter(f"{_N}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return "string", shared[int(v.text)]
    if kind == "b":
        return "boolean", "true" if v.text == "1" else "false"
    if kind in ("str", "e", "d"):
        return {"str": "string", "e": "error", "d": "date"}[kind], v.text
    return ("date", _iso(float(v.text))) if int(c.get("s", 0)) in dates else ("number", v.text)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of one workbook or of all of a folder, each read where its bytes are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(Path(p).name, *c) for p, d in zip(b["path"], b["content"], strict=True) for c in cells_of(d)], columns=[x.split(" ")[0] for x in CELLS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,XLSX,XLSM}").load(path).select("path", "content").mapInPandas(run, CELLS)


def list_sheets(cells: DataFrame) -> DataFrame:
    """workbook, sheet_no, sheet, max_row, max_col; null sizes for a sheet without any cell."""
    return cells.where("kind = 'sheet'").select("workbook", "sheet_no", "sheet", F.col("row").alias("max_row"), F.col("col").alias("max_col"))


def normalize_headers(values: Column) -> Column:
    """Names of columns: blank ones become column_<i>, repeated ones get _2, _3..., never one in use."""
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        name = F.coalesce(F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit("")), F.concat(F.lit("column_"), F.size(done) + 1))
        tries = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda i: F.concat(name, F.lit("_"), i))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(done, t)), 1)
        return F.concat(done, F.array(F.when(F.array_contains(done, name), free).otherwise(name)))

    return F.aggregate(values, empty, step)


def check_range(start: int, end: int, header: int) -> None:
    if header < 1 or start < 1 or end < start:
        raise ValueError("rows start at 1, and the range must not end before it starts")
    if end - start > MOST_ROWS:
        raise ValueError(f"at most {MOST_ROWS} rows beyond the first")


def headers_of(cells: DataFrame, sheet: str, header: int = 1) -> tuple[list[str], int]:
    """Names of a sheet's columns and its number of rows: one row of one sheet, whatever the workbook."""
    size = cells.where((F.col("kind") == "sheet") & (F.col("sheet") == sheet)).select("row", "col").first()
    if size is None:
        raise ValueError(f"unknown sheet: {sheet}")
    width = size["col"] or 0
    head = cells.where((F.col("sheet") == sheet) & (F.col("row") == header) & (F.col("kind") != "sheet")).groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("h"))
    if not width:
        return [], size["row"] or 0
    places = F.sequence(F.lit(1), F.lit(width))
    got = head.select(normalize_headers(F.transform(places, lambda i: F.coalesce(F.element_at("h", i), F.lit("")))).alias("names")).first()
    return list(got["names"]) if got else [f"column_{i}" for i in range(1, width + 1)], size["row"] or 0


def read_range(cells: DataFrame, sheet: str, start: int = 2, end: int = 50, header: int = 1) -> DataFrame:
    """row, cells (array of header, kind, value in the sheet's order) of a sheet's rows, blank rows and empty cells too.

    Rows begin below the header and end with the sheet.
    """
    check_range(start, end, header)
    names, rows = headers_of(cells, sheet, header)
    first, last = max(start, header + 1), min(end, rows)
    spark = cells.sparkSession
    wanted = spark.range(first, max(first, last + 1)).select(F.col("id").cast("int").alias("row"))
    c = cells.where((F.col("sheet") == sheet) & (F.col("kind") != "sheet") & F.col("row").between(first, last))
    body = c.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("kind", "value").alias("c")))).alias("m"))
    full = F.transform(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]), lambda x: F.struct(x["n"].alias("header"), F.element_at("m", x["i"])["kind"].alias("kind"), F.element_at("m", x["i"])["value"].alias("value"))) if names else F.array().cast("array<struct<header:string,kind:string,value:string>>")
    return wanted.join(body, "row", "left").select("row", full.alias("cells"))


def search_cells(cells: DataFrame, query: str, max_results: int = 50, sheet: str | None = None) -> DataFrame:
    """Cells that hold the query, whatever the letter case, header rows too, in reading order; of one sheet or of all.

    Dates are met with a space or a T between date and time."""
    if not query.strip():
        raise ValueError("the query is blank")
    c = cells.where("kind <> 'sheet'") if sheet is None else cells.where((F.col("kind") != "sheet") & (F.col("sheet") == sheet))
    low, asked = F.lower(F.col("value")), F.lit(query.strip().lower())
    hit = F.contains(low, asked) | ((F.col("kind") == "date") & F.contains(F.translate(low, "t", " "), asked))
    return c.where(hit).orderBy("workbook", "sheet_no", "row", "col").limit(max(1, min(max_results, 200))).select("workbook", "sheet", "row", "col", "kind", "value")


def write_workbook(path: str, sheets: dict[str, list[list[object]]]) -> None:
    """A small workbook from rows of values (text, numbers, booleans, None), for exports and tests."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
