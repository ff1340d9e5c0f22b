"""Parsing of uploaded files into pages: markdown and text, CSV, spreadsheets and word-processor documents.

Files are read with Spark's binary source and parsed in batches on the
executors. A file that cannot be parsed becomes a row with ``error`` set and
no text; it never fails the job.
"""

from __future__ import annotations

import csv
import io
import math
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.functions.text import clean, markdown_to_plain
from verso.operators.chunking import pack_rows

EXTENSIONS = ("pdf", "docx", "md", "txt", "xlsx", "csv")
RAW = "path string, kind string, page_num int, text string, header array<string>, rows array<array<string>>, sheet string, error string"
LEAST_PAGE = 50
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, kind, content`` of every file below a folder; the kind is the lower-cased extension."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), "content")


def _decoded(content: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1258"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def _filled(rows: list[list[str]]) -> list[list[str]]:
    return [r for r in rows if any(c.strip() for c in r)]


def parse_csv(content: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and rows; the separator is the commonest of comma, semicolon and tab outside quotes in the first 4,096 characters."""
    text = _decoded(content)
    best = max(",;\t", key=re.sub(r'"[^"]*"', "", text[:4096]).count)
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=best)]
    return (rows[0], _filled(rows[1:])) if rows else ([], [])


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(content: bytes) -> list[tuple[int, str, list[str], list[list[str]]]]:
    """``position, name, header, rows`` of the sheets that have rows under a header; values as stored."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for at, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            part = target[sheet.get(f"{_R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            rows = []
            for row in root.iter(f"{_S}row"):
                cells: list[str] = []
                for i, c in enumerate(row.iter(f"{_S}c")):
                    place = _column(c.get("r")) if c.get("r") else i
                    cells += [""] * (place + 1 - len(cells))
                    if c.get("t") == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif (v := c.find(f"{_S}v")) is not None:
                        cells[place] = shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                rows.append(cells)
            if rows and any(c.strip() for c in rows[0]) and (body := _filled(rows[1:])):
                width = max(map(len, rows))
                out.append((at, sheet.get("name"), rows[0] + [""] * (width - len(rows[0])), [r + [""] * (width - len(r)) for r in body]))
    return out


def parse_docx(content: bytes) -> list[tuple[int, str]]:
    """``page, text`` of a document: explicit page breaks open pages, the paragraph with the break goes to the new one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    pages: list[list[str]] = [[]]
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body:
        if e.tag == f"{_W}p":
            if any(b.get(f"{_W}type") == "page" for b in e.iter(f"{_W}br")):
                pages.append([])
            if t := said(e).strip():
                pages[-1].append(t)
        elif e.tag == f"{_W}tbl":
            pages[-1] += [" | ".join(said(c).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
    return [(n, t) for n, p in enumerate(pages, 1) if len(t := "\n".join(p).strip()) >= LEAST_PAGE]


def _parse(path: str, kind: str, content: bytes) -> list[tuple]:
    if kind in ("md", "txt"):
        return [(path, kind, 1, content.decode("utf-8", "replace"), None, None, None, None)]
    if kind == "csv":
        header, rows = parse_csv(content)
        return [(path, kind, 1, None, header, rows, None, None)] if rows else []
    if kind == "xlsx":
        return [(path, kind, at, None, header, rows, name, None) for at, name, header, rows in parse_xlsx(content)]
    if kind == "docx":
        return [(path, kind, at, text, None, None, None, None) for at, text in parse_docx(content)]
    if kind == "pdf":
        raise ValueError("no PDF parser is installed")
    raise ValueError(f"unsupported extension .{kind}; supported: {', '.join(EXTENSIONS)}")


def pages(found: DataFrame) -> DataFrame:
    """``doc_id, page_num, text, tables, sheet_name, error`` of files: text cleaned, table rows packed into chunks."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                try:
                    out += _parse(path, kind, content)
                except Exception as e:  # a bad file is a row with its error
                    out.append((path, kind, 0, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")])

    raw = found.mapInPandas(look, RAW)
    text = clean(F.when(F.col("kind").isin("md", "txt"), markdown_to_plain(F.col("text"))).otherwise(F.col("text")))
    tables = F.when(F.col("rows").isNotNull(), pack_rows(F.col("header"), F.col("rows"), sheet=F.col("sheet"))).otherwise(F.array().cast("array<string>"))
    out = raw.select(F.sha2("path", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "page_num", text.alias("text"), tables.alias("tables"), F.col("sheet").alias("sheet_name"), "error")
    return out.filter("error is not null or text != '' or size(tables) > 0")


def _cells(boxes: DataFrame, by: tuple[str, ...], wide: float, high: float, levels: list[int]) -> DataFrame:
    """Boxes with the grid cells that they lie in, on every level on which they are no wider or higher than a cell: four at most each."""
    low_x, top_x, low_y, top_y = (f(*c) for c in (("x0", "x1"), ("y0", "y1")) for f in (F.least, F.greatest))
    share = F.greatest((top_x - low_x) / wide, (top_y - low_y) / high)
    own = F.greatest(F.ceil(F.log2(F.greatest(share, F.lit(1.0)))), F.lit(0)).cast("int")
    on = boxes.select(*by, "x0", "y0", "x1", "y1", own.alias("own"), F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")).filter("level >= own")

    def cell(x: Column, size: float) -> Column:
        return F.floor(x / (F.lit(size) * F.pow(F.lit(2.0), F.col("level")))).cast("long")

    on = on.withColumns({"low_x": cell(low_x, wide), "low_y": cell(low_y, high)})
    on = on.withColumn("cell_x", F.explode(F.sequence("low_x", cell(top_x, wide)))).withColumn("cell_y", F.explode(F.sequence("low_y", cell(top_y, high))))
    return on


def outside_tables(spans: DataFrame, tables: DataFrame, by: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """Spans (``x0, y0, x1, y1``) of a page that overlap none of its tables; boxes that only touch do not overlap.

    Boxes meet in the cells of a grid whose size is the mean of the data's
    boxes, twice as large on each level above; a pair is tested on the level of
    its larger box, in the first cell that both have there. So no page is
    compared box by box, and no box is in more than four cells of a level.
    Boxes without all numbers overlap nothing.
    """
    sizes = [f(F.abs(F.col(b) - F.col(a))) for a, b in (("x0", "x1"), ("y0", "y1")) for f in (F.avg, F.max)]
    both = spans.select("x0", "y0", "x1", "y1").unionByName(tables.select("x0", "y0", "x1", "y1"))
    wide, most_wide, high, most_high = (float(x or 0) for x in both.agg(*sizes).head())
    wide, high = wide or 1.0, high or 1.0
    levels = list(range(max(0, math.ceil(math.log2(max(most_wide / wide, most_high / high, 1.0)))) + 1))
    corners = ["x0", "y0", "x1", "y1"]
    full = " AND ".join(f"{c} IS NOT NULL" for c in (*by, *corners))
    s = _cells(spans.filter(full).select(*by, *corners).distinct(), by, wide, high, levels).alias("s")
    t = _cells(tables.filter(full), by, wide, high, levels).alias("t")
    here = reduce(lambda a, b: a & b, [F.col(f"s.{c}") == F.col(f"t.{c}") for c in (*by, "level", "cell_x", "cell_y")])
    once = F.expr("s.level = greatest(s.own, t.own) AND s.cell_x = greatest(s.low_x, t.low_x) AND s.cell_y = greatest(s.low_y, t.low_y)")
    overlap = F.expr("s.x0 < t.x1 and t.x0 < s.x1 and s.y0 < t.y1 and t.y0 < s.y1")
    hit = s.join(t, here & once & overlap, "left_semi").select(*by, *corners).distinct()
    return spans.join(hit, [*by, *corners], "left_anti").select(spans.columns)


