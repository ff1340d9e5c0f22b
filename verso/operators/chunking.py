"""Splitting texts into chunks, and packing table rows into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.functions.text import table_line
from verso.session import stored

#: Separators from coarse to fine.
SEPARATORS = (r"\n(?=Chương\s+[IVXLCDM]+\b)", r"\n(?=Điều\s+\d+)", r"\n\n", r"\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Pieces of a text, each but the first beginning with its separator."""
    if not separator:
        return list(text)
    starts = [m.start() for m in re.finditer(separator, text)]
    return [p for a, b in zip([0, *starts], [*starts, len(text)]) if (p := text[a:b])]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            if whole := "".join(held).strip():
                yield whole
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if whole := "".join(held).strip():
        yield whole


def split(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where the separators allow it."""
    at = next((i for i, s in enumerate(separators) if not s or re.search(s, text)), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for p in _pieces(text, separators[at]):
        if len(p) < size:
            small.append(p)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split(p, size, overlap, finer) if finer else [p]
    return out + list(_packed(small, size, overlap))


def chunk_texts(size: int = 1000, overlap: int = 200, least: int = 50):
    """A vectorised function from texts to arrays of chunks of at least ``least`` characters."""

    @F.pandas_udf("array<string>")
    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [c.strip() for c in split(t or "", size, overlap) if len(c.strip()) >= least])

    return chunk


def chunk_pages(pages: DataFrame, size: int = 1000, overlap: int = 200, least: int = 50) -> DataFrame:
    """Chunks of pages (``doc_id, page_num, text, tables``), text first, then tables whole; numbers start anew on each page."""
    every = F.concat(
        F.transform(chunk_texts(size, overlap, least)(F.col("text")), lambda t: F.struct(t.alias("text"), F.lit(False).alias("is_table"))),
        F.transform(F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda t: F.trim(t) != ""), lambda t: F.struct(t.alias("text"), F.lit(True).alias("is_table"))),
    )
    row = pages.select("doc_id", "page_num", F.posexplode(every).alias("chunk_index", "c"))
    name = F.format_string("%s_p%d_c%d", F.col("doc_id").cast("string"), "page_num", "chunk_index")
    return row.select(name.alias("chunk_id"), "doc_id", "page_num", "chunk_index", "c.is_table", "c.text")


def pack_rows(header: Column, rows: Column, first_row: int = 2, most: int = 1000, sheet: Column | None = None) -> Column:
    """Greedy packing of table rows into markdown chunks of ``most`` characters that repeat the header.

    No row is cut and each chunk has one row at least. ``rows`` is an ordered
    array of arrays of strings; the result is an array of strings.
    """
    bar = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |"))
    top = F.concat(table_line(header), F.lit("\n"), bar)
    label = F.lit("") if sheet is None else F.when(sheet.isNull() | (sheet == ""), "").otherwise(F.concat(F.lit("[Sheet: "), sheet, F.lit("] ")))
    lines = F.transform(rows, table_line)

    def chunk(s: Column, top_: Column) -> Column:
        span = F.concat(label, F.lit("[Dòng "), s["from"].cast("string"), F.lit("-"), (s["next"] - 1).cast("string"), F.lit("]"))
        return F.concat(span, F.lit("\n"), top_, F.lit("\n"), F.array_join(s["lines"], "\n"))

    def step(s: Column, line: Column) -> Column:
        more = F.length(line) + 1
        full = (F.size(s["lines"]) > 0) & (s["used"] + more > most)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(chunk(s, top)))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(s["lines"], F.array(line))).alias("lines"),
            F.when(full, F.length(top) + more).otherwise(s["used"] + more).alias("used"),
            F.when(full, s["next"]).otherwise(s["from"]).alias("from"),
            (s["next"] + 1).alias("next"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("lines"), F.length(top).alias("used"), F.lit(first_row).alias("from"), F.lit(first_row).alias("next"))
    return F.aggregate(lines, start, step, lambda s: F.when(F.size(s["lines"]) > 0, F.concat(s["done"], F.array(chunk(s, top)))).otherwise(s["done"]))


#: Rows of a slice of a sheet.
SLICE = 4096


def _links(start: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """For each row the first row of the chunk after the one that starts with it."""
    return np.maximum(np.arange(len(start)) + 1, np.searchsorted(start + size, start + room, "right"))


def pack_sheets(rows: DataFrame, sheet: str, order: list[str], cells: Column, header: list[str], first_row: int = 2, most: int = 1000) -> DataFrame:
    """As :func:`pack_rows` for sheets that are many rows of a table: ``sheet, chunk_index, text``.

    Rows of a sheet are numbered and their lengths summed up over a sort by
    ranges, so that a large sheet lies in many tasks. Where a chunk that starts
    with a row ends is found in the sums; a chunk has ``most`` characters, and
    so no more rows than that: slices of rows with that many of the next one
    hold all that is asked. Each slice says for every row that may be the first
    start in it which start the next slice gets; from the first row of a sheet
    these links are followed by pointer doubling, over slices and not rows.
    Rows without a sheet are of one without a name.
    """
    spark = rows.sparkSession
    bar = "| " + " | ".join("---" for _ in header) + " |"
    head = F.concat(table_line(F.array(*[F.lit(h) for h in header])), F.lit("\n" + bar))
    room = most - spark.range(1).select(F.length(head)).head()[0]
    reach = max(1, most)
    every = max(SLICE, reach)

    own = F.struct(*order).alias("order")
    sorted_ = rows.select(F.coalesce(F.col(sheet).cast("string"), F.lit("")).alias("sheet"), own, table_line(cells).alias("line")).repartitionByRange("sheet", "order").sortWithinPartitions("sheet", "order")
    sorted_ = stored(sorted_.select("sheet", "line", (F.length("line") + 1).alias("size"), F.monotonically_increasing_id().alias("at")), "sheet-rows")
    part = F.shiftright("at", 33)
    before = W.partitionBy("sheet").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sorted_.groupBy("sheet", part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("at").alias("first"))
    sums = sums.select("sheet", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("sum_before"))
    here = W.partitionBy("sheet", "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # no more than a partition of the sort
    numbered = sorted_.withColumn("part", part).withColumn("inside", F.coalesce(F.sum("size").over(here), F.lit(0))).join(sums, ["sheet", "part"])
    numbered = stored(numbered.select("sheet", (F.col("rows_before") + F.col("at") - F.col("first")).alias("i"), (F.col("sum_before") + F.col("inside")).alias("start"), "size", "line"), "sheet-sums")

    slice_ = F.floor(F.col("i") / every).cast("long")
    homes = F.when((F.col("i") % every < reach) & (F.col("i") >= every), F.array(slice_, slice_ - 1)).otherwise(F.array(slice_))
    spread = numbered.select("sheet", "i", "start", "size", F.explode(homes).alias("slice"))

    def hop(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        i, start, size = (rows.column(c).to_numpy() for c in ("i", "start", "size"))
        first = int(rows.column("slice")[0].as_py()) * every
        n, link = int((i < first + every).sum()), _links(start, size, room)
        out = link[:n].copy()
        for j in range(n - 1, -1, -1):
            if out[j] < n:
                out[j] = out[out[j]]
        entries = 1 if first == 0 else min(n, reach)
        return pa.table({"sheet": rows.column("sheet")[:entries], "i": pa.array(i[:entries]), "to": pa.array(first + out[:entries])})

    link = stored(spread.groupBy("sheet", "slice").applyInArrow(hop, "sheet string, i long, to long"), "sheet-links")
    first_starts = link.select("sheet", "i")
    reached = stored(link.filter("i = 0").select("sheet", "i"), "sheet-starts")
    while True:  # after each round twice as many slices are reached
        found = stored(reached.join(link, ["sheet", "i"]).select("sheet", F.col("to").alias("i")).join(first_starts, ["sheet", "i"], "left_semi").join(reached, ["sheet", "i"], "left_anti"), "sheet-starts")
        if found.isEmpty():
            break
        reached = reached.unionByName(found)
        far = link.select("sheet", F.col("i").alias("to"), F.col("to").alias("further"))
        link = stored(link.join(far, ["sheet", "to"]).select("sheet", "i", F.col("further").alias("to")), "sheet-links")

    def mark(rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        i, start, size = (rows.column(c).to_numpy() for c in ("i", "start", "size"))
        at, starts, n = (int(entry.column("i")[0].as_py()) - int(i[0]) if entry.num_rows else len(i)), [], 0
        link = _links(start, size, room)
        first = int(rows.column("slice")[0].as_py()) * every
        while at < len(i) and i[at] < first + every:
            starts.append(at)
            at = int(link[at])
        sizes = np.diff([*starts, min(at, len(i))])
        lines = np.repeat(np.arange(len(starts)), sizes)
        kept = rows.slice(starts[0] if starts else 0, int(sizes.sum()))
        return pa.table({"sheet": kept.column("sheet"), "slice": kept.column("slice"), "i": kept.column("i"), "chunk": pa.array(lines, pa.int64())})

    entry = reached.withColumn("slice", slice_)
    marked = spread.groupBy("sheet", "slice").cogroup(entry.groupBy("sheet", "slice")).applyInArrow(mark, "sheet string, slice long, i long, chunk long")
    marked = stored(marked, "sheet-marks")
    many = marked.groupBy("sheet", "slice").agg((F.max("chunk") + 1).alias("n"))
    earlier = many.select("sheet", "slice", F.coalesce(F.sum("n").over(W.partitionBy("sheet").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    chunk = marked.join(numbered.select("sheet", "i", "line"), ["sheet", "i"]).groupBy("sheet", "slice", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("lines"))  # ``most`` characters, or one row
    chunk = chunk.join(earlier, ["sheet", "slice"])
    label = F.when(F.col("sheet") == "", "").otherwise(F.concat(F.lit("[Sheet: "), "sheet", F.lit("] ")))
    span = F.concat(label, F.lit("[Dòng "), (F.col("lines")[0]["i"] + first_row).cast("string"), F.lit("-"), (F.element_at("lines", -1)["i"] + first_row).cast("string"), F.lit("]"))
    return chunk.select("sheet", (F.col("earlier") + F.col("chunk")).alias("chunk_index"), F.concat(span, F.lit("\n"), head, F.lit("\n"), F.array_join(F.col("lines")["line"], "\n")).alias("text"))
