"""Readers: headed and headless CSV, workbooks, page texts, named tabs, rules, JSON boards."""

from __future__ import annotations

import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyspark.functions.text import natural_key, null_if_blank

GRID = "file string, sheet_idx int, sheet string, row_idx int, cells array<string>"
#: Rows of a sheet that are in memory at a time.
BATCH_ROWS = 4096
#: Bytes of sheets, still deflated, that a task gathers before it hands them on; a larger sheet goes alone.
BATCH_BYTES = 1 << 22
_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str, required: str | None = None) -> DataFrame:
    """A headed CSV with every column text; rows whose `required` column is blank go."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.where(null_if_blank(F.col(f"`{required}`")).isNotNull()) if required else df


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headless CSV files as grids; rows keep their place in the file (files are read whole, one task each)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return grid_cells(whole)


def grid_cells(whole: DataFrame) -> DataFrame:
    """Grids of the whole texts (file, value) of CSV files. Quoted cells may hold separators, line breaks and doubled quotes."""
    # A record ends at a line end outside of quotes: records are found before their cells are.
    text = F.regexp_replace("value", r"\r?\n$", "")
    records = F.regexp_extract_all(text, F.lit(r'(?:^|\r?\n)((?:"(?:[^"]|"")*"|[^"\r\n])*)'), F.lit(1))
    rows = whole.select("file", F.posexplode(records).alias("row_idx", "line"))
    cells = F.transform(F.regexp_extract_all("line", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c))
    return rows.select("file", F.lit(0).alias("sheet_idx"), F.lit("csv").alias("sheet"), "row_idx", cells.alias("cells"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _member(z: zipfile.ZipFile, content: bytes, name: str) -> tuple[bytes, bool]:
    """A member of an archive as it is stored, and whether it is deflated: nothing is inflated."""
    info = z.getinfo(name)
    at = info.header_offset
    names, extra = struct.unpack("<HH", content[at + 26 : at + 30])
    start = at + 30 + names + extra
    return content[start : start + info.compress_size], info.compress_type == zipfile.ZIP_DEFLATED


def _elements(stored: bytes, deflated: bool, tag: str, below: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, each dropped before the next is read; `below` is the tag of their parent."""
    parser, parent = ElementTree.XMLPullParser(["start", "end"]), None
    inflate = zlib.decompressobj(-15) if deflated else None
    for at in range(0, len(stored), 1 << 14):
        piece = stored[at : at + (1 << 14)]
        parser.feed(inflate.decompress(piece) if inflate else piece)
        for event, e in parser.read_events():
            if event == "start" and e.tag == below:
                parent = e
            elif event == "end" and e.tag == tag:
                yield e
                if parent is not None:
                    parent.clear()


def workbook_sheets(content: bytes) -> Iterator[tuple[int, str, bytes, bool, bytes, bool]]:
    """(sheet_idx, sheet, its stored member, deflated, the stored shared texts, deflated) of a workbook, in its order."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = _member(z, content, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else (b"", False)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for k, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_N}sheet")):
        target = targets[s.get(f"{_R}id")]
        yield k, s.get("name"), *_member(z, content, target.lstrip("/") if target.startswith("/") else f"xl/{target}"), *shared


def sheet_rows(member: bytes, deflated: bool, shared: bytes, shared_deflated: bool) -> Iterator[tuple[int, list[str | None]]]:
    """(row_idx, cells as text) of one sheet, read as a stream. Rows and cells without a place follow the one before."""
    texts = ["".join(t.text or "" for t in s.iter(f"{_N}t")) for s in _elements(shared, shared_deflated, f"{_N}si", f"{_N}sst")]
    at_row = -1
    for row in _elements(member, deflated, f"{_N}row", f"{_N}sheetData"):
        at_row = int(row.get("r")) - 1 if row.get("r") else at_row + 1
        cells: list[str | None] = []
        for c in row.iter(f"{_N}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            v = c.find(f"{_N}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_N}t"))
            elif v is not None and v.text is not None:
                cells[at] = texts[int(v.text)] if c.get("t") == "s" else v.text
        yield at_row, cells


def workbook_grid(books: DataFrame) -> DataFrame:
    """All sheets of workbooks (file, content) as grids.

    First each archive's directory gives a row for each sheet, with the sheet still deflated; then sheets are dealt to tasks, which read
    the rows as a stream and hand them on in batches of at most BATCH_ROWS. A sheet of any length takes the memory of its shared
    texts and one batch. A null content has no rows; a file that is no workbook is an error."""

    def batched(rows: Iterator[tuple], columns: list[str], size, most: int) -> Iterator[pd.DataFrame]:
        """Frames of rows whose sizes come to `most`: a frame for each small sheet would take longer than its reading."""
        part, so_far = [], 0
        for r in rows:
            part.append(r)
            so_far += size(r)
            if so_far >= most:
                yield pd.DataFrame(part, columns=columns)
                part, so_far = [], 0
        if part:
            yield pd.DataFrame(part, columns=columns)

    def directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ((file, *s) for b in batches for file, content in zip(b["file"], b["content"]) if content is not None for s in workbook_sheets(bytes(content)))
        return batched(found, ["file", "sheet_idx", "sheet", "member", "deflated", "shared", "shared_deflated"], lambda r: len(r[3]) + len(r[5]) + 256, BATCH_BYTES)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sheets = (s for b in batches for s in b.itertuples(index=False))
        read = ((s.file, s.sheet_idx, s.sheet, *r) for s in sheets for r in sheet_rows(bytes(s.member), s.deflated, bytes(s.shared), s.shared_deflated))
        return batched(read, ["file", "sheet_idx", "sheet", "row_idx", "cells"], lambda r: 1, BATCH_ROWS)

    sheets = books.select("file", "content").mapInPandas(directory, "file string, sheet_idx int, sheet string, member binary, deflated boolean, shared binary, shared_deflated boolean")
    return sheets.repartition("file", "sheet_idx").mapInPandas(rows, GRID)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of the workbooks below a path as grids (workbook_grid)."""
    return workbook_grid(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content"))


def report_rows(grid: DataFrame, date: int, category: int, amount: int, skip: int = 5) -> DataFrame:
    """Rows of a fixed-offset report below its head that have a real date, a category and an amount."""
    from tallyspark.functions.text import is_date, parse_money

    c = lambda k: F.get("cells", F.lit(k))
    return grid.where((F.col("row_idx") >= skip) & is_date(c(date)) & null_if_blank(c(category)).isNotNull() & parse_money(c(amount)).isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, order_key, line_idx, text) of text files in natural order of their names; UTF-16 or UTF-8 by the
    byte order mark."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    head = F.hex(F.substring("content", 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    return raw.select("file", natural_key(F.col("file")).alias("order_key"), F.posexplode(F.split(text, r"\r?\n")).alias("line_idx", "text"))


def with_file_period(df: DataFrame, file: str = "file") -> DataFrame:
    """period ('Jan 2025') and year of names that begin with YYYYMMDD."""
    day = F.try_to_date(F.regexp_extract(file, r"^(\d{8})", 1), "yyyyMMdd")
    return df.withColumn("period", F.date_format(day, "MMM yyyy")).withColumn("year", F.year(day))


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """Text lines below a folder with their own folder's name as period."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("period"), F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_idx", "text"))


def read_board(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lists, cards) of JSON board exports, with the file's name as snapshot."""
    schema = "lists array<struct<id:string,name:string,pos:double>>, cards array<struct<idList:string,closed:boolean>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file"))
    lists = raw.select("file", F.explode("lists").alias("l")).select("file", "l.*")
    return lists, raw.select("file", F.explode("cards").alias("c")).select("file", F.col("c.idList").alias("list_id"), "c.closed")


def read_tab(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Wanted columns of a headed CSV by their trimmed lower-case names; blank rows go; no file is no rows."""
    try:
        df = spark.read.csv(path, header=True, inferSchema=False)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    here = {c.strip().lower(): c for c in df.columns}
    out = df.select(*[(F.col(f"`{here[c]}`") if c in here else F.lit(None).cast("string")).alias(c) for c in columns])
    return out.where(F.coalesce(*[null_if_blank(F.col(c)) for c in columns]).isNotNull())


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Vendor memory with its fixed schema; the source 'auto' of old files is 'claude'."""
    df = read_tab(spark, path, ["client_id", "vendor_name", "tag", "subcategory", "source", "date_tagged"])
    return df.withColumn("source", F.when(F.col("source") == "auto", "claude").otherwise(F.col("source")))


def vocabulary_tab(grid: DataFrame, synonyms: list[str], name: str = "lookup", sub_synonyms: list[str] | None = None) -> DataFrame:
    """Distinct values of the first column whose header is one of the synonyms, on the first sheet named like `name`; with
    sub_synonyms also a column `subcategory` from the first header of those (null without one)."""
    sheets = grid.where(F.lower("sheet").contains(name))
    first = sheets.groupBy("file").agg(F.min("sheet_idx").alias("sheet_idx"))
    rows = sheets.join(first, ["file", "sheet_idx"])
    heads = rows.where("row_idx = 0").select("file", F.posexplode("cells").alias("col", "h")).withColumn("h", F.lower(F.trim("h")))
    at = lambda names: F.min(F.when(F.col("h").isin([s.lower() for s in names]), F.col("col")))
    heads = heads.groupBy("file").agg(at(synonyms).alias("col"), at(sub_synonyms or []).alias("sub")).where("col is not null")
    value, sub = null_if_blank(F.get("cells", F.col("col"))), null_if_blank(F.get("cells", F.col("sub")))
    out = rows.where("row_idx > 0").join(heads, "file").select(value.alias("value"), *([sub.alias("subcategory")] if sub_synonyms else []))
    return out.where("value is not null").distinct()


def vocabulary_warnings(grid: DataFrame, synonyms: list[str], name: str = "lookup") -> DataFrame:
    """(file, warning) of workbooks whose vocabulary can't be read: no sheet named like `name`, or no header of it known."""
    named = grid.groupBy("file").agg(F.min(F.when(F.lower("sheet").contains(name), F.col("sheet_idx"))).alias("_s"))
    heads = grid.where("row_idx = 0").select("file", F.col("sheet_idx").alias("_s"), F.exists("cells", lambda c: F.lower(F.trim(c)).isin([s.lower() for s in synonyms])).alias("_known"))
    out = named.join(heads, ["file", "_s"], "left")
    text = F.when(F.col("_s").isNull(), F.lit(f"no sheet named like {name}")).when(~F.coalesce("_known", F.lit(False)), F.lit("no known header"))
    return out.select("file", text.alias("warning")).where("warning is not null")


def read_rules(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """The rules of one locale of a JSON-lines table; an unknown locale is an error that names the known ones."""
    rules = spark.read.json(path)
    if rules.where(F.col("locale") == locale).isEmpty():
        known = sorted(r[0] for r in rules.select("locale").distinct().limit(100).collect())
        raise ValueError(f"no rules for {locale}; there are {', '.join(known)}")
    return rules.where(F.col("locale") == locale)
