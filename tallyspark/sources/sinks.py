"""Writers: fixed column orders, one output per period, account or category, and the vendor memory."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import date_text, period_order, term
from tallyspark.operators.order import keep_last

#: The tax-import columns in their order.
TAX_COLUMNS = ["TSJ", "F", "State", "City", "Form 8949 Check Box", "Desc", "Date Acquired", "Date Sold", "Type", "Ordinary", "Proceeds", "Cost", "AMT Cost Basis", "Accrued Discount", "Wash Sale Loss"]
TAX_AMOUNTS = ["Proceeds", "Cost", "AMT Cost Basis", "Accrued Discount", "Wash Sale Loss", "Fed Tax Withheld"]


#: Bytes of workbooks that a task gathers before it hands them on; a larger workbook goes alone.
BATCH_BYTES = 1 << 22


def tax_table(lots: DataFrame) -> DataFrame:
    """Lots (description, date_acquired, date_sold, proceeds, cost, accrued_market_discount, wash_sale_loss, type and
    perhaps fed_tax_withheld) as the tax-import table; columns without a source are null."""
    from tallyspark.functions.text import parse_money

    source = {"Desc": "description", "Date Acquired": "date_acquired", "Date Sold": "date_sold", "Type": "type", "Proceeds": "proceeds", "Cost": "cost", "Accrued Discount": "accrued_market_discount", "Wash Sale Loss": "wash_sale_loss", "Fed Tax Withheld": "fed_tax_withheld"}
    columns = [*TAX_COLUMNS, *(["Fed Tax Withheld"] if "fed_tax_withheld" in lots.columns else [])]

    def made(c: str):
        s = source.get(c)
        if s is None or s not in lots.columns:
            return F.lit(None).cast("decimal(18,2)" if c in TAX_AMOUNTS else "string").alias(c)
        x = F.col(s).cast("string")
        return (parse_money(x) if c in TAX_AMOUNTS else date_text(x) if c.startswith("Date") else term(x) if c == "Type" else F.trim(x)).alias(c)

    return lots.select(*[made(c) for c in columns])


def write_tax_table(table: DataFrame, path: str, fmt: str = "csv") -> None:
    columns = [c for c in [*TAX_COLUMNS, "Fed Tax Withheld"] if c in table.columns]
    table.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_outputs(outputs: dict[str, DataFrame], path: str, fmt: str = "parquet", skip_empty: tuple[str, ...] = ()) -> list[str]:
    """Each named output in its own folder; those of skip_empty only if they have rows. Returns what was written."""
    done = []
    for name, df in outputs.items():
        if name in skip_empty and df.isEmpty():
            continue
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
        done.append(name)
    return done


def write_by(df: DataFrame, path: str, column: str, fmt: str = "parquet", period: bool = False) -> None:
    """One folder for each value; with `period` rows carry the period's first day as their sort key. Rows of a value go
    to few files; adaptive execution splits values with very many rows."""
    out = df.withColumn("period_start", period_order(F.col(column))) if period else df
    out.hint("rebalance", column).write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def category_outputs(rows: DataFrame, near: DataFrame, amount: str) -> dict[str, DataFrame]:
    """Rows with a total per category, and the near misses."""
    totals = rows.groupBy("category").agg(F.sum(amount).cast(rows.schema[amount].dataType).alias(amount))
    return {"Matches": rows.unionByName(totals, allowMissingColumns=True), "Near": near}


def merged_memory(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new entries with the last one of each key."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return keep_last(both, keys, ["_batch", *order]).drop("_batch")


def new_snapshots(existing: DataFrame, incoming: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """Incoming rows of dates that aren't recorded yet."""
    return incoming.join(existing.select(date).distinct(), date, "left_anti")


def workbook_bytes(sheets: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """A workbook of text cells: (sheet name, rows of cells) in their order; empty cells are left out."""
    space = "http://schemas.openxmlformats.org/"
    main, link = f"{space}spreadsheetml/2006/main", f"{space}officeDocument/2006/relationships"
    name = lambda j: name(j // 26 - 1) + chr(65 + j % 26) if j >= 26 else chr(65 + j)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = lambda k: f"{space}package/2006/content-types" if k else f"{space}package/2006/relationships"
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        over = "".join(f'<Override PartName="/xl/worksheets/s{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{part(1)}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{part(0)}"><Relationship Id="r" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{k + 1}" r:id="r{k}"/>' for k, (s, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{part(0)}">' + "".join(f'<Relationship Id="r{k}" Type="{link}/worksheet" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, (_, rows) in enumerate(sheets):
            with z.open(f"xl/worksheets/s{k}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for i, row in enumerate(rows):
                    cells = "".join(f'<c r="{name(j)}{i + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for j, c in enumerate(row) if c is not None)
                    f.write(f'<row r="{i + 1}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(grid: DataFrame) -> DataFrame:
    """(file, content): the grids as workbooks, sheets and rows in their order. A file is made in one task, as it is opened by one user;
    gaps between row numbers close. A task goes through its files in their order and holds the rows of one file, and of one batch."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["file"], b["sheet_idx"], b["sheet"], b["cells"]))
        made, size = [], 0
        for file, of_file in itertools.groupby(rows, key=lambda r: r[0]):
            sheets = [(part[0][2], [list(r[3]) for r in part]) for part in (list(p) for _, p in itertools.groupby(of_file, key=lambda r: r[1]))]
            content = workbook_bytes(sheets)
            made.append((file, content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield pd.DataFrame(made, columns=["file", "content"])
                made, size = [], 0
        if made:
            yield pd.DataFrame(made, columns=["file", "content"])

    dealt = grid.select("file", "sheet_idx", "sheet", "row_idx", "cells").repartition("file").sortWithinPartitions("file", "sheet_idx", "row_idx")
    return dealt.mapInPandas(make, "file string, content binary")
