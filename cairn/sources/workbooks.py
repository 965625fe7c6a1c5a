"""XLSX workbooks as rows: a workbook is one binary value, its sheets become rows of cells."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

ROWS = T.ArrayType(T.StructType([T.StructField("sheet", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
ARROW_ROWS = pa.list_(pa.struct([("sheet", pa.string()), ("number", pa.int32()), ("cells", pa.list_(pa.string()))]))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_workbook(content: bytes):
    """(sheet, row number, cells as text) of every row of every sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            body = ElementTree.fromstring(z.read(f"xl/{targets[sheet.get(RELATION)]}"))
            for number, row in enumerate(body.iter(f"{MAIN}row"), 1):
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = c.find(f"{MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield sheet.get("name"), number, cells


def build_workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook of inline text cells."""
    from xml.sax.saxutils import escape, quoteattr

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        refs = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION[1:].partition("}")[0]}"><sheets>{refs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@F.arrow_udf(ROWS)
def workbook_rows(content: pa.Array) -> pa.Array:
    """The rows of a workbook; none for a null."""
    return pa.array([[] if c is None else [{"sheet": s, "number": n, "cells": v} for s, n, v in parse_workbook(c)] for c in content.to_pylist()], ARROW_ROWS)


def with_headers(rows: DataFrame, key: Column) -> DataFrame:
    """(key, sheet, number, record map) of (key, sheet, number, cells): the first row of a sheet names
    the columns, a missing name becomes ``col_i``."""
    keyed = rows.withColumn("_k", key)
    head = keyed.filter("number = 1").select("_k", "sheet", F.transform("cells", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("col_"), i))).alias("names"))
    joined = keyed.filter("number > 1").join(head, ["_k", "sheet"])
    padded = F.transform("names", lambda n, i: F.get("cells", i))
    return joined.select("_k", "sheet", "number", F.map_from_arrays("names", padded).alias("record"))


def read_workbooks(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The records of all workbooks below ``path``, sheets named in ``skip`` left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    rows = files.select("path", F.explode(workbook_rows("content")).alias("r")).select("path", "r.*").filter(~F.col("sheet").isin(*skip) if skip else F.lit(True))
    return with_headers(rows, F.col("path"))
