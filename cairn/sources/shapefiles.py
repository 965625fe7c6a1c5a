"""Shapes and attributes of shapefiles, from the rows (path, content) that Spark's ``binaryFile`` source gives.

A file is read by one task, which passes its records on in batches. The format bounds a file to 2 GB;
a large layer is many files. Records of the .shp and the .dbf of one name belong together by their number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The code that a file begins with, and kinds of shapes.
CODE, NULL, POINT, LINE, POLYGON, MULTIPOINT = 9994, 0, 1, 3, 5, 8
SHAPES = "layer string, record int, kind int, parts array<array<array<double>>>"
ATTRIBUTES = "layer string, record int, attributes map<string,string>"
ROWS = 1000


def shapes_of(content: bytes) -> Iterator[tuple[int, int, list | None]]:
    """(number, kind, parts) of the records of a .shp; a null shape has no parts."""
    if len(content) < 100 or struct.unpack_from(">i", content, 0)[0] != CODE:
        raise ValueError("not a shapefile")
    end = min(len(content), 2 * struct.unpack_from(">i", content, 24)[0])
    at = 100
    while at + 8 <= end:
        number, words = struct.unpack_from(">ii", content, at)
        at += 8
        kind = struct.unpack_from("<i", content, at)[0]
        if kind == NULL:
            parts = None
        elif kind == POINT:
            parts = [[list(struct.unpack_from("<2d", content, at + 4))]]
        elif kind in (LINE, POLYGON):
            n_parts, n_points = struct.unpack_from("<2i", content, at + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", content, at + 44), n_points]
            points = np.frombuffer(content, "<f8", 2 * n_points, at + 44 + 4 * n_parts).reshape(-1, 2).tolist()
            parts = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind == MULTIPOINT:
            n_points = struct.unpack_from("<i", content, at + 36)[0]
            parts = [[p] for p in np.frombuffer(content, "<f8", 2 * n_points, at + 40).reshape(-1, 2).tolist()]
        else:
            raise ValueError(f"shapes of kind {kind} are not read")
        yield number, kind, parts
        at += 2 * words


def attributes_of(content: bytes) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(number, attributes) of the records of a .dbf that are not deleted; blank values are null."""
    n, header, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    for i in range(n):
        at = header + i * size
        if content[at : at + 1] == b"*":
            continue
        at, row = at + 1, {}
        for name, width in fields:
            raw = content[at : at + width].strip(b" \0")
            try:
                row[name] = raw.decode("utf-8") or None
            except UnicodeDecodeError:
                row[name] = raw.decode("latin-1")
            at += width
        yield i + 1, row


def _read(files: DataFrame, ending: str, records, schema: str, columns) -> DataFrame:
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                layer, held = path.rsplit("/", 1)[-1].rsplit(".", 1)[0], []
                for record in records(content):
                    held.append((layer, *record))
                    if len(held) == ROWS:
                        yield columns(held, names)
                        held = []
                if held:
                    yield columns(held, names)

    return files.filter(F.lower("path").endswith(ending)).select("path", "content").mapInArrow(run, schema)


def _shape_batch(rows, names) -> pa.RecordBatch:
    layer, number, kind, parts = zip(*rows, strict=True)
    return pa.record_batch([pa.array(layer), pa.array(number, pa.int32()), pa.array(kind, pa.int32()), pa.array(parts, pa.list_(pa.list_(pa.list_(pa.float64()))))], names=names)


def _attribute_batch(rows, names) -> pa.RecordBatch:
    layer, number, values = zip(*rows, strict=True)
    return pa.record_batch([pa.array(layer), pa.array(number, pa.int32()), pa.array([list(v.items()) for v in values], pa.map_(pa.string(), pa.string()))], names=names)


def read_shapes(files: DataFrame) -> DataFrame:
    """(layer, record, kind, parts) of the .shp files."""
    return _read(files, ".shp", shapes_of, SHAPES, _shape_batch)


def read_attributes(files: DataFrame) -> DataFrame:
    """(layer, record, attributes) of the .dbf files."""
    return _read(files, ".dbf", attributes_of, ATTRIBUTES, _attribute_batch)


def read_layers(files: DataFrame) -> DataFrame:
    """(layer, record, kind, parts, attributes); shapes without attributes have none."""
    return read_shapes(files).join(read_attributes(files), ["layer", "record"], "left")


def shp_bytes(rings: list[list[list[float]]]) -> bytes:
    """A .shp of polygons of one ring each."""
    body = b""
    for i, ring in enumerate(rings, 1):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        shape = struct.pack("<i4d2ii", POLYGON, min(xs), min(ys), max(xs), max(ys), 1, len(ring), 0) + struct.pack(f"<{2 * len(ring)}d", *[c for p in ring for c in p])
        body += struct.pack(">ii", i, len(shape) // 2) + shape
    xs, ys = ([p[k] for ring in rings for p in ring] or [0.0] for k in (0, 1))
    head = struct.pack(">i20xi", CODE, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, POLYGON, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    return head + body


def dbf_bytes(rows: list[dict[str, str]], widths: dict[str, int]) -> bytes:
    """A .dbf of text fields; values are cut to the fields' bytes."""
    fields = b"".join(name.encode("ascii").ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14) for name, width in widths.items())
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths.values()))
    records = b"".join(b" " + b"".join(str(r[name]).encode("utf-8")[:width].ljust(width) for name, width in widths.items()) for r in rows)
    return head + fields + b"\r" + records + b"\x1a"
