"""Sources: tables with lineage, archives, spreadsheets, logs, arrays, hash checks.

Archives and spreadsheets can't be split; each file is one row of a binaryFile scan and is parsed
on an executor, so many files are read in parallel and none passes the driver.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS = "path string, member string, row long, cells map<string,string>"


def header(name: str) -> str:
    """A column name as the readers normalize it."""
    return re.sub(r"[ \-]+", "_", name.strip().lower())


def parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def parquet_with_lineage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows with file_name and row_index, the place of a row within its file."""
    return spark.read.parquet(*paths).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_with_encodings(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8-sig", "utf-8", "utf-16", "latin-1")) -> DataFrame:
    """Rows as maps, each file in the first encoding that decodes it whole."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                text = next(t for t in (_decoded(content, e) for e in encodings) if t is not None)
                yield _frame(path, "", csv.DictReader(io.StringIO(text, newline="")))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ROWS)


def _decoded(content: bytes, encoding: str) -> str | None:
    if encoding.startswith("utf-16") and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return None  # without its mark, nearly anything decodes
    try:
        return content.decode(encoding)
    except UnicodeDecodeError:
        return None


def _frame(path: str, member: str, rows) -> pd.DataFrame:
    cells = [{header(k or ""): v for k, v in r.items() if isinstance(v, str)} for r in rows]
    return pd.DataFrame({"path": path, "member": member, "row": range(len(cells)), "cells": pd.Series(cells, dtype=object)})


def csv_from_zip(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """Rows of the one member of each archive that ends so; none or several are an error."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    name = one_member(archive.namelist(), suffix)
                    with archive.open(name) as stream:
                        yield _frame(path, name, csv.DictReader(io.TextIOWrapper(stream, "utf-8-sig", newline="")))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ROWS)


def one_member(names: list[str], suffix: str) -> str:
    found = [n for n in names if n.endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} members end with {suffix}")
    return found[0]


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the workbook's first sheet, by its relationship; file numbers tell nothing of the order."""
    sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
    wanted = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def sheet_rows(payload: bytes) -> list[dict[str, str]]:
    """The first sheet of a workbook: shared and inline strings, booleans, short rows padded, blank
    headers named by place."""
    with zipfile.ZipFile(io.BytesIO(payload)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        first = _first_sheet(book)
        table = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{_SHEET}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", "") or "")
                at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                value, kind = cell.findtext(f"{_SHEET}v") or "", cell.get("t")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells[at] = value
            table.append(cells)
    if not table:
        return []
    width = max((max(r, default=-1) for r in table), default=-1) + 1
    names = [header(table[0].get(i, "")) or f"column_{i}" for i in range(width)]
    return [{n: r.get(i, "") for i, n in enumerate(names)} for r in table[1:]]


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet of each workbook, as maps."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield _frame(path, "", sheet_rows(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ROWS)


def columns_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """Named columns of rows read as maps."""
    return rows.select("path", "row", *[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def metrics_by_step(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON files of a glob, with the step that their names end in."""
    df = spark.read.option("multiLine", True).schema(schema).json(pattern)
    return df.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; the content stays on the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_hashes(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """expected (name, sha256) with `state`: ok, changed or missing."""
    found = file_hashes(spark, path).select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("_found"))
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") == F.col("sha256"), "ok").otherwise("changed")
    return expected.join(found, "name", "left").withColumn("state", state).drop("_found")


def tree_hash(spark: SparkSession, path: str) -> str:
    """One digest of all files below a path, by sorted relative path. A row a file goes to the driver."""
    digest = hashlib.sha256()
    for row in file_hashes(spark, path).orderBy("path").collect():
        digest.update(f"{row.path.split(path.rstrip('/') + '/')[-1]}\0{row.sha256}\n".encode())
    return digest.hexdigest()


def archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, sha256) of the members of zip archives."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows = [(path, i.filename, i.file_size, hashlib.sha256(archive.read(i)).hexdigest()) for i in archive.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, member string, size long, sha256 string")


def npz_blocks(spark: SparkSession, path: str, name: str = "input_ids") -> DataFrame:
    """(path, block, ids): the rows of a two-dimensional array in NumPy archives."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    blocks = data[name]
                yield pd.DataFrame({"path": path, "block": range(len(blocks)), "ids": [b.astype(np.int64) for b in blocks]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, block long, ids array<long>")


def packed_blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, block, ids) of files of little-endian uint16 ids in blocks of `size`; other lengths are an error."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if len(content) % (2 * size):
                    raise ValueError(f"{path}: {len(content)} bytes are no blocks of {size}")
                blocks = np.frombuffer(content, "<u2").reshape(-1, size)
                yield pd.DataFrame({"path": path, "block": range(len(blocks)), "ids": [b.astype(np.int32) for b in blocks]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, block long, ids array<int>")


def find_column(columns: list[str], names: list[str]) -> str | None:
    """The column of the first name that equals a column, else is part of one, by normalized names."""
    known = {header(c): c for c in columns}
    for n in names:
        if header(n) in known:
            return known[header(n)]
    return next((c for n in names for k, c in known.items() if header(n) in k), None)


def text_column(df: DataFrame, names: list[str] = ("text", "sentence", "content"), sample: int = 500) -> str:
    """A column by name, else the string column of greatest mean length over `sample` rows."""
    found = find_column(df.columns, list(names))
    if found:
        return found
    candidates = [c for c, kind in df.dtypes if kind == "string"]
    if not candidates:
        raise ValueError("no string column")
    means = df.limit(sample).agg(*[F.avg(F.length(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(candidates)]).first()
    return max(zip((m or 0 for m in means), candidates), key=lambda x: x[0])[1]


def wide_to_rows(df: DataFrame, id_col: str, standard: str, labels: dict[str, str]) -> DataFrame:
    """(row_id, label, source, target): one row for each label's column of a wide parallel table."""
    long = df.unpivot([id_col, standard], list(labels), "column", "source").filter("source is not null and source <> ''")
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return long.select(F.concat_ws(":", F.col(id_col).cast("string"), "column").alias("row_id"), F.element_at(names, F.col("column")).alias("label"), "source", F.col(standard).alias("target"))


def parse_json(text: str) -> object:
    """A driver-side JSON document (configuration, not data)."""
    return json.loads(text)
