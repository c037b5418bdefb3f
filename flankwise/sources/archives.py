"""Binary files: digests, ZIP members and XLSX worksheets, read by data sources that plan a task per member or sheet."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import BinaryIO
from xml.etree import ElementTree

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GRID_SCHEMA = "file string, sheet string, row int, cells array<string>"
MAX_DEPTH = 2


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, length) of every file below a folder."""
    return binary_files(spark, path, pattern).select("path", F.sha2("content", 256).alias("sha256"), "length")


def missing_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected file names (name) absent from a listing (path)."""
    names = found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name")).distinct()
    return expected.join(names, "name", "left_anti")


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _plain(t.tag) == "t")


def _elements(handle, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of one name from a pull parser; what has been read is dropped."""
    parents = []
    for event, node in ElementTree.iterparse(handle, events=("start", "end")):
        if event == "start":
            parents.append(node)
            continue
        parents.pop()
        if _plain(node.tag) == wanted:
            yield node
            if parents:
                parents[-1].remove(node)


@contextmanager
def opened(path: str, members: tuple[str, ...]) -> Iterator[BinaryIO]:
    """A file, or a member of an archive inside archives, as a stream; nothing is unpacked as a whole."""
    with ExitStack() as stack:
        system, name = FileSystem.from_uri(path)
        handle = stack.enter_context(system.open_input_file(name))
        for member in members:
            handle = stack.enter_context(stack.enter_context(zipfile.ZipFile(handle)).open(member))
        yield handle


def listed_files(path: str, pattern: str) -> list[str]:
    """The files below a folder whose names fit the pattern, or the one file."""
    system, name = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    prefix = "" if system.type_name == "local" else path.split("://")[0] + "://"
    info = system.get_file_info(name)
    if info.type == FileType.File:
        return [prefix + info.path]
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(FileSelector(name, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == FileType.File and fnmatch(f.base_name, pattern))


def listed_members(path: str, members: tuple[str, ...], suffix: str, depth: int = 0) -> Iterator[tuple[str, ...]]:
    """Chains of member names of an archive that end with `suffix`, also in archives within it down to MAX_DEPTH."""
    with opened(path, members) as handle, zipfile.ZipFile(handle) as archive:
        names = archive.namelist()
    for name in names:
        if name.lower().endswith(suffix):
            yield (*members, name)
        elif name.lower().endswith(".zip") and depth < MAX_DEPTH:
            with opened(path, (*members, name)) as inner:
                if not zipfile.is_zipfile(inner):
                    continue
            yield from listed_members(path, (*members, name), suffix, depth + 1)


@dataclass
class Member(InputPartition):
    """What one task reads: a CSV member, or a sheet of a workbook."""

    file: str
    members: tuple[str, ...] = ()
    sheet: str = ""
    part: str = ""

    @property
    def label(self) -> str:
        return "::".join((self.file, *self.members))


class ZipCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.member, self.pattern = options["path"], options["member"], options.get("pattern", "*.zip")

    def partitions(self) -> list[InputPartition]:
        return [Member(file, (self.member,)) for file in listed_files(self.path, self.pattern)]

    def read(self, partition: Member) -> Iterator[tuple]:
        with opened(partition.file, partition.members) as handle:
            for row, cells in enumerate(csv.reader(io.TextIOWrapper(handle, encoding="utf-8-sig", newline=""))):
                yield partition.file, row, cells


class ZipCsv(DataSource):
    """`spark.read.format("zip_csv").option("member", name).load(path)`: (file, row, cells) of one named CSV member of each ZIP.

    One partition per archive, rows stream from the unpacking; a byte-order mark is dropped. Option `pattern`: file names.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        return "file string, row int, cells array<string>"

    def reader(self, schema) -> ZipCsvReader:
        return ZipCsvReader(dict(self.options))


def workbook_sheets(path: str, members: tuple[str, ...]) -> list[tuple[str, str]]:
    """(sheet name, its part of the workbook) in order."""
    with opened(path, members) as handle, zipfile.ZipFile(handle) as book:
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = []
    for sheet in (n for n in tree.iter() if _plain(n.tag) == "sheet"):
        target = rels[next(v for k, v in sheet.attrib.items() if _plain(k) == "id")].lstrip("/")
        sheets.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return sheets


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(0-based row, cells up to the last one) of a sheet, one row at a time."""
    at = -1
    with book.open(part) as handle:
        for row in _elements(handle, "row"):
            at = int(row.get("r", at + 2)) - 1
            cells: list[str] = []
            for place, cell in enumerate(n for n in row if _plain(n.tag) == "c"):
                column = _column_index(cell.get("r")) if cell.get("r") else place
                value = next((n.text or "" for n in cell if _plain(n.tag) == "v"), "")
                if cell.get("t") == "s" and value:
                    value = shared[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = _text(cell)
                cells.extend([""] * (column + 1 - len(cells)))
                cells[column] = value
            yield at, cells


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern")
        self.nested, self.first_only = (options.get(k, "false").lower() == "true" for k in ("nested", "firstonly"))
        self.sheet = options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        planned = []
        for file in listed_files(self.path, self.pattern or ("*.zip" if self.nested else "*.xlsx")):
            for members in listed_members(file, (), ".xlsx") if self.nested else [()]:
                sheets = workbook_sheets(file, members)[:1 if self.first_only else None]
                planned += [Member(file, members, name, part) for name, part in sheets if self.sheet is None or name == self.sheet]
        return planned

    def read(self, partition: Member) -> Iterator[tuple]:
        with opened(partition.file, partition.members) as handle, zipfile.ZipFile(handle) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                with book.open("xl/sharedStrings.xml") as strings:
                    shared = [_text(si) for si in _elements(strings, "si")]
            # The sheet is read twice: all rows have the width of the widest.
            width = max((len(cells) for _, cells in _sheet_rows(book, partition.part, shared)), default=0)
            following = 0
            for row, cells in _sheet_rows(book, partition.part, shared):
                for missing in range(following, row):
                    yield partition.label, partition.sheet, missing, [""] * width
                yield partition.label, partition.sheet, row, cells + [""] * (width - len(cells))
                following = row + 1


class Sheets(DataSource):
    """`spark.read.format("xlsx_sheets").load(path)`: (file, sheet, row, cells) of workbooks, one partition per sheet.

    Rows stream from a pull parser; a task holds the workbook's shared strings and one row. Options: `pattern` (file names),
    `sheet` (one sheet by name), `firstOnly`, `nested` (workbooks inside ZIPs, also in ZIPs within them down to two levels).
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx_sheets"

    def schema(self) -> str:
        return GRID_SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options))


def register_archives(spark: SparkSession) -> None:
    """Make the formats `zip_csv` and `xlsx_sheets` known to the session."""
    spark.dataSource.register(ZipCsv)
    spark.dataSource.register(Sheets)


def zip_csv_rows(spark: SparkSession, path: str, member: str, pattern: str = "*.zip") -> DataFrame:
    """(file, row, cells) of one named CSV member of each ZIP."""
    register_archives(spark)
    return spark.read.format("zip_csv").option("member", member).option("pattern", pattern).load(path)


def xlsx_grid(spark: SparkSession, path: str, *, pattern: str | None = None, sheet: str | None = None, first_only: bool = False, nested: bool = False) -> DataFrame:
    """Worksheets as rows of cells (file, sheet, row, cells); `nested` reads workbooks inside ZIPs."""
    register_archives(spark)
    given = {"pattern": pattern, "sheet": sheet, "firstOnly": str(first_only).lower(), "nested": str(nested).lower()}
    return spark.read.format("xlsx_sheets").options(**{k: v for k, v in given.items() if v is not None}).load(path)


def as_sheets(grid: DataFrame) -> DataFrame:
    """The (sheet_id, row, cells) form of the worksheet operators."""
    return grid.where(~F.lower("sheet").contains("microsoft")).select(
        F.concat_ws("::", "file", "sheet").alias("sheet_id"), F.col("row").cast("long").alias("row"), "cells")


def column_letters(column: Column) -> Column:
    """A, B ... Z, AA ... for the 0-based number of a worksheet column (three letters at most)."""
    letter = lambda n: F.chr(F.pmod(n, F.lit(26)) + 65)
    two, three = column - 26, column - 26 - 26 * 26
    return F.when(column < 26, letter(column)).when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two))).otherwise(
        F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))


def motif_cells(grid: DataFrame, length: int = 7, expected: int | None = None) -> DataFrame:
    """(file, sheet, address, motif) of the text cells below A1; each must be a distinct ACGT motif of that length.

    With `expected` each sheet must hold exactly so many; another number is an error.
    """
    cells = grid.select("file", "sheet", "row", F.posexplode("cells").alias("column", "motif")).where(
        (F.trim("motif") != "") & ((F.col("row") > 0) | (F.col("column") > 0)))
    counted = cells.groupBy("file", "sheet", "motif").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "column")).alias("at"))
    good = (F.col("n") == 1) & F.col("motif").rlike(f"^[ACGT]{{{length}}}$")
    if expected is not None:
        sizes = counted.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("_motifs"))
        # A sheet without any motif has no row here, so sheets come from the grid.
        sizes = grid.select("file", "sheet").distinct().join(sizes, ["file", "sheet"], "left").withColumn("_motifs", F.coalesce("_motifs", F.lit(0)))
        wrong = F.concat(F.lit(f"expected {expected} motifs, found "), F.col("_motifs").cast("string"), F.lit(" in "), F.col("sheet"))
        checked = sizes.withColumn("_motifs", F.when(F.col("_motifs") == expected, F.col("_motifs")).otherwise(F.raise_error(wrong).cast("long")))
        counted = checked.where(F.col("_motifs").isNotNull()).join(counted, ["file", "sheet"], "left").where("motif is not null")
    address = F.concat(column_letters(F.col("at.column")), (F.col("at.row") + 1).cast("string"))
    bad = F.concat(F.lit("not a distinct motif: "), F.col("motif"))
    return counted.select("file", "sheet", F.when(good, address).otherwise(F.raise_error(bad)).alias("address"), "motif")


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml) of full-text files; the file name without its ending is the id."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("doc_id"), F.col("value").alias("xml"))
