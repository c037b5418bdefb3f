"""A text sink that is written once: tasks write aside, the commit compares contents and publishes, an abort leaves nothing."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_content.json"
BUFFER = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """One task's part: its file aside, its rows and the sum of their digests."""

    file: str
    rows: int
    digest: int


class DifferentContent(ValueError):
    """The table at the path already holds other rows."""


class OnceWriter(DataSourceWriter):
    """Parts go to `<path>/_aside-<run>`; the commit moves those of the successful attempts, the manifest comes last.

    The content of a table is its header, its number of rows and the sum modulo 2^256 of the rows' SHA-256, so it
    depends neither on order nor on parts. A table without a manifest is not there.
    """

    def __init__(self, path: str, columns: list[str], sep: str):
        self.path, self.columns, self.sep = path, columns, sep
        self.aside = f"_aside-{uuid.uuid4().hex}"
        # Made here, on the driver: a task that is late after an abort finds no folder to write to.
        store, base = self._store()
        store.create_dir(f"{base}/{self.aside}", recursive=True)

    def _store(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))

    def _line(self, values: list) -> str:
        text = io.StringIO()
        csv.writer(text, delimiter=self.sep, lineterminator="\n").writerow(["" if v is None else v for v in values])
        return text.getvalue()

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = self._store()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.{'tsv' if self.sep == chr(9) else 'csv'}"
        rows = digest = 0
        with store.open_output_stream(f"{base}/{self.aside}/{name}") as raw, io.BufferedWriter(raw, BUFFER) as out:
            out.write(self._line(self.columns).encode())
            for row in iterator:
                line = self._line(list(row)).encode()
                digest = (digest + int.from_bytes(hashlib.sha256(line).digest(), "big")) % (1 << 256)
                rows += 1
                out.write(line)
        return Written(name, rows, digest)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        done = [m for m in messages if m is not None]
        content = {"columns": self.columns, "rows": sum(m.rows for m in done), "digest": f"{sum(m.digest for m in done) % (1 << 256):064x}"}
        try:
            if store.get_file_info(f"{base}/{MANIFEST}").type == FileType.File:
                with store.open_input_file(f"{base}/{MANIFEST}") as held:
                    if {k: v for k, v in json.loads(held.read()).items() if k != "files"} != content:
                        raise DifferentContent(f"{self.path} already holds different content")
                return
            # Parts that an earlier driver moved before it was lost are of no table.
            if store.get_file_info(base).type == FileType.Directory:
                for left in _parts(store, base):
                    store.delete_file(left)
            files = [m.file for m in done if m.rows] or [m.file for m in done[:1]]
            for name in files:
                store.move(f"{base}/{self.aside}/{name}", f"{base}/{name}")
            with store.open_output_stream(f"{base}/{MANIFEST}") as out:
                out.write(json.dumps({**content, "files": sorted(files)}).encode())
        finally:
            self._drop(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*self._store())

    def _drop(self, store: FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{self.aside}").type == FileType.Directory:
            store.delete_dir(f"{base}/{self.aside}")


def _parts(store: FileSystem, base: str) -> list[str]:
    return [f.path for f in store.get_file_info(FileSelector(base)) if f.type == FileType.File and f.base_name.startswith("part-")]


class WrittenOnce(DataSource):
    """`df.write.format("text_once").mode("append").option("sep", ...).save(path)`: delimited text with a header, written once."""

    @classmethod
    def name(cls) -> str:
        return "text_once"

    def writer(self, schema, overwrite: bool) -> OnceWriter:
        if overwrite:
            raise ValueError("a table that is written once is not overwritten")
        return OnceWriter(self.options["path"], schema.names, self.options.get("sep", "\t"))


def write_committed(rows: DataFrame, path: str, *, sep: str = "\t", allow_empty: bool = True) -> None:
    """Write a table once: the same content again is accepted, other content raises, a failed run leaves nothing."""
    if not allow_empty and rows.isEmpty():
        raise ValueError(f"refusing to write an empty table to {path}")
    nested = [c for c, t in rows.dtypes if t.startswith(("array", "map", "struct"))]
    if nested:
        raise ValueError(f"nested columns {nested} have no text form")
    text = rows.select(*[rows[c].cast("string").alias(c) for c in rows.columns])
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(WrittenOnce)
    text.write.format("text_once").mode("append").option("sep", sep).save(path)
