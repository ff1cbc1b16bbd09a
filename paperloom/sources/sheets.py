"""Spreadsheet files as a sink: a file for each sheet and task, marked and headed once, and all or nothing of a job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Byte-order mark, by which spreadsheet programs know UTF-8.
BOM = "﻿"
_STAGING = "_staging"


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task in the staging folder, and the names they get."""

    files: list[tuple[str, str]]


class SheetWriter(DataSourceWriter):
    """Each attempt of a task writes to names of its own; only what the job commits is moved to where readers look."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        job = uuid.uuid4().hex
        self.staging = f"{_STAGING}-{job}"
        # Files that are added must not take the names of those that are there.
        self.tag = "" if overwrite else f"-{job}"

    def _at(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")
        return store, root.rstrip("/")

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        store, root = self._at()
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        task, files, sheet, out = TaskContext.get().partitionId(), [], None, None
        try:
            for row in rows:
                if out is None or row["sheet"] != sheet:
                    if out is not None:
                        out.close()
                    sheet = row["sheet"]
                    # A sheet that comes back in the same task goes on in a file of its own.
                    name = f"{quote(sheet or '', safe=' ')}-{task:05d}-{len(files):03d}{self.tag}.csv"
                    files.append((f"{root}/{self.staging}/{uuid.uuid4().hex}", f"{root}/{name}"))
                    out = store.open_output_stream(files[-1][0])
                    out.write((BOM + row["head"] + "\n").encode())
                out.write((row["line"] + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = self._at()
        store.create_dir(root, recursive=True)
        new = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            kept = {name for _, name in new}
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.is_file and info.path.endswith(".csv") and info.path not in kept:
                    store.delete_file(info.path)
        for staged, name in new:
            store.move(staged, name)
        self._clean(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*self._at())

    def _clean(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class SheetSource(DataSource):
    """`df.write.format("sheets")`: rows (sheet, head, line); rows of a sheet that follow each other share a file."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        missing = {"sheet", "head", "line"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"sheets need the columns {sorted(missing)}")
        return SheetWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)


def write_sheets(sheets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write `sheets` (sheet, head, ord, line) as files under `path`, in a folder that all executors share.

    Rows are range-sorted by sheet and ord, so that a sheet of many rows lies in several files, whose names sort like its
    rows; each begins with the mark and the head. An empty table writes no file. A job that fails leaves what was there.
    """
    register(sheets.sparkSession)
    ordered = sheets.repartitionByRange("sheet", "ord").sortWithinPartitions("sheet", "ord")
    ordered.select("sheet", "head", "line").write.format("sheets").mode(mode).option("path", path).save()
