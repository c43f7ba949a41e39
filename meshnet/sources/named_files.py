"""A sink of text files under names of their own, side by side in one folder.

Spark's text sink names its files itself; the solver of a network looks for
given names, some in folders below. Rows are ``file, text``: the pieces of a file follow one another in
one partition, and each task streams them, so a file of any size needs no more
memory than a piece. Tasks write to a staging folder under a name of their
attempt. The driver gets names alone, and moves the files of the attempts that
Spark accepted once all tasks have ended; what failed or lost attempts wrote
goes with the staging folder. Any store that Arrow's file systems know will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from meshnet.plans.scratch import ship_package

FORMAT = "named_text"


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt put its files, and their names."""

    staged: str
    files: list[str]


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


class NamedTextWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def _store(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, rows: Iterator[Row]) -> Written:
        context = TaskContext.get()
        staged = f"{self.staging}/{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        store, root = self._store(staged)
        files, out = [], None
        try:
            for row in rows:
                if not files or row.file != files[-1]:
                    if out:
                        out.close()
                    if {"", ".", ".."} & set((row.file or "").split("/")) or row.file in files:
                        raise ValueError(f"{row.file!r} is no name of one file whose pieces follow one another")
                    store.create_dir(_folder(f"{root}/{row.file}"), recursive=True)
                    files.append(row.file)
                    out = store.open_output_stream(f"{root}/{row.file}")
                out.write((row.text or "").encode())
        finally:
            if out:
                out.close()
        return Written(staged, files)

    def commit(self, messages: list[Written | None]) -> None:
        done = [(m.staged, f) for m in messages if m for f in m.files]
        names = [f for _, f in done]
        store, root = self._store(self.folder)
        found = [] if self.overwrite else store.get_file_info([f"{root}/{f}" for f in names])
        there = [f for f, i in zip(names, found, strict=False) if i.type != fs.FileType.NotFound]
        if wrong := {f for f in names if names.count(f) > 1} if len(set(names)) < len(names) else set(there):
            self.abort(messages)
            raise ValueError(f"{', '.join(sorted(wrong)[:5])} would be written twice")
        for folder in {_folder(f"{root}/{f}") for f in names}:
            store.create_dir(folder, recursive=True)
        for staged, f in done:
            store.move(f"{self._store(staged)[1]}/{f}", f"{root}/{f}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store(self.staging)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class NamedText(DataSource):
    """``df.write.format("named_text")`` of columns ``file, text`` to the folder in the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedTextWriter:
        if [f.name for f in schema.fields] != ["file", "text"]:
            raise ValueError("the columns are file, text")
        return NamedTextWriter(self.options["path"], overwrite)


def write_named(pieces: DataFrame, folder: str, order: list[str], mode: str = "append") -> None:
    """Write ``pieces(file, text, ...)`` to ``folder``, those of a file sorted by ``order``.

    A name that is taken is an error, or replaced with the mode ``overwrite``; other files stay.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedText)
    rows = pieces.repartition("file").sortWithinPartitions("file", *order).select("file", "text")
    rows.write.format(FORMAT).mode(mode).option("path", folder).save()


def read_named(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``file, text`` of the files of ``folder`` whose name fits ``pattern``, each whole."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
