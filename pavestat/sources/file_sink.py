"""A sink of binary files, one per row, with Spark's two-step commit.

Each task writes into a folder of its own inside a staging folder that the driver makes; when
all have ended the driver moves the folders of the tasks that count (one rename a task, not a
file) and removes the rest. Of a task that was killed or ran twice nothing is left, and one that
runs on after the write was given up finds no staging folder to write to. Files lie at ``path/part-<task>-<write>/<name>``;
Spark's ``binaryFile`` source reads them back.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.relational import unique

NAME = "pavestat_files"
#: How often the removal of a staging folder is tried.
TRIES = 10


@dataclass
class Staged(WriterCommitMessage):
    task: int
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.write_id = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _staging(self, root: str) -> str:
        return f"{root}/_temporary-{self.write_id}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = self._root()
        task = TaskContext.get().partitionId()
        folder = f"{self._staging(root)}/{task}-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=False)
        n = 0
        for name, content in iterator:
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no name of a file: {name!r}")
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(content or b""))
            n += 1
        return Staged(task, folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._root()
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.base_name.startswith("part-"):
                    system.delete_dir(old.path)
        for m in messages:
            if m is not None and m.files:
                system.move(m.folder, f"{root}/part-{m.task:05d}-{self.write_id}")
        self._clean(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*self._root())

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        """Tasks that have not been told yet may add a file while the folder goes."""
        for left in range(TRIES, 0, -1):
            if system.get_file_info(self._staging(root)).type != fs.FileType.Directory:
                return
            try:
                system.delete_dir(self._staging(root))
            except OSError:
                if left == 1:
                    raise
                time.sleep(0.2)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        writer = FileWriter(self.options["path"], overwrite)
        system, root = writer._root()
        system.create_dir(writer._staging(root))
        return writer


def write_files(df: DataFrame, path: str, name: str | Column, content: str | Column, mode: str = "append") -> None:
    """A file for each row of ``df``. ``name`` is a file's name, not a path; null content is an
    empty file. ``overwrite`` replaces the files of earlier writes when this one is committed.
    ``path`` is a folder that all tasks and the driver reach, with or without a scheme."""
    df.sparkSession.dataSource.register(Files)
    own = [F.col(c) if isinstance(c, str) else c for c in (name, content)]
    df.select(own[0].alias("name"), own[1].alias("content")).write.format(NAME).mode(mode).save(path)


def write_masks(df: DataFrame, path: str, key: str = "sample_id", mask: str = "mask") -> DataFrame:
    """One ``.png`` file for each sample that has a mask; ``(key, mask_path)`` of them. A key must
    not repeat: the write fails and leaves nothing."""
    name = F.concat(F.url_encode(F.col(key).cast("string")), F.lit(".png"))
    own = unique(df.where(F.col(mask).isNotNull() & F.col(key).isNotNull()).select(key, mask), [key])
    write_files(own, path, name, mask, "overwrite")
    listed = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    named = df.where(F.col(key).isNotNull()).select(key, name.alias("file"))
    return named.join(listed, "file").select(key, F.col("path").alias("mask_path"))
