"""A batch data source ``rasterfiles``: binary rows written as files, one a row.

    spark.dataSource.register(RasterFiles)
    files.select("name", "file").write.format("rasterfiles").mode("append").save(path)
    spark.read.format("rasterfiles").load(path)

``path`` is a folder that executors and driver share (pyarrow opens it, so
any store pyarrow knows will do).  Files appear under their names only when
the whole job has been committed; a failed job leaves none.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "name string, file binary"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, base = store(self.path)
        context = TaskContext.get()
        folder = f"{base}/.part-{context.partitionId()}-{context.taskAttemptId()}"
        done = []
        try:
            for batch in iterator:
                for name, file in zip(batch.column("name").to_pylist(), batch.column("file").to_pylist()):
                    if not name or "/" in name or name.startswith("."):
                        raise ValueError(f"{name!r} is no name for a file")
                    if not done:  # a task without files leaves nothing, however late it comes
                        fs.create_dir(folder)
                    held = f"{folder}/{len(done)}"
                    with fs.open_output_stream(held) as out:
                        out.write(file or b"")
                    done.append((held, name))
        except BaseException:
            with contextlib.suppress(OSError):  # there may be none yet
                fs.delete_dir(folder)
            raise
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        fs, base = store(self.path)
        for m in messages:
            for held, name in m.files if m else ():
                fs.move(held, f"{base}/{name}")
        self._clear(fs, base)

    def abort(self, messages: list[Written]) -> None:
        self._clear(*store(self.path))

    def _clear(self, fs, base) -> None:
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith(".part-"):
                fs.delete_dir(info.path)


class Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        fs, base = store(self.path)
        names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(base)) if i.is_file and not i.base_name.startswith("."))
        return [InputPartition(names[a:a + self.per_task]) for a in range(0, len(names), self.per_task)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, base = store(self.path)
        for name in partition.value:
            with fs.open_input_stream(f"{base}/{name}") as source:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([source.read()], pa.binary())], names=["name", "file"])


class RasterFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("filespertask", 64)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)
