"""A sink that writes one file per document from its parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class DocumentFiles(DataSource):
    """Rows (file_name, text), those of a file next to each other and in order, as ``<path>/<file_name>``."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, files: int) -> None:
        self.files = files


class _Writer(DataSourceWriter):
    """Each task streams its rows into a hidden file that takes its name when the next one starts.

    A file so is whole or absent under its name, and a task that runs again replaces its files by equal ones.
    What a failed task leaves hidden goes when the write is committed or given up.
    """

    def __init__(self, path: str) -> None:
        self.path, self.hidden = path, f"_open-{uuid.uuid4().hex}"

    def _place(self) -> tuple:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return system, base.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, base = self._place()
        system.create_dir(f"{base}/{self.hidden}", recursive=True)
        name, out, temporary, files = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(temporary, f"{base}/{name}")

        for row in iterator:
            if row.file_name != name:
                close()
                name, files = row.file_name, files + 1
                temporary = f"{base}/{self.hidden}/{uuid.uuid4().hex}"
                out = system.open_output_stream(temporary)
            out.write((row.text or "").encode())
        close()
        return _Written(files)

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = self._place()
        if system.get_file_info(f"{base}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.hidden}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


def write_files(parts: DataFrame, path: str, key: str, order: str, name: str, text: str) -> None:
    """One file per ``key`` of its ``text`` parts in ``order``, called by the column ``name``.

    The parts of a document are sorted into one task, with spilling, and pass through it one at a time, so a
    file costs the memory of its largest part.
    """
    spark: SparkSession = parts.sparkSession
    spark.dataSource.register(DocumentFiles)
    placed = parts.repartition(key).sortWithinPartitions(key, order)
    placed.selectExpr(f"`{name}` AS file_name", f"`{text}` AS text").write.format("document_files").mode("append").save(path)
