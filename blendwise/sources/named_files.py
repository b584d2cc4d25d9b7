"""A batch sink for one file per row, under the name that the row gives.

Executors write the files under their final names; nothing is renamed afterwards by the driver. A file appears
whole or not at all: it is written under a hidden name beside its place and moved there by the task itself. A task that
fails removes what it had put down, and an aborted job removes what its finished tasks had. A task that is run again
meets its own files with the same content and leaves them; a file with other content is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """The files that one task put down."""

    paths: list[str] = field(default_factory=list)


class NamedFiles(DataSource):
    """Rows (name, value) become files ``<path>/<name>`` with the text ``value``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are only added: use mode append")
        return NamedFilesWriter(self.options["path"])


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = file_system(self.folder)
        files.create_dir(root, recursive=True)
        done = Written()
        try:
            for row in rows:
                final, content = f"{root}/{row['name']}", row["value"].encode()
                if files.get_file_info(final).type != fs.FileType.NotFound:
                    with files.open_input_stream(final) as found:
                        if found.read() != content:
                            raise FileExistsError(f"{final} exists already")
                    continue
                hidden = f"{root}/.{row['name']}-{uuid.uuid4().hex}"
                with files.open_output_stream(hidden) as out:
                    out.write(content)
                files.move(hidden, final)
                done.paths.append(final)
        except BaseException:
            self._remove(files, done.paths)
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Nothing is left to do: every file is in its place."""

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = file_system(self.folder)
        for message in messages:
            self._remove(files, message.paths if message else [])

    @staticmethod
    def _remove(files: fs.FileSystem, paths: list[str]) -> None:
        for path in paths:
            if files.get_file_info(path).type != fs.FileType.NotFound:
                files.delete_file(path)


def write_named_files(df: DataFrame, folder: str) -> None:
    """Write rows (name, value) as files of a folder, made if it is missing."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("name", "value").write.format(FORMAT).mode("append").save(folder)
