"""Sink for trees of benchmark stats files (S1): a Python data source.

Rows (folder, record) come grouped by folder. Each task streams a folder's JSON
records into one array in a staging folder of its own attempt, so it holds one
record at a time; when all tasks have succeeded, the commit moves each finished
folder into place. A failed or repeated attempt leaves nothing under the root.
Paths are any that Arrow's file systems know (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"
FILE, DECOY = "stats.json", "instance_stats.json"


@dataclass
class Written(WriterCommitMessage):
    """A task's staging folder and the folders that it holds."""
    staged: str = ""
    folders: list[str] = field(default_factory=list)


class StatFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "benchmark_stat_files"

    def writer(self, schema, overwrite: bool) -> "StatFilesWriter":
        if overwrite:
            raise ValueError("stats files are added to a tree, not written over it")
        return StatFilesWriter(self.options["root"], self.options.get("decoy", "false") == "true")


class StatFilesWriter(DataSourceWriter):
    def __init__(self, root: str, decoy: bool):
        self.root, self.decoy = root.rstrip("/"), decoy

    def files(self):
        """The file system of the root and the root's path in it."""
        from pyarrow.fs import FileSystem
        return FileSystem.from_uri(self.root if "://" in self.root or not self.root.startswith("file:") else
                                   "file://" + self.root.removeprefix("file:"))

    def write(self, rows: Iterator) -> Written:
        fs, root = self.files()
        done = Written(staged=f"{root}/{STAGING}/{uuid.uuid4().hex}")
        out = None
        try:
            for folder, record in rows:
                if out is None or folder != done.folders[-1]:
                    if out is not None:
                        out.write(b"]")
                        out.close()
                    done.folders.append(folder)
                    place = f"{done.staged}/{folder}"
                    fs.create_dir(place)
                    if self.decoy:
                        with fs.open_output_stream(f"{place}/{DECOY}") as other:
                            other.write(b'[{"instance_id": "decoy"}]')
                    out = fs.open_output_stream(f"{place}/{FILE}")
                    out.write(b"[")
                else:
                    out.write(b",")
                out.write(record.encode())
            if out is not None:
                out.write(b"]")
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self.files()
        for message in messages:
            for folder in message.folders if message else ():
                fs.move(f"{message.staged}/{folder}", f"{root}/{folder}")
        self.clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*self.files())

    @staticmethod
    def clear(fs, root: str) -> None:
        from pyarrow.fs import FileType
        if fs.get_file_info(f"{root}/{STAGING}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{STAGING}")
