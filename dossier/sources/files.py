"""Whole files as rows, with a row for every path that can't be read; pages as files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files, and bytes of them, that one task reads.
FILES, BYTES = 256, 64 << 20
NOT_FOUND, UNREADABLE = "not found", "unreadable"
_COLUMNS = "path string, file_name string, modified timestamp, raw string, problem string"


@dataclass
class Files(InputPartition):
    """Paths with the times of their last change; a path without a time isn't there."""

    entries: list[tuple]


class FileReader(DataSourceReader):
    def __init__(self, paths: list[str], glob: str):
        self.paths, self.glob = paths, glob

    def _listed(self) -> Iterator[tuple[str, str, object, int]]:
        """URI, path and time of every file that is asked for, and its size: those of a folder by the pattern, in the order of their names."""
        from pyarrow import fs

        for uri in self.paths:
            files, path = fs.FileSystem.from_uri(uri)
            info = files.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                yield uri, path, None, 0
            elif info.type == fs.FileType.Directory:
                inside = files.get_file_info(fs.FileSelector(path))
                for x in sorted((x for x in inside if x.type == fs.FileType.File and fnmatch(x.base_name, self.glob)), key=lambda x: x.path):
                    yield uri, x.path, x.mtime, x.size
            else:
                yield uri, path, info.mtime, info.size

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for uri, path, time, n in self._listed():
            if len(out[-1].entries) == FILES or (out[-1].entries and size + n > BYTES):
                out.append(Files([]))
                size = 0
            out[-1].entries.append((uri, path, time))
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        for uri, path, time in partition.entries:
            name = path.rstrip("/").rsplit("/", 1)[-1]
            raw, problem = None, None
            if time is None:
                problem = NOT_FOUND
            else:
                try:
                    with fs.FileSystem.from_uri(uri)[0].open_input_stream(path) as f:
                        raw = f.read().decode("utf-8")
                except FileNotFoundError:  # it went meanwhile
                    problem = NOT_FOUND
                except (OSError, UnicodeDecodeError):
                    problem = UNREADABLE
            yield path, name, time, raw, problem


class FileScan(DataSource):
    """``spark.read.format("whole_files").option("paths", json_list).option("glob", pattern)``."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> FileReader:
        return FileReader(json.loads(self.options["paths"]), self.options.get("glob", "*.json"))


def scan_files(spark: SparkSession, paths: list[str], glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Texts ``path, file_name, modified, raw`` of the files (URIs; of folders those that fit the pattern), and warnings ``path, file_name, problem`` of paths that are absent or unreadable."""
    spark.dataSource.register(FileScan)
    rows = spark.read.format("whole_files").option("paths", json.dumps(paths)).option("glob", glob).load()
    return rows.filter("problem IS NULL").drop("problem"), rows.filter("problem IS NOT NULL").select("path", "file_name", "problem")


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Written pages ``path, bytes``: each of ``pages`` (``path`` as a bare name, ``html``) as a file in ``folder`` (a URI that all executors reach). A file is written aside and moved, so a task that is run again replaces it whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (html or "").encode()
                with files.open_output_stream(f"{top}/.{name}.pending") as out:
                    out.write(raw)
                files.move(f"{top}/.{name}.pending", f"{top}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return pages.select("path", F.col("html")).mapInArrow(run, "path string, bytes long")
