"""The sink of a report: one text file, written in parts by all tasks and joined when every part is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dossier.session import written

_CHUNK = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class TextWriter(DataSourceArrowWriter):
    """Each task writes its lines to a part of its own beside the target; a task that is run again writes another one, and only those that were committed count.

    The commit joins the parts in the order of their partitions, a chunk at a time, under a name of its own, and moves the whole to the target: readers see the old text or the new one.
    """

    def __init__(self, path: str):
        self.path, self.own = path, uuid.uuid4().hex

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        files, target = self._files()
        where = f"{target}.{self.own}.part-{context.partitionId()}-{context.taskAttemptId()}"
        with files.open_output_stream(where) as out:
            for batch in iterator:
                lines = batch.column(0).fill_null("").to_pylist()
                out.write("".join(f"{x}\n" for x in lines).encode())
        return Part(context.partitionId(), where)

    def commit(self, messages: list[Part | None]) -> None:
        files, target = self._files()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with files.open_output_stream(f"{target}.{self.own}.whole") as out:
            for part in parts:
                with files.open_input_stream(part.path) as text:
                    while chunk := text.read(_CHUNK):
                        out.write(chunk)
        files.move(f"{target}.{self.own}.whole", target)
        self._drop(files, parts)

    def abort(self, messages: list[Part | None]) -> None:
        files, _ = self._files()
        self._drop(files, [m for m in messages if m is not None])

    @staticmethod
    def _drop(files, parts: list[Part]) -> None:
        for part in parts:
            files.delete_file(part.path)


class TextReport(DataSource):
    """``df.write.format("one_text").save(uri)``: the rows' first column as the lines of one file, in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "one_text"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options["path"])


def write_report(lines: DataFrame, path: str) -> None:
    """Lines as one text at ``path`` (a URI that all executors reach): sorted by all columns but ``line``, over ranges of them, so no task holds the report.

    The lines are written once before, as the ranges come from a sample of all of them.
    """
    lines.sparkSession.dataSource.register(TextReport)
    order = [c for c in lines.columns if c != "line"]
    lines = written(lines, "report-lines")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.format("one_text").mode("overwrite").save(path)
