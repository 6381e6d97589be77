"""A writer of byte ranges: each task puts its rows' bytes at their places in one mounted file.

The places are known before anything is written (prefix sums of the pieces' lengths), so no task waits for
another, and what a failed task has written is written again by the next attempt, at the same places.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import settings

#: Bytes that a writing task gathers before it writes.
GATHER = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class Places:
    """Writes at places; pieces that follow one another are gathered."""

    def __init__(self, path: str) -> None:
        self.fd, self.at, self.parts, self.size, self.total = os.open(path, os.O_WRONLY), 0, [], 0, 0

    def put(self, at: int, data: bytes) -> None:
        if at != self.at + self.size or self.size > GATHER:
            self._flush()
            self.at = at
        self.parts.append(data)
        self.size += len(data)

    def _flush(self) -> None:
        data, at = memoryview(b"".join(self.parts)), self.at
        self.total += len(data)
        while data:
            n = os.pwrite(self.fd, data, at)
            data, at = data[n:], at + n
        self.parts, self.size = [], 0

    def close(self) -> int:
        self._flush()
        os.fsync(self.fd)
        os.close(self.fd)
        return self.total


class ByteRanges(DataSource):
    """Options: path, and the bytes that all rows (at, data) have together."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "at bigint, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ByteRangesWriter(dict(self.options))


class ByteRangesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bytes = options["path"], int(options["bytes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out = Places(self.path)
        for batch in iterator:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data"), strict=True):
                out.put(at, data.as_py())
        return Written(out.close())

    def commit(self, messages: list[Written | None]) -> None:
        done = sum(m.bytes for m in messages if m)
        if done != self.bytes:
            raise RuntimeError(f"{done} of {self.bytes} bytes were written")

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


def write(rows: DataFrame, path: str, n_bytes: int, batch: int) -> None:
    """Put (at, data) into a file that has its full size already, ``batch`` rows at a time in a task."""
    spark = rows.sparkSession
    spark.dataSource.register(ByteRanges)
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}):
        rows.select("at", "data").write.format("byte_ranges").options(path=path, bytes=str(n_bytes)).mode("append").save()
