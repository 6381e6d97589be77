"""A data source of spectra: peaks by ranges of a binary file, and a writer of ranges.

The reader's partitions are ranges of pixel numbers; a task takes its rows of the index table (a Parquet
folder, whose row groups are skipped by their pixel numbers), joins reads that lie side by side, and gives
batches of many spectra. A range of pixels is an option: only its spectra are read. Spark's push-down of
filters into Python sources isn't used: in 4.1 the filters of one query stay with the DataFrame and wrongly
hold for the next query on it.

The writer puts each row's bytes at its own places in two files. What a failed task has written is
written again by the next attempt, at the same places.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..model import PEAKS
from . import files
from .ranges import Places, Written

#: Spectra of one partition; peaks of one batch; bytes that one read may take in for nothing.
SPECTRA, PEAKS_AT_ONCE, GAP = 2048, 1 << 18, 1 << 16
INDEX = ["pixel_id", "mo", "ml", "mt", "io", "il", "it"]


class Spectra(DataSource):
    """Options: ibd, index (a Parquet folder of INDEX), first and stop (pixel numbers), dataset_id; for writing ibd, xml and bytes."""

    @classmethod
    def name(cls) -> str:
        return "imzml_spectra"

    def schema(self) -> str:
        return PEAKS

    def reader(self, schema) -> DataSourceReader:
        return SpectraReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RangesWriter(dict(self.options))


@dataclass
class Range(InputPartition):
    """Pixel numbers from ``first`` to before ``stop``."""

    first: int
    stop: int


class SpectraReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.ibd, self.index, self.dataset_id = options["ibd"], options["index"], options["dataset_id"]
        self.first, self.stop = int(options["first"]), int(options["stop"])

    def partitions(self) -> list[Range]:
        return [Range(k, min(k + SPECTRA, self.stop)) for k in range(self.first, self.stop, SPECTRA)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition)
        with files.open_ranges(self.ibd) as f:
            some, peaks = [], 0
            for r in rows:
                some.append(r)
                peaks += min(r["ml"], r["il"])
                if peaks >= PEAKS_AT_ONCE:
                    yield self._batch(f, some)
                    some, peaks = [], 0
            if some:
                yield self._batch(f, some)

    def _rows(self, r: Range) -> list[dict]:
        """The index of a partition: ``SPECTRA`` rows at most."""
        import pyarrow.dataset as pads

        if r.stop <= r.first:
            return []
        where, path = files._of(self.index)
        at = pads.field("pixel_id")
        return pads.dataset(path, format="parquet", filesystem=where).to_table(columns=INDEX, filter=(at >= r.first) & (at < r.stop)).sort_by("pixel_id").to_pylist()

    def _batch(self, f, rows: list[dict]) -> pa.RecordBatch:
        wanted = [(r[o], r[n] * np.dtype(r[t]).itemsize, r[t], r["pixel_id"]) for r in rows for o, n, t in (("mo", "ml", "mt"), ("io", "il", "it"))]
        got: dict[int, np.ndarray] = {}
        block: list[int] = []

        def fetch() -> None:
            start = wanted[block[0]][0]
            end = max(wanted[k][0] + wanted[k][1] for k in block)
            data = f.read_at(end - start, start)
            if len(data) < end - start:
                raise ValueError(f"the binary file ends within the spectrum of pixel {wanted[block[-1]][3]}")
            for k in block:
                at, size, kind, _ = wanted[k]
                got[k] = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at - start).astype(np.float64)

        end = 0
        for k in sorted(range(len(wanted)), key=lambda k: wanted[k][0]):
            if block and wanted[k][0] > end + GAP:
                fetch()
                block = []
            end = max(end if block else 0, wanted[k][0] + wanted[k][1])
            block.append(k)
        fetch()
        sizes = np.array([min(len(got[2 * i]), len(got[2 * i + 1])) for i in range(len(rows))], np.int64)
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        cols = [
            pa.repeat(pa.scalar(self.dataset_id), total), pa.array(np.repeat(np.array([r["pixel_id"] for r in rows], np.int64), sizes)), pa.array(np.arange(total) - np.repeat(first, sizes)),
            *(pa.array(np.concatenate([got[2 * i + j][: sizes[i]] for i in range(len(rows))])) for j in (0, 1)),
        ]
        return pa.RecordBatch.from_arrays(cols, ["dataset_id", "pixel_id", "peak_idx", "mz", "intensity"])


class RangesWriter(DataSourceArrowWriter):
    """Rows (at, mz, intensity, xml_at, xml): 64-bit m/z and 32-bit intensities, then text, each at its place."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.bytes = (options["ibd"], options["xml"]), int(options["bytes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        outs = [Places(p) for p in self.paths]
        for batch in iterator:
            at, mz, inten, xml_at, xml = (batch.column(c) for c in ("at", "mz", "intensity", "xml_at", "xml"))
            for k in range(batch.num_rows):
                data = np.asarray(mz[k].values, "<f8").tobytes() + np.asarray(inten[k].values, "<f4").tobytes()
                outs[0].put(at[k].as_py(), data)
                outs[1].put(xml_at[k].as_py(), xml[k].as_py().encode())
        return Written(sum(o.close() for o in outs))

    def commit(self, messages: list[Written | None]) -> None:
        done = sum(m.bytes for m in messages if m)
        if done != self.bytes:
            raise RuntimeError(f"{done} of {self.bytes} bytes were written")

    def abort(self, messages: list[Written | None]) -> None:
        for p in self.paths:
            if os.path.exists(p):
                os.remove(p)


def read(spark: SparkSession, ibd: str, index: DataFrame, first: int, stop: int, dataset_id: str) -> DataFrame:
    """Peaks of the spectra from ``first`` to before ``stop`` in ``index``, a written table (columns INDEX)."""
    spark.dataSource.register(Spectra)
    folder = index.inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.format("imzml_spectra").options(ibd=ibd if "://" in ibd else os.path.abspath(ibd), index=folder, first=str(first), stop=str(stop), dataset_id=dataset_id).load()


def write(rows: DataFrame, ibd: str, xml: str, n_bytes: int) -> None:
    """Put (at, mz, intensity, xml_at, xml) into two files that have their full size already."""
    rows.sparkSession.dataSource.register(Spectra)
    rows.write.format("imzml_spectra").options(ibd=ibd, xml=xml, bytes=str(n_bytes)).mode("append").save()
