"""Bloom filters of a fixed number of bits, built by Spark and tested in Arrow batches.

What is broadcast has the size that is asked for, however many keys go in. A full filter lets more
rows through; what must be exact is joined after it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BITS = 1 << 25


def places(v: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """The three bits that stand for each 64-bit key; ``n_bits`` is a power of two."""
    shift = np.uint64(64 - (n_bits.bit_length() - 1))
    with np.errstate(over="ignore"):
        return [(W.mix(v + s) >> shift).astype(np.int64) for s in (np.uint64(0), *W.SALTS)]


def build(keys: DataFrame, n_bits: int = BITS) -> np.ndarray:
    """The filter of a LONG column: tasks set bits by word of the filter, a shuffle joins the words,
    and the driver gets n_bits / 64 words at most."""
    def bits(batches):
        for batch in batches:
            v = batch.column(0).drop_null().to_numpy().view(np.uint64)
            if len(v):
                at = np.unique(np.concatenate(places(v, n_bits)))
                words, first = np.unique(at >> 6, return_index=True)
                val = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(val.view(np.int64))], ["word", "val"])

    out = np.zeros(n_bits >> 6, np.uint64)
    got = keys.mapInArrow(bits, "word long, val long").groupBy("word").agg(F.bit_or("val").alias("val")).toArrow()
    out[got["word"].to_numpy()] = got["val"].to_numpy().view(np.uint64)
    return out


def holds(words: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.ones(len(v), bool)
    for at in places(v, len(words) << 6):
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def thinned(df: DataFrame, keys: DataFrame, n_bits: int = BITS, then: Callable | None = None, schema=None) -> DataFrame:
    """The rows of ``df`` whose first column (LONG) may be among ``keys``; null isn't.

    ``then`` maps the batches that are left to those of ``schema``, in the same worker: a mapInArrow
    after this one would hold a second Python process for each task."""
    shared = df.sparkSession.sparkContext.broadcast(build(keys, n_bits))

    def left(batches):
        for batch in batches:
            col = batch.column(0)
            ok = pa.compute.is_valid(col).to_numpy(zero_copy_only=False)
            ok = ok & holds(shared.value, pa.compute.fill_null(col, 0).to_numpy().view(np.uint64))
            if ok.any():
                yield batch.filter(pa.array(ok))

    def run(batches):
        return then(left(batches)) if then else left(batches)

    return df.mapInArrow(run, schema or df.schema)
