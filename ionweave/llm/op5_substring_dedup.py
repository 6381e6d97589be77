"""Substring dedup by difference-cover anchors.

{1, 2, 4} is a perfect difference cover modulo 7: for any two word positions there is a shift
below 7 that takes both onto cover positions. A match of 13 words therefore holds, at some
aligned pair of cover positions, a common run of 13 - 7 + 1 = 7 words: the anchor. Only 3 in 7
positions are hashed for anchors. Matches are then extended: each 13-word window that holds a
shared anchor is hashed in full (96 bits), and the smallest document of each window hash decides
which windows are copies.

Shared anchors reach the second scan as a Bloom filter of a fixed number of bits
(``filter_bits``), so what is broadcast doesn't grow with the data. The filter can only let
further windows through, which the full hashes then clear; results never depend on its size.

Defined cases: null or empty texts have no words and give the digest of the empty text; a very
long text is one row; repeated rows of one id are the same document and don't remove each
other's words; a null id is no smaller than any other and no id is smaller than it, so its words stay; an empty table gives an empty result; other
columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from . import words as W
from .shared import Scratch, table

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
HOT_PARTS, HOT_LEAST = 4096, 1000


def _anchors(text: pa.Array):
    """For each slice: row of the batch, word index in the row, and hash of each anchor; with the word hashes."""
    for a, b, data, at in W.slices(text):
        starts, ends, rows = W.bounds(data, at)
        h = W.word_hashes(data, starts, ends)
        v, pos = W.windows(h, rows, ANCHOR)
        first = W.counts_before(rows, b - a)
        keep = np.isin((pos - first[rows[pos]]) % PERIOD, COVER) if len(pos) else np.zeros(0, bool)
        yield a, rows, first, h, pos[keep], v[keep], (data, at, starts, ends)


def _scan_anchors(batches):
    """(anchor, n): n documents of a batch hold the anchor."""
    for batch in batches:
        got = pa.compute.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
        vs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, rows, _, _, pos, v, _ in _anchors(batch.column(1)):
            d = rows[pos] + a
            vs.append(v[got[d]])
            ds.append(d[got[d]])
        v, d = np.concatenate(vs), np.concatenate(ds)
        order = np.argsort(v, kind="stable")  # rows of one anchor stay in order
        v, d = v[order], d[order]
        if len(v):
            new = np.concatenate([[True], v[1:] != v[:-1]])
            n = np.add.reduceat((new | np.concatenate([[True], d[1:] != d[:-1]])).astype(np.int64), at := np.flatnonzero(new))
            yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(n)], ["anchor", "n"])


def _scan_windows(shared):
    """Full hashes of the windows that hold an anchor of the filter; hot: one that holds a hot anchor."""
    def mark(pos, n):
        hit = np.bincount(np.maximum(pos - (WINDOW - ANCHOR), 0), minlength=n + 1) - np.bincount(pos + 1, minlength=n + 1)
        return np.cumsum(hit)[:n] > 0

    def scan(batches):
        words, hot = shared.value
        for batch in batches:
            ids = batch.column(0)
            got = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
            ids = pa.compute.fill_null(ids, 0).to_numpy()
            for a, rows, first, h, pos, v, _ in _anchors(batch.column(1)):
                inside = bloom.holds(words, v)
                pos, v = pos[inside], v[inside]
                w1, start = W.windows(h, rows, WINDOW)
                keep = mark(pos, len(h))[start] & got[rows[start] + a]
                if keep.any():
                    w2, _ = W.windows(h, rows, WINDOW, 1)
                    s = start[keep]
                    is_hot = mark(pos[np.isin(v, hot)], len(h))[s]
                    yield pa.RecordBatch.from_arrays([pa.array(w1[keep].view(np.int64)), pa.array((w2[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[rows[s] + a]), pa.array((s - first[rows[s]]).astype(np.int32)), pa.array(is_hot)], ["w1", "w2", "id", "pos", "hot"])

    return scan


def _later(batches):
    """(id, pos) of rows whose id is greater than ``lo``, where it is known, or else than the first of
    their (w1, w2), from sorted batches."""
    key, least = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, ids = (batch.column(k).to_numpy() for k in range(3))
        new = np.concatenate([[key != (w1[0], w2[0])], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        firsts = np.concatenate([[least], ids[new]])[np.cumsum(new)]
        key, least = (w1[-1], w2[-1]), firsts[-1]
        lo = batch.column(4)
        known = pa.compute.is_valid(lo).to_numpy(zero_copy_only=False)
        out = ids > np.where(known, pa.compute.fill_null(lo, 0).to_numpy(), firsts)
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(batch.column(3).to_numpy()[out])], ["id", "pos"])


def _rewrite(batches):
    for batch in batches:
        n, gone, sha, kept = [], [], [], []
        at_lists = batch.column(2)
        for a, b, data, at in W.slices(batch.column(1)):
            starts, ends, rows = W.bounds(data, at)
            first = W.counts_before(rows, b - a)
            for i in range(b - a):
                lo, hi = first[i], first[i + 1]
                pos = at_lists[a + i].values
                drop = np.zeros(hi - lo, bool)
                if pos is not None and len(pos):
                    cover = np.zeros(hi - lo + 1, np.int64)
                    p = pos.to_numpy(zero_copy_only=False)
                    np.add.at(cover, p, 1)
                    np.add.at(cover, np.minimum(p + WINDOW, hi - lo), -1)
                    drop = np.cumsum(cover)[:-1] > 0
                left = np.flatnonzero(~drop) + lo
                text = b" ".join([data[starts[k] : ends[k]].tobytes() for k in left]) if len(left) < hi - lo or hi == lo else b" ".join(data[at[i] : at[i + 1]].tobytes().split())
                n.append(int(hi - lo))
                gone.append(int(drop.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def copied_windows(docs: DataFrame, id_col: str, text_col: str, filter_bits: int, scratch: Scratch) -> DataFrame:
    """(id, pos): word starts of the windows that a document with a smaller id holds too."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    anchors = texts.mapInArrow(_scan_anchors, "anchor long, n long")
    shared = scratch.keep(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    # Anchors that hold more than one in HOT_PARTS of all shared ones: no more than HOT_PARTS.
    least = max(HOT_LEAST, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_PARTS)
    hot = np.array([r[0] for r in shared.where(F.col("n") > least).select("anchor").collect()], np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast((bloom.build(shared.select("anchor"), filter_bits), hot))
    w = scratch.keep(texts.mapInArrow(_scan_windows(known), "w1 long, w2 int, id long, pos int, hot boolean"), "windows")
    # Hot windows: no more than HOT_PARTS can be in more than one in HOT_PARTS of all places. Whether
    # a row is marked hot depends on its place, so the marked rows choose the windows and all rows of
    # these give the smallest ids, combined before the shuffle and broadcast: no task gathers the rows.
    most = max(HOT_LEAST, w.count() // HOT_PARTS)
    first = w.where("hot").groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")
    first = scratch.keep(first, "hot")
    # All other rows fall into one group of null keys, which joins with nothing.
    chosen = w.join(F.broadcast(first.withColumn("chosen", F.lit(True))), ["w1", "w2"], "left")
    first = chosen.groupBy(*(F.when(F.col("chosen"), F.col(c)).alias(c) for c in ("w1", "w2"))).agg(F.min("id").alias("lo"))
    w = w.join(F.broadcast(scratch.keep(first, "first")), ["w1", "w2"], "left")
    # Rows of hot windows are dealt out by document; equal ones of any other window, which few
    # share, meet in one task, sorted, and stream past the first of them.
    at = F.when(F.col("lo").isNull(), F.col("w1")).otherwise(F.xxhash64("id", "pos"))
    dealt = w.select("w1", "w2", "id", "pos", "lo", at.alias("at")).repartition("at").sortWithinPartitions("w1", "w2", "id")
    return dealt.mapInArrow(_later, "id long, pos int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 27) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 and kept_text (kept words
    joined by one space). ``filter_bits``: a power of two; 2**27 bits are 16 MB."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    copied = copied_windows(docs, id_col, text_col, filter_bits, scratch)
    # A list of a document's own positions: no longer than the document.
    lists = scratch.keep(copied.groupBy("id").agg(F.collect_set("pos").alias("at")), "lists")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = texts.join(lists, "id", "left").select("id", "text", "at").mapInArrow(_rewrite, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT p.doc_id, p.i, md5(array_to_string(d.w[p.i:p.i+12], chr(1))) AS h FROM p JOIN d ON p.doc_id = d.doc_id),
f AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f ON g.h = f.h WHERE f.lo < g.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
