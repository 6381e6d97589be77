"""Shared folders, written tables and small helpers of the text operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import shared_dir

#: Rows of an Arrow batch where batches are to be small.
BATCH_ROWS = 1000
#: White space of the word contracts, as a character class of Java, RE2 and Python.
SPACE = r"\x20\x09-\x0D"


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffles of what runs inside go as soon as each action ends; use it where the result is written."""
    with session_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextlib.contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]):
    """Settings of the session that hold inside, and are as before after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def runtime_filters(spark: SparkSession):
    """Inside, Spark thins the rows of a shuffled join by a Bloom filter of the other side's keys before
    the shuffle, whatever their sizes. The filter has 2**26 bits at most; a full one lets more rows through."""
    name = "spark.sql.optimizer.runtime.bloomFilter."
    return session_conf(spark, {f"{name}enabled": "true", f"{name}applicationSideScanSizeThreshold": "0", f"{name}creationSideThreshold": "1g", f"{name}expectedNumItems": "4000000", f"{name}maxNumBits": str(1 << 26)})


def small_batches(spark: SparkSession):
    """Inside, what is written goes to Python workers in batches of BATCH_ROWS rows at most: the batch that a
    task holds, in the JVM and in its worker, is small beside the rest."""
    return session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)})


def pieces(batches, rows: int = 256):
    """Arrow batches cut into pieces of some rows: what a worker holds, and what goes back to the JVM at
    once, stays small whatever the texts' lengths."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Scratch:
    """A new folder below the shared one for the written tables of one call."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again: this cuts lineage and survives lost executors.

        ``options`` are the writer's."""
        out = self.path(name)
        with cleaned_shuffles(self.spark):
            df.write.options(**options).parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables that :meth:`keep` wrote, once no later step reads them."""
        self.remove(*{f.rsplit("/", 1)[0] for df in dfs for f in df.inputFiles()})

    def remove(self, *folders: str) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for folder in folders:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only. ``lower`` is faster than ``translate``; the Kelvin sign is the one
    other character whose lower case is an ASCII letter, so it goes first."""
    return F.lower(F.replace(col, F.lit("K"), F.lit("ĸ")))


def one_space(col, white: str = "\t\n\x0b\x0c\r"):
    """Runs of white space made one space; only texts that hold such a run, or white space that isn't
    a space (``white``: what may occur), go through the pattern."""
    odd = F.contains(col, F.lit("  "))
    for c in white:
        odd = odd | F.contains(col, F.lit(c))
    return F.when(odd, F.regexp_replace(col, f"[{SPACE}]+", " ")).otherwise(col)


#: A key that holds more than one in HOT_PARTS of all rows is hot: no more than HOT_PARTS keys are.
HOT_PARTS, HOT_LEAST = 4096, 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed``, whose column ``count`` says how many of ``rows`` have the key.

    Rows of hot keys stay where they are and meet a broadcast of these keys, at most HOT_PARTS of them
    (``keyed`` has one or a few rows a key); all others are joined by a shuffle. So no task gathers the
    rows of one key. ``rows`` is read up to three times: give a written table."""
    most = max(HOT_LEAST, rows.count() // HOT_PARTS)
    hot = keyed.where(F.col(count) > most)
    if hot.isEmpty():
        return rows.join(keyed, on, how)
    cold = rows.join(F.broadcast(hot.select(*on).distinct()), on, "left_anti").join(keyed.where(F.col(count) <= most), on, how)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


#: Words of 64 bits, as a power of two, of the bitmap that :func:`maybe_among` broadcasts.
FILTER_WORDS = 19


def marked_among(rows: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` with the boolean ``mark``: false where the LONG hash ``key`` is surely not among ``keys``.

    The bitmap has 2**FILTER_WORDS words at most, however many keys there are, and is broadcast as rows of
    a word; in a full one more rows are marked, so an exact join follows."""
    word = F.shiftrightunsigned(key, 64 - FILTER_WORDS)
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return held.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)).alias(mark))


def maybe_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose LONG hash ``key`` may be among ``keys``; those that surely aren't go."""
    return marked_among(rows, keys, key, "_mark").where("_mark").drop("_mark")


def maybe_items(rows: DataFrame, keys: DataFrame, key: str = "item") -> DataFrame:
    """As :func:`maybe_among`, for a ``key`` that is no hash."""
    return maybe_among(rows.withColumn("_hash", F.xxhash64(key)), keys.select(F.xxhash64(key).alias("_hash")), "_hash").drop("_hash")
