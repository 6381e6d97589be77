"""Exact dedup by stateful streaming: keyed state on disk, without expiry.

A stream of (digest, stable identifier, content locator) rows runs through a streaming
aggregation whose state lives in RocksDB. No watermark is set, so state never expires: a later
run with the same state folder knows every text that any earlier run saw. A locator is the file that
holds the row; with the identifier it finds the text again.

The digest only proposes copies. After each batch, the texts of the digests that were hit are read
again, from the files that their locators name (those of earlier runs included), and compared in
full, byte by byte; digests whose texts differ are noted, and the text itself is the key of their rows.

Rows of a digest that very many rows share are combined before any shuffle, or meet a broadcast of
the few hot digests; no task gathers them.

Defined cases: a null text counts as empty; empty texts are copies of each other; a very long
text is one row like any other; repeated rows (the same id and text) are counted one by one and
share one result; a null id is never the one that stays unless all ids of its group are null;
an empty table gives an empty result; other columns, whatever their names, are neither read nor
returned.

Everything here is a DataFrame or SQL function; the only Python that runs per batch is the
driver's call that writes the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, join_counted, one_space, runtime_filters, session_conf, table

#: State on disk, with native memory bounded for each executor and given back after each batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text):
    """The text with each run of white space made one space; null is empty."""
    return one_space(F.coalesce(text, F.lit("")))


def sha256(col):
    return F.sha2(col, 256)


class StreamingDedup:
    """Keyed state in ``folder``: one row per digest with the smallest id, its locator and a count.

    ``ingest`` may be called again and again with new rows, also by a later session; a run that
    was lost is taken up where its last finished batch left it. ``texts`` gives (digest, norm) of the rows
    of the files that some locators (locator) name, as :func:`file_texts` does; further rows do no harm.
    """

    def __init__(self, spark: SparkSession, folder: str, texts: Callable[[DataFrame], DataFrame], id_type: str = "bigint") -> None:
        self.spark, self.folder, self.texts = spark, folder, texts
        self.first_type = f"struct<none:boolean,id:{id_type},locator:string>"

    def ingest(self, source: str, schema) -> None:
        """Take in the Parquet rows (id, digest, locator) of folder ``source`` that weren't seen yet."""
        with session_conf(self.spark, STATE):
            rows = self.spark.readStream.schema(schema).parquet(source)
            state = rows.groupBy("digest").agg(
                F.min(F.struct(F.col("id").isNull().alias("none"), "id", "locator")).alias("first"),
                F.count("*").alias("size"),
            )

            def write(df: DataFrame, epoch: int) -> None:
                # A batch that runs again after a loss overwrites its own folders.
                df.write.mode("overwrite").parquet(f"{self.folder}/updates/epoch={epoch}")
                self._compare(source, schema, epoch)

            query = (
                state.writeStream.outputMode("update").trigger(availableNow=True)
                .option("checkpointLocation", f"{self.folder}/state").foreachBatch(write).start()
            )
            query.awaitTermination()

    def _compare(self, source: str, schema, epoch: int) -> None:
        """Note the digests of this batch whose texts, read by their locators, differ."""
        spark = self.spark
        hits = self._updates().where(F.col("epoch") == epoch).where("size > 1").select("digest", "size")
        out = f"{self.folder}/differ/epoch={epoch}"
        if hits.isEmpty():
            hits.select("digest").write.mode("overwrite").parquet(out)
            return
        # Files of the hit digests: those of the rows at hand, and of the first rows of earlier runs.
        here = spark.read.schema(schema).parquet(source).join(hits, "digest", "left_semi").select("locator")
        before = self._updates().where(F.col("epoch") < epoch).join(hits, "digest", "left_semi").select(F.col("first.locator").alias("locator"))
        with runtime_filters(spark):
            found = join_counted(self.texts(here.unionByName(before).distinct()), hits, ["digest"], "size")
            # The least and the greatest text are combined before the shuffle: a huge group sends one pair a task.
            differ = found.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo != hi").select("digest")
            differ.write.mode("overwrite").parquet(out)

    def _updates(self) -> DataFrame:
        return self.spark.read.schema(f"digest string, first {self.first_type}, size bigint, epoch bigint").parquet(f"{self.folder}/updates")

    def state(self) -> DataFrame:
        """(digest, keep_id, locator, group_size): the newest update of each digest."""
        last = self._updates().groupBy("digest").agg(F.max_by(F.struct("first", "size"), "epoch").alias("s"))
        return last.select("digest", F.col("s.first.id").alias("keep_id"), F.col("s.first.locator").alias("locator"), F.col("s.size").alias("group_size"))

    def differ(self) -> DataFrame:
        """(digest): those that different texts share."""
        return self.spark.read.schema("digest string, epoch bigint").parquet(f"{self.folder}/differ").select("digest").distinct()


def file_texts(spark: SparkSession, text_col: str = "text", digest=sha256) -> Callable[[DataFrame], DataFrame]:
    """A reader of (digest, norm) from Parquet files by their locators. The list of files comes to the
    driver, as Spark's own index of files does."""
    def read(locators: DataFrame) -> DataFrame:
        norm = spark.read.parquet(*(r[0] for r in locators.collect())).select(normalised(F.col(text_col)).alias("norm"))
        return norm.select(digest(F.col("norm")).alias("digest"), "norm")

    return read


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps the normalised text to the key of the state (SHA-256 if not given); a weaker one gives the
    same result, as texts are compared in full on hits.
    """
    spark = docs.sparkSession
    digest = digest or sha256
    scratch = Scratch(spark, "exact")
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.input_file_name().alias("locator"))
    id_type = dict(norm.dtypes)["id"]
    rows = norm.select("id", digest(F.col("norm")).alias("digest"), "locator", *(() if digest is sha256 else (sha256(F.col("norm")).alias("sha"),)))
    rows = scratch.keep(rows, "digests")

    def texts(_: DataFrame) -> DataFrame:
        # All locators here are of ``docs``, which is read as it is.
        return norm.select(digest(F.col("norm")).alias("digest"), "norm")

    stream = StreamingDedup(spark, f"{scratch.root}/stream", texts, id_type)
    stream.ingest(f"{scratch.root}/001-digests", rows.schema)
    state = scratch.keep(stream.state(), "state")
    differ = scratch.keep(stream.differ(), "differ")
    scratch.remove(f"{scratch.root}/stream")

    sha = F.col("digest" if digest is sha256 else "sha").alias("sha")
    out = join_counted(rows, state.select("digest", "keep_id", "group_size"), ["digest"], "group_size")
    if not differ.isEmpty():
        # The digest alone was not enough: the text itself becomes the key of these groups.
        clash = norm.withColumn("digest", digest(F.col("norm"))).join(differ, "digest", "left_semi")
        groups = clash.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        told = clash.join(groups, "norm").select("id", "keep_id", "group_size", sha256(F.col("norm")).alias("sha"))
        out = out.join(differ, "digest", "left_anti").select("id", "keep_id", "group_size", sha).unionByName(told)
    else:
        out = out.select("id", "keep_id", "group_size", sha)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
