"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage reads what its predecessor kept, as Parquet in the shared folder, and all but the last
return the columns of ``documents``. Every stage judges rows, not ids:

- toxicity and decontamination filter whole rows, each by its own text, whatever its id;
- exact dedup knows a row by its id and a 128-bit hash of all its columns; of rows with equal texts
  (white space apart) the one with the smallest id stays, a null id last; of rows that are equal in
  every column one stays;
- near-dedup takes the id of a row where it's unique, and gives rows without an id, or with one
  that other rows share, numbers beyond the largest id: they come after all others.

Defined cases: a null or empty text is never toxic or contaminated; all rows without text or with
white space alone but one go in exact dedup (one of the empty text and one of the single space); a very
long text is one row like any other; of ties the smallest id stays; an empty table of documents,
labels or benchmark items gives a result (of no rows, or with nothing toxic or contaminated); other
columns, whatever their names, are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import op3_toxicity as toxic
from ionweave.llm import op6_decontam as leaks
from ionweave.llm.op4_near_dedup import near_dedup
from ionweave.llm.op8_mixing import mix
from ionweave.llm.op9_exact_dedup import exact_dedup
from ionweave.llm.shared import Scratch, small_batches, table

#: Toxicity and mixing can't be expressed in SQL (fitted scores; hash order), so the whole can't.
ORACLE_SQL = None


def _as_rows(docs: DataFrame, **more) -> DataFrame:
    """(row, text, and more): the whole row as one column, so that no name can clash, beside its text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"), *(v.alias(k) for k, v in more.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of op3 predicts toxic go; it learns from what the labels cover."""
    with small_batches(spark):
        model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    return toxic.clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row with the smallest id stays."""
    scratch = Scratch(spark, "copies")
    every = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*every).alias("k1"), F.xxhash64(F.lit(1), *every).alias("k2"))
    found = exact_dedup(docs.select(key.alias("key"), "text"), "key")
    kept = scratch.keep(found.where("kept").groupBy("key").agg(F.count("*").alias("n")), "kept")
    # Rows that are equal in every column share a key: one of them stays.
    rows = _as_rows(docs, key=key).select("row", "key")
    alone = rows.join(kept.where("n = 1").select("key"), "key", "left_semi").select("row.*")
    again = kept.where("n > 1").select("key")
    if again.isEmpty():
        return alone
    return alone.unionByName(rows.join(again, "key", "left_semi").dropDuplicates(["key"]).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one with the smallest id.

    The limit is that of the query op4: 100 * intersection >= 85 * union."""
    scratch = Scratch(spark, "near-copies")
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id"), F.lit(True).alias("odd"))
    shared = scratch.keep(shared, "shared-ids")
    rows = _as_rows(docs, id=F.col("doc_id").cast("bigint"))
    if shared.isEmpty():
        with small_batches(spark):
            kept = near_dedup(rows, "id").where("kept").select("id")
        return rows.select("row", "id").join(kept, "id", "left_semi").select("row.*")
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("bigint")).first()[0]
    rows = rows.join(shared, rows["id"].eqNullSafe(shared["id"]), "left").select("row", "text", rows["id"], "odd")
    number = F.when(F.col("odd"), F.lit(top) + 1 + F.monotonically_increasing_id()).otherwise(F.col("id"))
    # Written once, so that a row's number is the same in all that follows.
    rows = scratch.keep(rows.select("row", "text", number.alias("number")), "numbered")
    with small_batches(spark):
        kept = near_dedup(rows, "number").where("kept").select("number")
    return rows.select("row", "number").join(kept, "number", "left_semi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that bring the sources to their target weights; one row a document."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
