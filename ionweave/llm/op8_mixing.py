"""Mixing sources to target weights by entropy balancing.

The mix with the least Kullback-Leibler divergence from the corpus' own tokens, subject to one
token constraint a source, has exponentially tilted document rates exp(lambda of the source). The
convex dual, sum over documents of size * exp(lambda_s) less lambda_s * target_s over sources, is
minimised by distributed Newton iterations: each aggregates the gradient and the Hessian (diagonal,
as a document has one source) from the documents, counted once by source and class of size, and
writes the new multipliers. They stop when the largest relative gradient is below TOLERANCE; only
that number comes to the driver.

Rates are then rounded into whole copies, largest documents first: each class of
nearly equal sizes takes the number of copies that makes up what larger ones left, and spreads
them evenly over its documents in hash order. Reruns agree: the order depends on ids and texts alone.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all sizes; a target
stops at three times its source's size, the excess is reshared by weight. Equivalently every
target is min(3 * size, c * weight) for one level c.

Defined cases: null and empty texts have size 0 and nothing is taken of them; a null source is a
source of its own; repeated rows are rows of their own; ties of hash order are broken by the id;
an empty table gives an empty result; other columns, whatever their names, are neither read nor
returned.

Everything here is a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, Scratch, join_counted, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Rows of one source and class that one task ranks, about.
RANKED_ROWS = 1_000
#: Newton's iterations stop at this relative gradient; STEPS is far more than they take.
TOLERANCE, STEPS = 1e-12, 200


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(no_source, src, source_size, target) of (no_source, src, source_size).

    One row a source comes in; the two ordered windows here are over sources, not documents.
    """
    by_name = Window.orderBy("no_source", F.col("src"))
    k = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("top", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("top") / F.col("w"))
    before = Window.orderBy("ratio", "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("top").over(before), F.lit(0.0))
    spent = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("n", F.row_number().over(Window.orderBy("ratio", "no_source", "src")))
    s = s.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("w").over(every) - spent))
    # The level at the first source that isn't stopped holds for all later ones.
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("n"))).over(every)
    s = s.withColumn("target", F.least(F.col("top"), F.coalesce(level, F.lit(float("inf"))) * F.col("w")))
    return s.select("no_source", "src", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def newton(cells: DataFrame, per: DataFrame, scratch: Scratch) -> DataFrame:
    """(no_source, src, rate): exp(lambda) at the minimum of the dual, from ``cells`` (no_source, src,
    cls, tokens) and the targets ``per``; a source without a target has rate 0."""
    key = ["no_source", "src"]
    at = per.where("target > 0").select(*key, "target", F.lit(0.0).alias("lam"))
    for _ in range(STEPS):
        # Gradient: tokens * exp(lambda) - target; Hessian: tokens * exp(lambda), summed over documents.
        mass = cells.join(at, key).groupBy(*key).agg(F.sum(F.col("tokens") * F.exp("lam")).alias("mass"), F.first("lam").alias("lam"), F.first("target").alias("target"))
        gradient = F.col("mass") - F.col("target")
        # A step of more than 2 would leave the range in which the quadratic model is of use.
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gradient / F.col("mass")))
        after = scratch.keep(mass.select(*key, "target", (F.col("lam") - step).alias("lam"), (F.abs(gradient) / F.col("target")).alias("off")), "newton")
        off = after.agg(F.max("off")).first()[0]
        at = after.drop("off")
        if off is None or off < TOLERANCE:
            break
    return at.select(*key, F.exp("lam").alias("rate"))


def size_class(size):
    """Sizes up to 16 are classes of their own, then 16 classes an octave."""
    return F.when(size <= 16, size.cast("long")).otherwise(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 16) - 47)


def class_copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Copies of each class of (no_source, src, rate, cls, n, tokens): a fold over the classes of a
    source, some hundreds at most, from the largest documents to the smallest."""
    lists = classes.groupBy("no_source", "src", "rate").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "tokens")), asc=False).alias("cs"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<cls:bigint,n:bigint,copies:bigint>>").alias("out"))

    def step(acc, c):
        due = acc["carry"] + F.col("rate") * c["tokens"]
        mean = c["tokens"] / c["n"]
        k = F.greatest(F.lit(0), F.least(F.round(due / mean).cast("bigint"), most * c["n"])).cast("bigint")
        one = F.struct(c["cls"].cast("bigint").alias("cls"), c["n"].cast("bigint").alias("n"), k.alias("copies"))
        return F.struct((due - k * mean).alias("carry"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = lists.select("no_source", "src", F.explode(F.aggregate("cs", start, step)["out"]).alias("c"))
    return folded.select("no_source", "src", "c.cls", "c.n", "c.copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), size.alias("size"), F.col(text_col).alias("text"))
    # The one scan of the texts; what follows reads this narrow table. Equal h: the same id and text.
    h = F.xxhash64("id", F.col("text"))
    rows = scratch.keep(rows.select("id", "no_source", "src", "size", h.alias("h"), size_class(F.col("size")).alias("cls")), "sizes")
    key = ["no_source", "src"]
    cells = scratch.keep(rows.where("size > 0").groupBy(*key, "cls").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "classes")
    per = rows.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    counts = scratch.keep(per, "sources")
    per = scratch.keep(targets(counts.drop("rows"), weights, most).join(counts.select(*key, "rows"), key), "targets")
    rate = F.least(F.coalesce("rate", F.lit(0.0)), F.lit(float(most))).alias("rate")
    rates = per.select(*key).join(newton(cells, per, scratch), key, "left").select(*key, rate)
    copies = scratch.keep(class_copies(cells.join(rates, key), most), "copies")

    # Ranks within a class, in two steps so that no task ranks a whole hot class.
    got = join_counted(rows, copies.withColumnRenamed("copies", "class_copies"), [*key, "cls"], "n", "left")
    got = got.withColumn("part", F.pmod("h", 1 + F.expr(f"coalesce(n, 0) div {RANKED_ROWS}")))
    offsets = got.where("size > 0").groupBy(*key, "cls", "part").agg(F.count("*").alias("part_rows"))
    offsets = offsets.withColumn("offset", F.sum("part_rows").over(Window.partitionBy(*key, "cls").orderBy("part")) - F.col("part_rows")).drop("part_rows")
    rank = F.row_number().over(Window.partitionBy(*key, "cls", "part").orderBy("h", "id", "size")) - 1
    ranked = got.where("size > 0").withColumn("rank", rank).join(offsets, [*key, "cls", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    up_to = lambda k: F.expr(f"(rank + {k}) * class_copies div n")
    took = F.coalesce(up_to(1) - up_to(0), F.lit(0)).cast("bigint")
    out = scratch.keep(ranked.select("id", *key, "size", took.alias("copies")).unionByName(rows.where("size = 0").select("id", *key, "size", F.lit(0).cast("bigint").alias("copies"))), "taken")
    out = join_counted(out, per, key, "rows")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")
