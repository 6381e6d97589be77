"""Fuzzy line dedup by MinHash, with DataFrame and SQL functions alone.

1. Texts are cut into lines once; a line's form is its lower case with runs of white space made one
   space, trimmed. Equal forms (equal 128-bit hashes) are one item from the signature's partial
   aggregation on, so a line that occurs in millions of documents is compared once.
2. Items get 8 bands of 3 minwise values of their 8-character shingles (a shorter line is one
   shingle). A shingle is hashed once; its 24 orders are four rotations of the hash, each
   seen from six points by exclusive or. All minima are taken in one hash aggregation.
3. A band's values propose a group. Were bands independent, a pair would miss all of
   them with probability 3e-3 at similarity 0.8, 5e-4 at 0.85 and 3e-5 at 0.9; they are not quite, so short
   lines miss more (see README). That is all that is missed, however large groups are.
4. Pairs of the groups are verified by the exact Jaccard similarity of their shingle sets (at
   least 0.8), then joined by distributed union-find. Members of a group are first compared with its
   leader, the member that is in most and largest groups (a large group has several leaders); then
   all pairs that these links don't yet join are compared, those of a large group block against
   block. There, before any sets are compared, a parity bitmap of 1,024 bits bounds their difference from
   below: two lines whose bitmaps differ in too many bits can't be similar, so nothing is missed. Of
   each component the line that comes first by (id, line number) stays.

Keys that many rows share (a band's values, a very common line) are counted by partial
aggregation; joins on them broadcast the few hot keys, whose number has a bound.

Defined cases: null and empty texts have no lines; lines of white space alone are not compared
and not returned; a very long line is an item like any other, whose groups weigh by its length;
repeated rows hold repeated lines, of which the first stays (rows of one id and line number share
their fate); a null id comes last; an empty table gives an empty result; other columns, whatever
their names, are neither read nor returned.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .branching import blocks, distinct_groups
from .components import components
from .shared import Scratch, join_counted, marked_among, maybe_among, maybe_items, one_space, runtime_filters, table

SHINGLE = 8
#: Starting places of shingles in one piece of a line, bytes of a character in UTF-32, and shingles
#: whose minima are taken before they update an aggregation.
CHUNK, UNIT, STEP = 4096, 4, 4
ROWS, BANDS = 3, 8
WIDTH = ROWS * BANDS
LEADERS, SALTS = 4, 16
#: How much wider blocks of bitmaps are than groups of lines.
WIDE = 32
#: Longs of a parity bitmap.
BITMAP = 16
ROTATIONS = (0, 8, 16, 24)
_draw = random.Random(5)
#: (rotation, point) of the minwise orders. The minimum of the rotated 32-bit hash xor point is the
#: hash that is nearest to the point; points of one rotation lie in different eighths, and the three
#: rows of a band have different rotations.
ORDERS = []
for _band in range(BANDS):
    for _row in range(ROWS):
        _c = _band + BANDS * _row
        _point = (_c // 4 * 8 // 6 << 29) | _draw.getrandbits(29)
        ORDERS.append((ROTATIONS[_c % 4], _point - (1 << 32) if _point >= 1 << 31 else _point))


def line_form(line):
    # Lines hold no ends of lines.
    return F.trim(one_space(F.lower(line), "\t\x0b\x0c"))


def pieces(form):
    """Offsets of the pieces of a line in UTF-32: they bound the memory that a long line takes."""
    return F.sequence(F.lit(0), F.greatest(F.octet_length(form) - UNIT * SHINGLE, F.lit(0)), F.lit(UNIT * CHUNK))


def starts(piece):
    """Places (from 1) of the shingles in a piece of a line in UTF-32."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(piece) - (UNIT * SHINGLE - 1), F.lit(1)), F.lit(UNIT))


def shingle_set(form):
    """The 64-bit hashes of a line's distinct shingles."""
    wide = F.encode(form, "UTF-32")
    # The one-element transform names the recoded line, so that it's made once.
    hashes = F.transform(F.array(wide), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(UNIT * SHINGLE)))))
    return F.array_distinct(F.element_at(hashes, 1))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, form, h1, h2) of all lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(F.contains(text, F.lit("\r")), F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).otherwise(text)
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    forms = cut.select("id", "line_no", line_form(F.col("line")).alias("form"))
    return forms.withColumns({"h1": F.xxhash64("form"), "h2": F.xxhash64(F.lit(1), "form")})


def banded(lines: DataFrame) -> DataFrame:
    """(h1, h2, weight, n_lines, leaves): an item's length, its lines and the hashes of its bands; all
    minima in one hash aggregation."""
    key = ["h1", "h2", "weight"]
    wide = lines.select("h1", "h2", F.char_length("form").cast("long").alias("weight"), F.encode("form", "UTF-32").alias("wide"))
    part = wide.select(*key, "wide", F.explode(pieces(F.col("wide"))).alias("k"))
    part = part.select(*key, "k", F.substring("wide", F.col("k") + 1, F.lit(UNIT * (CHUNK + SHINGLE - 1))).alias("piece"))
    last = F.greatest(F.octet_length("piece") - (UNIT * SHINGLE - 1), F.lit(1))
    at = part.select(*key, "k", "piece", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(UNIT * STEP))).alias("i"))
    # STEP shingles at a time; past the end, the last one again.
    place = lambda j: F.col("i") if j == 0 else F.least(F.col("i") + F.lit(UNIT * j), F.col("last"))
    h = at.select(*key, ((F.col("k") == 0) & (F.col("i") == 1)).cast("long").alias("first"), *(F.hash(F.substring("piece", place(j), F.lit(UNIT * SHINGLE))).alias(f"s{j}") for j in range(STEP)))
    turn = lambda c, r: F.col(c) if r == 0 else F.shiftleft(c, r).bitwiseOR(F.shiftrightunsigned(c, 32 - r))
    h = h.select(*key, "first", *(turn(f"s{j}", r).alias(f"s{j}_{r}") for j in range(STEP) for r in ROTATIONS))
    minima = [F.min(F.least(*(F.col(f"s{j}_{r}").bitwiseXOR(F.lit(p)) for j in range(STEP)))).alias(f"m{k}") for k, (r, p) in enumerate(ORDERS)]
    got = h.groupBy(*key).agg(F.sum("first").alias("n_lines"), *minima)
    return got.select(*key, "n_lines", F.array(*(F.xxhash64(F.lit(b), *(f"m{ROWS * b + r}" for r in range(ROWS))) for b in range(BANDS))).alias("leaves"))


def bitmaps(forms: DataFrame) -> DataFrame:
    """(item, size, b0, b1, ...): the number of distinct shingles and the parity bitmap of each form.

    Each shingle turns over one bit, so two bitmaps differ in no more bits than the sets do in shingles."""
    h = forms.select("item", F.explode(shingle_set(F.col("form"))).alias("h"))
    word, bit = F.shiftrightunsigned("h", 60).cast("int"), F.expr("shiftleft(1L, cast(h & 63 as int))")
    h = h.select("item", word.alias("word"), bit.alias("bit"))
    return h.groupBy("item").agg(F.count("*").alias("size"), *(F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"b{k}") for k in range(BITMAP)))


def may_be_similar(x: str, y: str, percent: int):
    """Whether sizes and bitmaps (columns with the endings ``x`` and ``y``) allow a similar pair:
    J >= p/100 means |A xor B| <= (100 - p) / (100 + p) * (|A| + |B|)."""
    size = lambda side: F.col(f"size{side}")
    fits = 100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y))
    apart = sum((F.bit_count(F.col(f"b{k}{x}").bitwiseXOR(F.col(f"b{k}{y}"))) for k in range(BITMAP)), F.lit(0))
    return fits & (apart * (100 + percent) <= (100 - percent) * (size(x) + size(y)))


def verified(pairs: DataFrame, forms: DataFrame, percent: int, scratch: Scratch, name: str, few: bool = False) -> DataFrame:
    """(a, b): the pairs (item, other) whose shingle sets are similar enough, from items' ``forms`` (item, form),
    of which the pairs may need but ``few``.

    Pairs are dealt out by their second member, which brings its form once to each of SALTS places;
    shingle sets are made there and not shuffled."""
    pairs = scratch.keep(pairs.distinct().withColumn("star", F.xxhash64("other", F.pmod(F.xxhash64("item"), F.lit(SALTS)))), f"{name}-pairs")

    def members(df: DataFrame, side: str) -> DataFrame:
        full = df.join(maybe_items(forms, df) if few else forms, "item").repartition("star")
        return full.select("star", F.col("item").alias(side), shingle_set(F.col("form")).alias(f"s_{side}"))

    near = members(pairs.select("star", "item"), "a").join(members(pairs.select("star", F.col("other").alias("item")).distinct(), "b"), "star")
    x, y = F.size("s_a"), F.size("s_b")
    # Sizes alone rule many pairs out before their sets are compared.
    near = near.where("a != b").where(100 * F.least(x, y) >= percent * F.greatest(x, y))
    # 100 k >= percent (x + y - k), with the intersection named once, so that it's made once.
    similar = (100 + percent) * F.size(F.array_intersect("s_a", "s_b")) >= percent * (x + y)
    return scratch.keep(near.where(similar).select("a", "b"), name)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, leaf_items: int = 64, leaf_weight: int = 400_000) -> DataFrame:
    """One row per line that isn't blank: id, line_no (from 0), keep_id and keep_line_no (the line
    that stays of its component), n_lines (lines of the component), kept."""
    scratch = Scratch(docs.sparkSession, "lines")
    # Blank lines are told by their hashes: steps that need no forms don't read them.
    blank = (F.col("h1") == F.xxhash64(F.lit(""))) & (F.col("h2") == F.xxhash64(F.lit(1), F.lit("")))
    lines = scratch.keep(lines_of(docs, id_col, text_col), "lines").where(~blank)
    bands = scratch.keep(banded(lines).withColumn("item", F.monotonically_increasing_id()), "bands")
    items = bands.select("item", "h1", "h2", "n_lines")

    nodes = bands.select(F.explode("leaves").alias("leaf"), "item", "weight")
    shared = scratch.keep(nodes.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # Most bands are of one item alone: they stay out of the join's shuffle.
    nodes = scratch.keep(maybe_among(nodes, shared, "leaf"), "nodes")
    together = scratch.keep(join_counted(nodes, shared, ["leaf"], "n").drop("n"), "together")
    kept = scratch.keep(distinct_groups(together, leaf_items, leaf_weight), "groups")
    scratch.drop(shared, nodes, together)
    # An item that is in many and large groups is central: it has the better chance to link a group.
    central = scratch.keep(kept.groupBy("item").agg(F.sum("n").alias("score")), "central")
    with runtime_filters(docs.sparkSession):
        wanted = scratch.keep(items.join(central.where("score > 1"), "item").select("h1", "h2", "item"), "wanted")
    # One form of each hash is left before the join, which needs no other shuffle of forms.
    forms = maybe_among(lines.select("h1", "h2", "form"), wanted, "h1").dropDuplicates(["h1", "h2"])
    forms = scratch.keep(forms.join(wanted, ["h1", "h2"]).select("item", "form"), "forms")
    # Leaders: the most central member of a small group, and some members of least hashes of a large one.
    seen = kept.join(central, "item")
    least = [F.min(F.struct((-F.col("score")).alias("s"), F.xxhash64("item").alias("h"), "item")).getField("item")]
    least += [F.min(F.struct(F.xxhash64("item", F.lit(k)).alias("h"), "item")).getField("item") for k in range(1, LEADERS)]
    leads = F.when(F.first("small"), F.array(least[0])).otherwise(F.array_distinct(F.array(*least))).alias("leaders")
    groups = scratch.keep(seen.groupBy("leaf").agg(F.count("*").alias("rows"), leads), "leaders")
    pairs = join_counted(kept.select("leaf", "item"), groups.select("leaf", "rows", F.explode("leaders").alias("other")), ["leaf"], "rows").where("item != other")
    classes = components(verified(pairs.select("item", "other"), forms, percent, scratch, "stars"), scratch)

    # Pairs are done, and groups of one component. In others, pairs that are joined already, or hold a
    # leader, aren't compared again.
    known = kept.where("n > 2").join(classes.withColumnRenamed("node", "item"), "item", "left")
    known = scratch.keep(known.select("leaf", "item", "n", "w", F.coalesce("root", "item").alias("root")), "known")
    open_ = known.groupBy("leaf").agg((F.min("root") != F.max("root")).alias("open")).where("open").drop("open").join(groups, "leaf")
    known = join_counted(known, open_, ["leaf"], "rows").where(~F.array_contains("leaders", F.col("item")))
    known = scratch.keep(known.select("leaf", "item", "n", "w", "root"), "open")
    if not known.isEmpty():
        # Bitmaps are made for members of open groups alone. Only they meet here, which are short whatever the
        # lines are: blocks are wide, so a member of a group is repeated for few of them.
        marks = scratch.keep(bitmaps(maybe_items(forms, known).join(known.select("item").distinct(), "item", "left_semi")), "bitmaps")
        dealt = blocks(known.join(marks, "item"), WIDE * leaf_items, WIDE * leaf_weight)
        left, right = (dealt.select("block", *(F.col(c).alias(f"{c}_{side}") for c in dealt.columns if c != "block")) for side in "ab")
        # Within a pair of blocks, only pairs across; a block's own pair of blocks gives its own.
        pairs = left.join(right, (left["block"] == right["block"]) & F.expr("item_a < item_b AND root_a != root_b AND (own_a != own_b OR same_a)") & may_be_similar("_a", "_b", percent))
        across = verified(pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("other")), forms, percent, scratch, "across", few=True)
        if not across.isEmpty():
            classes = components(classes.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across), scratch)

    # Lines whose component has one line alone stay; the others look for the first of theirs.
    # Items and lines that are surely none of these stay out of the joins.
    classes = classes.withColumnRenamed("node", "item")
    of = maybe_items(items.where("n_lines = 1"), classes).join(classes, "item")
    of = of.unionByName(items.where("n_lines > 1").join(classes, "item", "left"))
    of = scratch.keep(of.select("h1", "h2", "n_lines", F.coalesce("root", "item").alias("root")), "classes")
    marked = scratch.keep(marked_among(lines.select("id", "line_no", "h1", "h2"), of, "h1", "maybe"), "marked")
    rows = join_counted(marked.where("maybe").drop("maybe"), of, ["h1", "h2"], "n_lines", "left").select("id", "line_no", "root")
    rows = rows.unionByName(marked.where("NOT maybe").select("id", "line_no", F.lit(None).cast("bigint").alias("root")))
    scratch.drop(kept, central, wanted, forms)
    rows = scratch.keep(rows, "rows")
    scratch.drop(bands, lines, of, marked)
    many = rows.where("root IS NOT NULL")
    tops = many.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "line_no")).alias("top"), F.count("*").alias("n"))
    many = join_counted(many, scratch.keep(tops, "tops"), ["root"], "n")
    many = many.select("id", "line_no", F.col("top.id").alias("keep_id"), F.col("top.line_no").alias("keep_line_no"), F.col("n").alias("n_lines"))
    one = rows.where("root IS NULL").select("id", "line_no", F.col("id").alias("keep_id"), F.col("line_no").alias("keep_line_no"), F.lit(1).cast("bigint").alias("n_lines"))
    out = many.unionByName(one)
    return out.select(F.col("id").alias(id_col), "line_no", "keep_id", "keep_line_no", "n_lines", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("line_no") == F.col("keep_line_no"))).alias("kept"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
