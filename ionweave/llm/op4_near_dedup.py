"""MinHash near-dedup by a chosen-path set similarity join.

1. One scan makes a signature of 128 minwise values, the set size and a 128-bit set hash of each
   document. Equal sets become one representative, so copies cost one row from here on.
2. ``trees`` independent trees start by splitting the representatives on two signature
   coordinates each; groups that stay large branch on (see ``branching``). Small groups are leaves.
   At similarity 0.85 a pair misses all 16 trees' first splits with probability 1e-9.
3. In each leaf all pairs are compared by their signatures (128 coordinates; the cut lies over
   five standard deviations below the threshold). Members with a promising partner bring their
   full sets, and a union-find per leaf confirms links on full sets: integer arithmetic,
   ``100 * intersection >= 85 * union``. Pairs that are already joined aren't compared again, so
   a leaf of many near copies yields a spanning forest and not all its pairs.
4. Distributed union-find over the leaves' forests gives each document its component.

Defined cases: null and empty texts have the empty set and are linked with nothing; fewer than
five words are one shingle; a very long text is one row whose pairs weigh by its length; rows that
share an id are one document of the graph, which the set with the smallest hash stands for; rows with a null id are linked with nothing and get a
null component; an empty table gives an empty result; other columns, whatever their names, are
neither read nor returned. Ids are integers; cast others, or number them, before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .bloom import thinned
from .branching import refine
from .components import components
from .shared import Scratch, table

N_SIG = 128
_A = np.random.default_rng(77).integers(1, 2**63, N_SIG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = np.random.default_rng(78).integers(0, 2**63, N_SIG, dtype=np.uint64)


def _sketch(batches):
    for batch in batches:
        n = batch.num_rows
        size, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sig = np.zeros((n, N_SIG), np.int32)
        for a, b, data, at in W.slices(batch.column(1)):
            r, v = W.shingle_sets(data, at)
            if not len(r):
                continue
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            rows = r[first] + a
            size[rows] = np.diff(np.concatenate([first, [len(r)]]))
            with np.errstate(over="ignore"):
                h1[rows] = np.add.reduceat(W.mix(v), first)
                h2[rows] = np.add.reduceat(W.mix(v ^ W.SALTS[1]), first)
                for k in range(N_SIG):
                    sig[rows, k] = (np.minimum.reduceat((v ^ _X[k]) * _A[k], first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * N_SIG), pa.array(sig.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], ["id", "n", "h1", "h2", "sig"])


def _sets(batches):
    for batch in batches:
        for a, b, data, at in W.slices(batch.column(1)):
            r, v = W.shingle_sets(data, at)
            offsets = np.searchsorted(r, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.view(np.int64)))], ["item", "elems"])


def _low_bytes(batches):
    for batch in batches:
        sig = batch.column(4).flatten().to_numpy().astype(np.uint8).reshape(-1, N_SIG)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in sig], pa.binary())], ["item", "n", "sig"])


def _groups(batches, names):
    """Whole groups of rows with the same first column, from batches sorted by it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _out(cols, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _promising(cut: int, num: int, den: int):
    """(leaf, item) of members with a partner whose signature and size allow a link."""
    def run(batches):
        leaves, items = [], []
        for t in _groups(batches, None):
            m = t.num_rows
            low = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(m, N_SIG)
            n = t.column(2).to_numpy()
            good = np.zeros(m, bool)
            for i in range(m - 1):
                same = (low[i + 1 :] == low[i]).sum(1) >= cut
                lo, hi = np.minimum(n[i + 1 :], n[i]), np.maximum(n[i + 1 :], n[i])
                same &= den * lo >= num * hi
                if same.any():
                    good[i] = True
                    good[i + 1 :] |= same
            if good.any():
                leaf, ids = t.column(0)[0].as_py(), t.column(1).to_numpy()[good]
                leaves += [leaf] * len(ids)
                items += ids.tolist()
            if len(leaves) > 20_000:
                yield _out((leaves, items), ["leaf", "item"], [pa.int64(), pa.int64()])
                leaves, items = [], []
        if leaves:
            yield _out((leaves, items), ["leaf", "item"], [pa.int64(), pa.int64()])

    return run


def forest(items: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets; each pair of different trees is tried.

    A member is tried against whole trees at once: its elements are looked up in one index of the
    group, which gives its intersections with all members by a single count.
    """
    m = len(sets)
    root = np.arange(m)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(items[0]), int(items[1]))] if den * k >= num * (sizes.sum() - k) else []
    member = np.repeat(np.arange(m), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, member = flat[order], member[order]
    out = []
    for i in range(m):
        if (root == root[i]).all():
            continue
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        lengths = hi - lo
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(lo, lengths)
        inter = np.bincount(member[at], minlength=m)
        linked = den * inter >= num * (sizes + sizes[i] - inter)
        for j in np.flatnonzero(linked):
            if root[j] != root[i]:
                out.append((int(items[i]), int(items[j])))
                root[root == root[j]] = root[i]
    return out


def _links(num: int, den: int):
    def run(batches):
        a, b = [], []
        for t in _groups(batches, None):
            elems = t.column(2)
            for x, y in forest(t.column(1).to_numpy(), [e.values.to_numpy() for e in elems], num, den):
                a.append(x)
                b.append(y)
            if len(a) > 20_000:
                yield _out((a, b), ["a", "b"], [pa.int64(), pa.int64()])
                a, b = [], []
        if a:
            yield _out((a, b), ["a", "b"], [pa.int64(), pa.int64()])

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, trees: int = 16, leaf_items: int = 2048, leaf_weight: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.keep(texts.mapInArrow(_sketch, "id long, n long, h1 long, h2 long, sig array<int>"), "sketches")

    key = ["h1", "h2", "n"]
    # Of rows that share an id, the set with the smallest hash stands for the document.
    one = sketch.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*key)).alias("k")).select("id", "k.*")
    known = scratch.keep(one, "documents")
    reps = known.groupBy(*key).agg(F.min("id").alias("item"))
    copies = known.join(reps, key).where("id != item").select(F.col("id").alias("a"), F.col("item").alias("b"))

    def root(tree):
        i, j = (7 * tree) % N_SIG, (7 * tree + 3) % N_SIG
        return F.xxhash64(F.lit(tree), F.element_at("sig", i + 1), F.element_at("sig", j + 1))

    roots = sketch.select(*key, "id", F.array(*(root(t) for t in range(trees))).alias("roots"))
    roots = roots.join(reps.withColumnRenamed("item", "id"), [*key, "id"], "left_semi").dropDuplicates(["id"])
    nodes = roots.select(F.explode("roots").alias("leaf"), F.col("id").alias("item"), F.col("n").alias("weight"))
    sigs = sketch.select(F.col("id").alias("item"), "n", "h1", "h2", "sig")

    def mine(items: DataFrame) -> DataFrame:
        """One signature row for each item; most others are left out before the shuffle."""
        return thinned(sigs, items).join(items, "item", "left_semi").join(reps, ["h1", "h2", "n", "item"], "left_semi").dropDuplicates(["item"])

    leaves = refine(nodes, lambda items: mine(items).select("item", "sig"), scratch, leaf_items, leaf_weight, percent / 100, N_SIG)
    # Equality of 128 values: mean 108.8 and deviation 4.04 at 0.85; the cut is 5.4 deviations lower.
    q = percent / 100
    cut = int(N_SIG * q - 5.4 * (N_SIG * q * (1 - q)) ** 0.5)
    # Signatures of the members of leaves, thinned before the shuffle and cut to a byte a value.
    low = mine(leaves.select("item").distinct()).select("item", "n", "h1", "h2", "sig").mapInArrow(_low_bytes, "item long, n long, sig binary")
    rows = leaves.select("leaf", "item").join(low, "item").select("leaf", "item", "n", "sig")
    near = rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_promising(cut, percent, 100), "leaf long, item long")
    near = scratch.keep(near.distinct(), "promising")
    wanted = near.select(F.col("item").alias("id")).distinct()
    sets = thinned(texts, wanted, then=_sets, schema="item long, elems array<long>")
    full = near.join(sets, "item").select("leaf", "item", "elems")
    links = full.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_links(percent, 100), "a long, b long")
    links = scratch.keep(links.distinct(), "links")

    classes = components(links.unionByName(copies), scratch)
    out = sketch.select("id", F.col("n").alias("n_shingles")).join(classes.select(F.col("node").alias("id"), F.col("root")), "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.u = e2.a),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id
"""
