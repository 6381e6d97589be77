"""Bootstrap replicates of the tolerance curve, without a row for a pair and replicate.

How often a pixel counts in each of ``REPS`` replicates is one vector of bytes, drawn for all pixels of a
dataset at once. What a replicate's curve needs of the pairs is the upper tail of each bin of anchors: as
many of the largest errors as lie above its quantile. An anchor's errors, sorted once for all replicates
of a vector, are cut where every replicate has the tail of its bin (a bin's tail is within the tails of
its anchors, so nothing is lost), and the curves are made of what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import keyed
from ..model import DATASET, PIXEL, hold

#: Replicates of one vector.
REPS = 50
POINTS = 200
#: Bins of anchors: at most and at least, and the pairs that one should have.
MOST, LEAST, PAIRS = 30, 8, 5


def of_pixels(n: int, rep: int, seed: int) -> np.ndarray:
    """How often each of n pixels is drawn in n draws."""
    return np.bincount(keyed(np.arange(n), rep, seed) % n, minlength=n)


def of_blocks(block: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """How often each pixel counts if blocks are drawn until there are enough pixels; of the last block
    its first pixels are taken. ``block``: the block of each pixel, by ascending pixel number."""
    n = len(block)
    _, place, sizes = np.unique(block, return_inverse=True, return_counts=True)
    drawn = keyed(np.arange(-(-n // sizes.min())), rep, seed) % len(sizes)
    upto = np.cumsum(sizes[drawn])
    last = int(np.searchsorted(upto, n))
    m = np.bincount(drawn[:last], minlength=len(sizes))[place]
    room = n - (int(upto[last]) - int(sizes[drawn[last]]))
    m[np.flatnonzero(place == drawn[last])[:room]] += 1
    return m


def multiplicities(pixels: DataFrame, n_reps: int, seed: int, block: int | None, width: int) -> DataFrame:
    """(dataset_id, pixel_id, rb, m): how often a pixel counts in the replicates from ``rb`` on, a byte each.

    With ``block``, square blocks of about so many pixels are drawn, else pixels."""
    side = max(1, round(block**0.5)) if block else 1
    at = F.floor(F.col("gy") / side) * (width // side + 1) + F.floor(F.col("gx") / side)
    rows = pixels.select(*PIXEL, at.cast("bigint").alias("block"), F.explode(F.array(*(F.lit(k) for k in range(0, n_reps, REPS)))).alias("rb"))
    schema = pa.schema([("dataset_id", pa.string()), ("pixel_id", pa.int64()), ("rb", pa.int32()), ("m", pa.binary())])

    def run(key, t):
        name, first = (k.as_py() for k in key)
        t = t.sort_by("pixel_id")
        ids, blocks = t.column("pixel_id").to_numpy(), t.column("block").to_numpy()
        reps = range(first, min(first + REPS, n_reps))
        m = np.stack([of_blocks(blocks, r, seed) if block else of_pixels(len(ids), r, seed) for r in reps], axis=1)
        if m.max() > 255:
            raise ValueError("a pixel counts over 255 times in a replicate")
        m = np.ascontiguousarray(m.astype(np.uint8))
        return pa.table([pa.array([name] * len(ids)), pa.array(ids), pa.array(np.full(len(ids), first, np.int32)), pa.array([row.tobytes() for row in m], pa.binary())], schema=schema)

    return rows.groupBy("dataset_id", "rb").applyInArrow(run, "dataset_id string, pixel_id bigint, rb int, m binary")


def edges_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distinct quantile edges of ascending anchors ``x`` that count ``w`` times."""
    upto = np.cumsum(w)
    n = int(upto[-1])
    bins = max(LEAST, min(MOST, n // PAIRS))
    pos = np.arange(bins + 1) / bins * (n - 1)
    lo = np.floor(pos)
    a, b = (x[np.searchsorted(upto, k, "right")] for k in (lo, np.minimum(lo + 1, n - 1)))
    return np.unique(a + (b - a) * (pos - lo))


def bins_of(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bin of each anchor from 0), for one replicate."""
    edges = edges_of(x, w)
    return edges, np.maximum(np.minimum(np.searchsorted(edges, x, "right"), len(edges) - 1) - 1, 0)


def rank(w, q: float):
    """Where a quantile lies among ``w`` values, from 0."""
    return np.maximum(w - 1, 0) * q


def isotonic(y: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit of a few values."""
    n, s = len(y), np.concatenate([[0.0], np.cumsum(y)])
    mean = (s[None, 1:] - s[:-1, None]) / np.maximum(np.arange(1, n + 1)[None, :] - np.arange(n)[:, None], 1)
    least = np.where(np.arange(n)[None, :] >= np.arange(n)[:, None], mean, np.inf)
    least = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1]  # [a, i]: the least mean from a to any b of at least i
    return np.array([least[: i + 1, i].max() for i in range(n)])


def replicate_curve(x: np.ndarray, w: np.ndarray, at: np.ndarray, y: np.ndarray, m: np.ndarray, q: float, grid: np.ndarray) -> np.ndarray | None:
    """One replicate's curve on ``grid``. ``x``, ``w``: anchors, ascending; ``at``, ``y``, ``m``: anchor, error and count
    of the pairs in the tails, by descending error."""
    if w.sum() == 0:
        return None
    edges, of = bins_of(x, w)
    k = max(len(edges) - 1, 1)
    total = np.bincount(of, w, k).astype(np.int64)
    counted = m > 0
    b, y, m = of[at[counted]], y[counted], m[counted]
    by = np.argsort(b, kind="stable")
    b, y, upto = b[by], y[by], np.cumsum(m[by], dtype=np.int64)
    start = np.searchsorted(b, np.arange(k))
    before = np.where(start > 0, upto[np.maximum(start - 1, 0)] if len(upto) else 0, 0)
    pos = rank(total, q)
    lo = np.floor(pos).astype(np.int64)
    pick = lambda r: y[np.minimum(np.searchsorted(upto, before + total - 1 - r, "right"), len(y) - 1)]
    low, high = pick(lo), pick(np.minimum(lo + 1, np.maximum(total - 1, 0)))
    values = low + (high - low) * (pos - lo)
    last, filled = 0.0, np.zeros(k)
    for i in range(k):
        last = values[i] if total[i] else last
        filled[i] = last
    fit = isotonic(filled)
    return np.interp(grid, (edges[:-1] + edges[1:]) / 2, fit) if len(edges) > 1 else np.full(len(grid), fit[0])


def _vectors(column: pa.ChunkedArray, dtype, reps: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, reps)


def curves(pairs: DataFrame, grid: DataFrame, m: DataFrame, n_reps: int, alpha: float) -> DataFrame:
    """(dataset_id, rep, ppm): each replicate's curve at 200 points, as an array.

    ``pairs``: (dataset_id, pixel_id, ref_id, x, y); ``grid``: (dataset_id, lo, hi); ``m``: of :func:`multiplicities`."""
    q = 1 - alpha / 2
    anchors = pairs.select("dataset_id", "ref_id", "x").distinct().join(grid, DATASET)
    of_pixel = pairs.groupBy(*PIXEL).agg(F.collect_list(F.struct("ref_id", "y")).alias("p"))  # as many as there are anchors
    drawn = hold(of_pixel.join(m, PIXEL).select("dataset_id", "rb", F.col("p.ref_id").alias("ref_id"), F.col("p.y").alias("y"), "m"))
    size = lambda first: min(first + REPS, n_reps) - first

    def weigh(batches):
        """How often each anchor counts in this task's pixels."""
        sums: dict[tuple, np.ndarray] = {}
        for t in batches:
            for name, rb, refs, v in zip(*(t.column(c).to_pylist() for c in ("dataset_id", "rb", "ref_id", "m")), strict=True):
                v = np.frombuffer(v, np.uint8)
                for r in refs:
                    if (name, rb, r) not in sums:
                        sums[name, rb, r] = np.zeros(len(v), np.int64)
                    sums[name, rb, r] += v
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["dataset_id", "rb", "ref_id", "w"])

    partial = drawn.mapInArrow(weigh, "dataset_id string, rb int, ref_id int, w binary").join(anchors, ["dataset_id", "ref_id"]).select("dataset_id", "rb", "ref_id", "x", "lo", "hi", "w")
    summed = pa.schema([("dataset_id", pa.string()), ("rb", pa.int32()), ("ref_id", pa.int32()), ("x", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64()), ("w", pa.binary()), ("need", pa.binary())])

    def place(key, t):
        """The anchors of a dataset with their counts in all replicates, and the tail that their bins need."""
        name, first = (k.as_py() for k in key)
        refs = {}
        for r, x, lo, hi, w in zip(*(t.column(c).to_pylist() for c in ("ref_id", "x", "lo", "hi", "w")), strict=True):
            at = refs.setdefault((x, r), [lo, hi, np.zeros(size(first), np.int64)])
            at[2] += np.frombuffer(w, np.int64)
        keys = sorted(refs)
        x, w = np.array([k[0] for k in keys]), np.stack([refs[k][2] for k in keys])
        need = np.zeros_like(w)
        for r in range(w.shape[1]):
            if w[:, r].any():
                _, of = bins_of(x, w[:, r])
                total = np.bincount(of, w[:, r]).astype(np.int64)
                need[:, r] = (total - np.floor(rank(total, q)).astype(np.int64))[of]
        n = len(keys)
        cols = [[name] * n, [first] * n, [k[1] for k in keys], [k[0] for k in keys], [refs[k][0] for k in keys], [refs[k][1] for k in keys], [v.tobytes() for v in w], [v.tobytes() for v in need]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, summed, strict=True)], schema=summed)

    placed = hold(partial.groupBy("dataset_id", "rb").applyInArrow(place, "dataset_id string, rb int, ref_id int, x double, lo double, hi double, w binary, need binary"))
    tail = pa.schema([("dataset_id", pa.string()), ("rb", pa.int32()), ("ref_id", pa.int32()), ("y", pa.float64()), ("m", pa.binary())])

    def cut(key, t, anchor):
        """An anchor's largest errors, as far down as any replicate needs them."""
        name, first, ref = (k.as_py() for k in key)
        if not t.num_rows or not anchor.num_rows:
            return tail.empty_table()
        y, m = t.column("y").to_numpy(), _vectors(t.column("m"), np.uint8, size(first))
        need = np.frombuffer(anchor.column("need")[0].as_py(), np.int64)
        by = np.argsort(-y, kind="stable")
        stop = min(len(by), 2 * int(need.max()) + 64)
        while True:
            upto = np.cumsum(m[by[:stop]], axis=0, dtype=np.int64)
            if stop == len(by) or (upto[-1] >= need).all():
                break
            stop = min(len(by), 2 * stop)
        rows = by[: min(stop, int((upto < need).sum(axis=0).max()) + 1)]
        n = len(rows)
        return pa.table([pa.array([name] * n, pa.string()), pa.array([first] * n, pa.int32()), pa.array([ref] * n, pa.int32()), pa.array(y[rows]), pa.array([m[k].tobytes() for k in rows], pa.binary())], schema=tail)

    each = drawn.select("dataset_id", "rb", F.explode(F.arrays_zip("ref_id", "y")).alias("p"), "m").select("dataset_id", "rb", "p.ref_id", "p.y", "m")
    by_ref = ["dataset_id", "rb", "ref_id"]
    tails = each.groupBy(*by_ref).cogroup(placed.groupBy(*by_ref)).applyInArrow(cut, "dataset_id string, rb int, ref_id int, y double, m binary")
    found = pa.schema([("dataset_id", pa.string()), ("rep", pa.int32()), ("ppm", pa.list_(pa.float64()))])

    def fit(key, t, anchor):
        name, first = (k.as_py() for k in key)
        if not anchor.num_rows:
            return found.empty_table()
        anchor = anchor.sort_by([("x", "ascending"), ("ref_id", "ascending")])
        x, refs, w = anchor.column("x").to_numpy(), anchor.column("ref_id").to_numpy(), _vectors(anchor.column("w"), np.int64, size(first))
        grid_at = anchor.column("lo")[0].as_py() + np.arange(POINTS) * (anchor.column("hi")[0].as_py() - anchor.column("lo")[0].as_py()) / (POINTS - 1)
        y = t.column("y").to_numpy()
        by = np.argsort(-y, kind="stable")
        place_of = np.zeros(int(refs.max()) + 1, np.int64)
        place_of[refs] = np.arange(len(refs))
        at, y, m = place_of[t.column("ref_id").to_numpy()[by]], y[by], _vectors(t.column("m"), np.uint8, size(first))[by]
        made = [(first + r, c) for r in range(size(first)) if (c := replicate_curve(x, w[:, r], at, y, m[:, r], q, grid_at)) is not None]
        return pa.table([pa.array([name] * len(made), pa.string()), pa.array([r for r, _ in made], pa.int32()), pa.array([c.tolist() for _, c in made], pa.list_(pa.float64()))], schema=found)

    return tails.groupBy("dataset_id", "rb").cogroup(placed.groupBy("dataset_id", "rb")).applyInArrow(fit, "dataset_id string, rep int, ppm array<double>")


def band(pairs: DataFrame, grid: DataFrame, pixels: DataFrame, n_reps: int, alpha: float, seed: int, block: int | None, width: int) -> DataFrame:
    """(dataset_id, i, ci_low, ci_high): the middle 95 % of the replicates at each point."""
    m = multiplicities(pixels.join(grid.select("dataset_id"), DATASET, "left_semi"), n_reps, seed, block, width)
    points = curves(pairs, grid, m, n_reps, alpha).select("dataset_id", F.posexplode("ppm").alias("i", "ppm"))
    return points.groupBy("dataset_id", "i").agg(F.percentile("ppm", F.lit(0.025)).alias("ci_low"), F.percentile("ppm", F.lit(0.975)).alias("ci_high"))
