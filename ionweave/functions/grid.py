"""Images, neighbours and polygons on the pixel grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PIXEL, RoiDef

ROOK = ((-1, 0), (0, -1), (0, 1), (1, 0))
QUEEN = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def neighbours(pixels: DataFrame, offsets=QUEEN) -> DataFrame:
    """(dataset_id, pixel_id, neighbour_id) over populated pixels, in both directions."""
    p = pixels.select(*PIXEL, "gx", "gy")
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    out = p.withColumn("s", F.explode(steps)).select(*PIXEL, (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"))
    return out.join(p.withColumnRenamed("pixel_id", "neighbour_id"), ["dataset_id", "gx", "gy"]).select(*PIXEL, "neighbour_id")


def image(pixels: DataFrame, values: DataFrame, grid_shape: tuple[int, int], fill: float = 0.0) -> DataFrame:
    """(dataset_id, gy, gx, value) for every place of the grid; ``fill`` where no pixel is.

    ``values``: (dataset_id, pixel_id, value)."""
    h, w = grid_shape
    every = pixels.select("dataset_id").distinct().select("dataset_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(h * w - 1).cast("bigint"))).alias("grid_idx"))
    placed = pixels.select(*PIXEL, "grid_idx").join(values.select(*PIXEL, "value"), PIXEL).select("dataset_id", "grid_idx", "value")
    got = every.join(placed, ["dataset_id", "grid_idx"], "left")
    return got.select("dataset_id", F.floor(F.col("grid_idx") / w).cast("int").alias("gy"), (F.col("grid_idx") % w).cast("int").alias("gx"), F.coalesce("value", F.lit(fill)).alias("value"))


def inside(roi: RoiDef, y: Column, x: Column) -> Column:
    """Even-odd test of a point against a polygon; left and top edges count as inside."""
    odd = F.lit(False)
    v = roi.vertices
    for (y1, x1), (y2, x2) in zip(v, (*v[1:], v[0]), strict=True):
        if y1 == y2:
            continue
        crosses = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = F.lit(float(x1)) + (y - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1))
        odd = odd != (crosses & (x < at))
    return odd


def in_any(rois: list[RoiDef], y: Column, x: Column) -> Column:
    out = F.lit(False)
    for r in rois:
        out = out | inside(r, y, x)
    return out


def roi_pixels(pixels: DataFrame, *rois: RoiDef) -> DataFrame:
    """The pixels inside any of the regions."""
    return pixels.where(in_any(list(rois), F.col("gy").cast("double"), F.col("gx").cast("double")))
