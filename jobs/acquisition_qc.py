"""Quality report of acquisitions: one graded row a pixel, and the reference ions of each dataset.

What an operator asks before the pixels of a run are pooled with others: how much signal a pixel has and
how much of it is over its noise, how far its m/z drift from the dataset's own reference ions, and
whether it is a hot pixel. Written to ``OUTPUT/pixels`` and ``OUTPUT/ions``, partitioned by dataset.

A pixel is ``bad`` if it is hot or shows no reference ion, ``warn`` if its median drift is beyond
``max_drift_ppm`` or fewer than ``min_share_kept`` of its peaks are over the noise, else ``ok``.

A rerun over the same input replaces the same partitions with the same rows; a run over some datasets
leaves those of others. Datasets whose rows are gone from the input keep what was written for them. A
dataset without reference ions has no partition of ``ions``; its old one, if there was one, is told
apart by ``run_pixels``, the number of pixels it was made of, which ``read_ions`` compares.

    python -m jobs.acquisition_qc INPUT OUTPUT [--config FILE]
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ionweave.model import DATASET, PIXEL, held_until_end, hold
from ionweave.operators.hot_pixel import hot_pixels
from ionweave.operators.pick import SnrParams, with_threshold
from ionweave.operators.reference_ions import ReferenceIonParams, reference_ions

from .common import command_line, config_of, new_folder, peaks_of, write_by_dataset

log = logging.getLogger("jobs.acquisition_qc")
PIXELS = "dataset_id string, pixel_id bigint, n_peaks bigint, tic double, base_peak double, threshold double, n_kept bigint, n_refs bigint, drift_ppm double, hot boolean, grade string"
IONS = "dataset_id string, ref_id int, mz double, prevalence double, n_obs bigint, run_pixels bigint"


def pixel_report(peaks: DataFrame, refs_seen: DataFrame, config: dict) -> DataFrame:
    """One row a pixel: signal, noise, drift, and its grade."""
    noise = with_threshold(peaks, SnrParams(snr_mad=config["snr_mad"]))
    # The windows and this aggregate are by pixel: one shuffle for both.
    pixels = noise.groupBy(*PIXEL).agg(F.count("*").alias("n_peaks"), F.sum("intensity").alias("tic"), F.max("intensity").alias("base_peak"), F.first("threshold").alias("threshold"), F.count_if(F.col("intensity") > F.col("threshold")).alias("n_kept"))
    pixels = hold(pixels)
    hot = hot_pixels(pixels.select(*PIXEL, "tic"), config["hot_k_mad"]).select(*PIXEL, F.lit(True).alias("hot"))
    drift = refs_seen.groupBy(*PIXEL).agg(F.count("*").alias("n_refs"), F.median("ppm_error").alias("drift_ppm"))
    out = pixels.join(drift, PIXEL, "left").join(hot, PIXEL, "left").withColumns({"n_refs": F.coalesce("n_refs", F.lit(0)), "hot": F.coalesce("hot", F.lit(False))})
    bad = F.col("hot") | (F.col("n_refs") == 0)
    warn = (F.abs("drift_ppm") > config["max_drift_ppm"]) | (F.col("n_kept") < config["min_share_kept"] * F.col("n_peaks"))
    return out.withColumn("grade", F.when(bad, "bad").when(warn, "warn").otherwise("ok"))


def run(spark: SparkSession, input_path: str, output_path: str, config: dict) -> dict[str, int]:
    """Read peaks, write both tables; returns how many rows were read, and how many of them are peaks."""
    with held_until_end(spark):
        return _run(spark, input_path, output_path, config)


def _run(spark: SparkSession, input_path: str, output_path: str, config: dict) -> dict[str, int]:
    rows, valid = Observation("input"), Observation("peaks")
    reader = spark.read.format(config["format"])
    source = (reader.schema(config["schema"]) if "schema" in config else reader).load(input_path).observe(rows, F.count(F.lit(1)).alias("n"))
    peaks = hold(peaks_of(source, config["columns"]).observe(valid, F.count(F.lit(1)).alias("n")))
    read = {"rows": rows.get["n"], "peaks": valid.get["n"]}
    log.info("read %d rows of %s, %d of them peaks", read["rows"], input_path, read["peaks"])
    n_pixels = hold(peaks.select(*PIXEL).distinct().groupBy(*DATASET).agg(F.count("*").alias("n_pixels")))
    ions, seen = reference_ions(peaks, n_pixels, ReferenceIonParams(**config["reference"]))
    ions = ions.join(n_pixels.withColumnRenamed("n_pixels", "run_pixels"), DATASET)
    for name, table in (("pixels", pixel_report(peaks, hold(seen), config)), ("ions", ions)):
        table = hold(table)
        write_by_dataset(table, f"{output_path}/{name}")
        log.info("wrote %d rows to %s/%s", table.count(), output_path, name)
    return read


def read_pixels(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.schema(PIXELS).parquet(f"{output_path}/pixels")


def read_ions(spark: SparkSession, output_path: str) -> DataFrame:
    n = read_pixels(spark, output_path).groupBy(*DATASET).agg(F.count("*").alias("run_pixels"))
    return spark.read.schema(IONS).parquet(f"{output_path}/ions").join(n, ["dataset_id", "run_pixels"], "left_semi")


def job1_acquisition_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the line items as peaks, run twice into one folder."""
    out, config = new_folder(spark, "job1-acquisition-qc"), config_of(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/lineitem.parquet", out, config)
    digits = {"tic": 2, "base_peak": 2, "threshold": 3, "drift_ppm": 4}
    return read_pixels(spark, out).withColumns({c: F.round(c, n) for c, n in digits.items()})


#: The peaks that the job's own config makes of the line items.
PEAKS_SQL = """peaks AS (SELECT l_returnflag AS dataset_id, l_orderkey % 256 AS pixel_id, l_partkey * 8 + l_linenumber AS peak_idx,
  (210 + 10 * (l_partkey % 50)) * (1 + ((l_orderkey % 21) - 10) * CAST(1e-6 AS DOUBLE)) AS mz, l_extendedprice AS intensity FROM lineitem),
np AS (SELECT dataset_id, count(DISTINCT pixel_id) AS n_pixels FROM peaks GROUP BY dataset_id),
best AS (SELECT * FROM (SELECT *, CAST(floor(ln(mz) / ln(CAST(1 AS DOUBLE) + 50.0 * CAST(1e-6 AS DOUBLE))) AS BIGINT) AS bin FROM peaks)
  QUALIFY row_number() OVER (PARTITION BY dataset_id, pixel_id, bin ORDER BY intensity DESC, peak_idx, mz) = 1),
bins AS (SELECT dataset_id, bin, bin - row_number() OVER (PARTITION BY dataset_id ORDER BY bin) AS grp
  FROM (SELECT dataset_id, bin, count(*) AS n FROM best GROUP BY dataset_id, bin) JOIN np USING (dataset_id) WHERE n / n_pixels >= 0.5 AND n >= 5),
obs AS (SELECT dataset_id, pixel_id, grp, coalesce(sum(mz * intensity) / nullif(sum(intensity), 0), avg(mz)) AS mz, sum(intensity) AS intensity FROM best JOIN bins USING (dataset_id, bin) GROUP BY ALL),
ions AS (SELECT dataset_id, grp, sum(mz * intensity) FILTER (intensity > 0) / sum(intensity) FILTER (intensity > 0) AS mz, count(*) FILTER (intensity > 0) AS n_obs FROM obs GROUP BY dataset_id, grp)"""

SQL = f"""WITH {PEAKS_SQL},
drift AS (SELECT o.dataset_id, o.pixel_id, count(*) AS n_refs, median((o.mz - i.mz) / i.mz * 1e6) AS drift_ppm FROM obs o JOIN ions i USING (dataset_id, grp) WHERE o.intensity > 0 GROUP BY o.dataset_id, o.pixel_id),
m AS (SELECT dataset_id, pixel_id, count(*) AS n_peaks, sum(intensity) AS tic, max(intensity) AS base_peak, median(intensity) AS m FROM peaks GROUP BY dataset_id, pixel_id),
t AS (SELECT dataset_id, pixel_id, greatest(3.0 * 1.4826 * median(abs(intensity - m)), 0) AS threshold FROM peaks JOIN m USING (dataset_id, pixel_id) GROUP BY dataset_id, pixel_id),
k AS (SELECT dataset_id, pixel_id, count(*) FILTER (intensity > threshold) AS n_kept FROM peaks JOIN t USING (dataset_id, pixel_id) GROUP BY dataset_id, pixel_id),
tm AS (SELECT dataset_id, median(tic) AS tm FROM m GROUP BY dataset_id),
lim AS (SELECT dataset_id, tm + 3.0 * 1.4826 * median(abs(tic - tm)) AS hot_at FROM m JOIN tm USING (dataset_id) GROUP BY dataset_id, tm),
a AS (SELECT m.*, threshold, n_kept, coalesce(n_refs, 0) AS n_refs, drift_ppm, tic > hot_at AS hot FROM m JOIN t USING (dataset_id, pixel_id) JOIN k USING (dataset_id, pixel_id) JOIN lim USING (dataset_id) LEFT JOIN drift USING (dataset_id, pixel_id))
SELECT dataset_id, pixel_id, n_peaks, round(tic, 2) AS tic, round(base_peak, 2) AS base_peak, round(threshold, 3) AS threshold, n_kept, n_refs, round(drift_ppm, 4) AS drift_ppm, hot,
  CASE WHEN hot OR n_refs = 0 THEN 'bad' WHEN abs(drift_ppm) > 2.0 OR n_kept < 0.2 * n_peaks THEN 'warn' ELSE 'ok' END AS grade FROM a"""


if __name__ == "__main__":
    sys.exit(command_line(__doc__, __file__, run))
