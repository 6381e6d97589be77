"""The catalogue's wiring, and some queries against DuckDB on the smallest tables."""

import os

import pytest

from ionweave import catalog

DATA = "/root/testdata/sf0.001"
SOME = ["proj_rms", "roi_spectrum_matrix_median", "ref_ions", "norm_median", "pick_snr", "consensus_dbscan_axis", "morans_i_queen", "hot_pixels_neighbors_pm", "bg_reject", "hist_factor", "hist_factor_sqrt", "hist_peak_counts", "plotted_mz", "cdf_prevalence"]


def test_every_statement_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (df[cols].sort_values(cols).reset_index(drop=True) for df in (want, got))
    for c in cols:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all()
        else:
            assert a[c].astype(float).to_numpy() == pytest.approx(b[c].astype(float).to_numpy(), nan_ok=True)


@pytest.mark.parametrize("name", ["consensus_dbscan_axis", "consensus_dbscan_cells"])
def test_cluster_without_intensity(spark, tmp_path, name):
    """Such a cluster has no centroid in the SQL, and its channel is the last."""
    import duckdb

    values = [0.0] * 5 + [7.0] * 4 + [9.5] * 4
    spark.createDataFrame([(k, k % 3, v) for k, v in enumerate(values)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # its two windows order tied m/z on their own, and with several threads not alike
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(repr, df.astype(float).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_draws_are_enough_to_keep_channels(spark, tmp_path):
    """With 9 draws no p was below a tenth, so that no input had a channel with q < 0.05."""
    import duckdb

    # Channels seen in 200, 190, 180, 160 and 100 of 200 pixels; chance fills 173, 170, 167, 160 and 126.
    rows = [(v, [1.0 if v < k else -1.0 for k in (200, 190, 180, 160, 100)]) for v in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()["fdr_prevalence"]).df()
    got = catalog.queries()["fdr_prevalence"](spark, str(tmp_path)).toPandas()[list(want.columns)]
    exact = catalog.queries()["fdr_prevalence_exact"](spark, str(tmp_path)).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert dict(zip(got.channel, got.kept, strict=True)) == dict(zip(exact.channel, exact.kept, strict=True)) == {0: True, 1: True, 2: True, 3: False, 4: False}
    assert got.sort_values("channel").p.tolist() == pytest.approx(exact.sort_values("channel").p.tolist(), abs=0.1) and got.p.between(0.3, 0.7).any()
