"""DuckDB SQL of the catalogue, built from shared common table expressions."""

from __future__ import annotations

PEAKS = """peaks AS (SELECT l_orderkey % 256 AS pixel_id, l_partkey * 8 + l_linenumber AS peak_idx,
  (200 + 10 * p_size) * (1 + ((l_orderkey % 21) - 10) * CAST(1e-6 AS DOUBLE)) AS mz, l_extendedprice AS intensity, l_returnflag AS ds
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PIXELS = "pixels AS (SELECT range AS pixel_id, CAST(range % 16 AS INTEGER) AS gx, CAST(range // 16 AS INTEGER) AS gy FROM range(256))"
CELLS = """cells AS (SELECT vec_id AS pixel_id, CAST(c AS INTEGER) AS channel, CAST(embedding[c + 1] AS DOUBLE) AS intensity
  FROM embeddings, range(64) t(c) WHERE embedding[c + 1] > 0),
pixels AS (SELECT vec_id AS pixel_id, CAST(vec_id % 25 AS INTEGER) AS gx, CAST(vec_id // 25 AS INTEGER) AS gy FROM embeddings),
np AS (SELECT count(*) AS n FROM pixels),
channels AS (SELECT channel, 100.0::DOUBLE + channel AS mz, count(*) / (SELECT n FROM np) AS prevalence, count(*) * 2 AS n_peaks FROM cells GROUP BY channel)"""
FG = "gx < 7.5 AND gy < 7.5"
BG = "gx >= 10 AND gx < 15.5 AND gy >= 10 AND gy < 15.5"


def step(ppm: float) -> str:
    return f"ln(CAST(1 AS DOUBLE) + {ppm} * CAST(1e-6 AS DOUBLE))"


def md5i(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def refs(min_prev: float, merge: bool = True, head: str = PEAKS, ds: str = "") -> str:
    """CTEs to ``ref_ions`` and ``ref_obs``; with ``ds``, a column of the peaks, for each of its values."""
    # log1p and ln(1 + x) differ in the last digits; bins are compared on jittered m/z off the edges.
    k = f"{ds}, " if ds else ""
    by = f"PARTITION BY {ds} " if ds else ""
    grp = f"bin - row_number() OVER ({by}ORDER BY bin)" if merge else "bin"
    return f"""{head},
best AS (SELECT pixel_id, {k}bin, mz, intensity FROM (SELECT *, CAST(floor(ln(mz) / {step(50.0)}) AS BIGINT) AS bin FROM peaks)
  QUALIFY row_number() OVER (PARTITION BY pixel_id, bin ORDER BY intensity DESC, peak_idx, mz) = 1),
bins AS (SELECT {k}bin, {grp} AS grp FROM (SELECT {k}bin, count(*) AS n FROM best GROUP BY {k}bin HAVING count(*) / 256 >= {min_prev} AND count(*) >= 5)),
obs AS (SELECT pixel_id, {k}grp, coalesce(sum(mz * intensity) / nullif(sum(intensity), 0), avg(mz)) AS mz, sum(intensity) AS intensity FROM best JOIN bins USING ({k}bin) GROUP BY pixel_id, {k}grp),
r0 AS (SELECT {k}grp, coalesce(sum(mz * intensity) FILTER (intensity > 0) / nullif(sum(intensity) FILTER (intensity > 0), 0), avg(mz)) AS mz, count(*) FILTER (intensity > 0) AS n_obs FROM obs GROUP BY {k}grp),
ref_ions AS (SELECT {k}CAST(row_number() OVER ({by}ORDER BY mz, grp) - 1 AS INTEGER) AS ref_id, grp, mz, n_obs / 256 AS prevalence, n_obs FROM r0),
ref_obs AS (SELECT pixel_id, {k}ref_id, o.mz, o.intensity, (o.mz - r.mz) / r.mz * 1e6 AS ppm_error, r.mz AS ref, r.prevalence FROM obs o JOIN ref_ions r USING ({k}grp) WHERE o.intensity > 0)"""


def curve(pairs: str, keys: str = "", s: str = "", own_grid: bool = False) -> str:
    """CTEs (their names ending in ``s``) from ``pairs`` (keys, x, y) to ``pts``: the isotonic quantile curve
    at the 200 points of ``g``, the grid over all pairs, which is made with the keyless curve, or with ``own_grid`` over those of each key."""
    k = f"{keys}, " if keys else ""
    by = f"PARTITION BY {keys}" if keys else ""
    own = lambda t: f"{t}.{keys}, " if keys else ""
    same = lambda t, u: f"AND {t}.{keys} = {u}.{keys}" if keys else ""
    qs = "[" + ", ".join(f"(CAST({j} AS DOUBLE) / 30)" for j in range(31)) + "]"
    grid = f"g AS (SELECT {k}CAST(r.range AS INTEGER) AS gi, lo + r.range * (hi - lo) / 199 AS mz_grid FROM range(200) r, (SELECT {k}min(x) AS lo, max(x) AS hi FROM {pairs} GROUP BY {keys})),\n" if own_grid else "" if keys else """g AS (SELECT CAST(range AS INTEGER) AS gi, lo + range * (hi - lo) / 199 AS mz_grid FROM range(200), (SELECT min(x) AS lo, max(x) AS hi FROM pairs)),
"""
    return f"""eg{s} AS (SELECT {k}list_sort(list_distinct(quantile_cont(x, {qs}))) AS e FROM {pairs} {f'GROUP BY {keys}' if keys else ''}),
el{s} AS (SELECT {k}i, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS last FROM (SELECT *, unnest(range(1, len(e))) AS i FROM eg{s})),
qq{s} AS (SELECT {own('e')}e.i, any_value((e.lo + e.hi) / 2) AS c, quantile_cont(p.y, 0.995) AS q FROM el{s} e LEFT JOIN {pairs} p ON p.x >= e.lo AND (p.x < e.hi OR e.last AND p.x <= e.hi) {same('p', 'e')} GROUP BY {own('e')}e.i),
qf{s} AS (SELECT {k}i, c, coalesce(last_value(q IGNORE NULLS) OVER ({by} ORDER BY i), 0) AS q FROM qq{s}),
mm{s} AS (SELECT {own('a')}a.i AS a, b.i AS b, avg(m.q) AS mean FROM qf{s} a JOIN qf{s} b ON a.i <= b.i {same('a', 'b')} JOIN qf{s} m ON m.i BETWEEN a.i AND b.i {same('m', 'a')} GROUP BY {own('a')}a.i, b.i),
mi{s} AS (SELECT {own('f')}f.i, v.a, min(v.mean) AS m FROM qf{s} f JOIN mm{s} v ON v.a <= f.i AND v.b >= f.i {same('v', 'f')} GROUP BY {own('f')}f.i, v.a),
fit{s} AS (SELECT {k}i, c, iso FROM qf{s} JOIN (SELECT {k}i, max(m) AS iso FROM mi{s} GROUP BY {k}i) USING ({k}i)),
fl{s} AS (SELECT *, lead(c) OVER ({by} ORDER BY i) AS c2, lead(iso) OVER ({by} ORDER BY i) AS iso2, row_number() OVER ({by} ORDER BY i) = 1 AS is_first FROM fit{s}),
{grid}pts{s} AS (SELECT {k}gi, mz_grid, CASE WHEN is_first AND mz_grid <= c THEN iso WHEN c2 IS NULL THEN iso ELSE iso + (mz_grid - c) * (iso2 - iso) / (c2 - c) END AS ppm
  FROM g JOIN fl{s} {'USING (' + keys + ') WHERE' if own_grid else 'ON'} (is_first AND mz_grid <= c) OR (mz_grid > c AND (c2 IS NULL OR mz_grid <= c2)))"""


def density(src: str = "peaks", bw: str = "50e-6::DOUBLE", n: int = 32768) -> str:
    return f"""sp AS (SELECT min(ln(mz)) - 5 * {bw} AS lo, max(ln(mz)) + 5 * {bw} AS hi, sum(intensity) AS total FROM {src}),
sh AS (SELECT lo, total, (hi - lo) / {n - 1} AS h FROM sp),
ex AS (SELECT lo, h, x, w, unnest(range(CAST(greatest(0, ceil((x - 5 * {bw} - lo) / h)) AS BIGINT), CAST(least({n - 1}, floor((x + 5 * {bw} - lo) / h)) AS BIGINT) + 1)) AS g
  FROM (SELECT ln(mz) AS x, intensity AS w FROM {src}), sh),
ds AS (SELECT g, sum(w * exp(-0.5 * pow((lo + g * h - x) / {bw}, 2))) AS s FROM ex GROUP BY g),
gr AS (SELECT r.range AS g, lo + r.range * h AS x, coalesce(s / (sqrt(2 * pi()) * {bw} * total), 0) AS density FROM range({n}) r CROSS JOIN sh LEFT JOIN ds ON ds.g = r.range),
mk AS (SELECT *, coalesce(density > lag(density) OVER (ORDER BY g) AND density > lead(density) OVER (ORDER BY g), false) AS is_max, (SELECT quantile_cont(density, 0.5) FROM gr) AS thr FROM gr),
mx AS (SELECT g, exp(x) AS mz, density, density > thr AS prominent FROM mk WHERE is_max),
ax AS (SELECT CAST(row_number() OVER (ORDER BY mz) - 1 AS INTEGER) AS channel, mz, lag(mz) OVER (ORDER BY mz) AS before, lead(mz) OVER (ORDER BY mz) AS after FROM mx WHERE prominent)"""


def assigned(src: str = "peaks", tol: str = "50e-6::DOUBLE") -> str:
    return f"""hit AS (SELECT p.*, a.channel FROM {src} p JOIN ax a ON p.mz >= a.mz * (1 - {tol}) AND p.mz <= a.mz * (1 + {tol})
  AND ((p.mz <= a.mz AND (a.before IS NULL OR p.mz > a.before)) OR (p.mz > a.mz AND (a.after IS NULL OR p.mz <= a.after))))"""


KDE = f"""{PEAKS}, {density()}, {assigned()},
ev AS (SELECT pixel_id, channel, max(intensity) AS intensity, count(*) AS k FROM hit GROUP BY pixel_id, channel),
ct AS (SELECT a.channel AS old, a.mz, coalesce(count(*) FILTER (e.intensity > 0), 0) / 256 AS prevalence, coalesce(sum(k), 0) AS n_peaks FROM ax a LEFT JOIN ev e ON e.channel = a.channel GROUP BY a.channel, a.mz),
kc AS (SELECT CAST(row_number() OVER (ORDER BY mz) - 1 AS INTEGER) AS channel, * FROM ct WHERE prevalence >= 0.05)"""

TIC = "SELECT pixel_id, coalesce(sum(intensity), 0) AS tic FROM pixels LEFT JOIN {src} USING (pixel_id) GROUP BY pixel_id"


def hot(src: str = "peaks") -> str:
    return f"""tic AS ({TIC.format(src=src)}),
lim AS (SELECT m + 2.0 * 1.4826 * median(abs(tic - m)) AS threshold FROM tic, (SELECT median(tic) AS m FROM tic) GROUP BY m),
hot AS (SELECT pixel_id, tic, threshold FROM tic, lim WHERE tic > threshold)"""


EDGES = """steps AS (SELECT * FROM (VALUES {steps}) v(dy, dx)),
edges AS (SELECT p.pixel_id, q.pixel_id AS nb FROM pixels p, steps s JOIN pixels q ON q.gx = p.gx + s.dx AND q.gy = p.gy + s.dy)"""
QUEEN = EDGES.format(steps="(-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)")
ROOK = EDGES.format(steps="(-1,0),(0,-1),(0,1),(1,0)")
NEAR = "near AS (SELECT e.pixel_id, e.nb FROM edges e JOIN hot ON hot.pixel_id = e.pixel_id WHERE e.nb NOT IN (SELECT pixel_id FROM hot))"


def moran(dense: str, out: str, extra: str = "") -> str:
    """CTE ``out`` (extra, channel, i) of the dense images in ``dense`` (extra, channel, pixel_id, x)."""
    e = f"{extra}, " if extra else ""
    on = f" AND b.{extra} = a.{extra} AND b.channel = a.channel" if extra else " AND b.channel = a.channel"
    ae = f"a.{extra}, " if extra else ""
    return f"""{out}_m AS (SELECT {e}channel, avg(x) AS m, sum(x * x) AS sxx, count(*) AS n FROM {dense} GROUP BY {e}channel),
{out}_v AS (SELECT {ae}a.channel, sum((a.x - m) * (a.x - m)) AS v FROM {dense} a JOIN {out}_m b ON true{on} GROUP BY {ae}a.channel),
{out}_c AS (SELECT {ae}a.channel, sum((a.x - mm.m) * (b.x - mm.m)) AS c FROM {dense} a JOIN edges ON edges.pixel_id = a.pixel_id JOIN {dense} b ON b.pixel_id = edges.nb{on} JOIN {out}_m mm ON mm.channel = a.channel {f'AND mm.{extra} = a.{extra}' if extra else ''} GROUP BY {ae}a.channel),
{out} AS (SELECT {e}channel, (SELECT n FROM np) * c / ((SELECT count(*) FROM edges) * v) AS i FROM {out}_v JOIN {out}_c USING ({e}channel))"""


DENSE = "dense AS (SELECT c.channel, p.pixel_id, coalesce(x.intensity, 0) AS x FROM (SELECT DISTINCT channel FROM cells) c CROSS JOIN pixels p LEFT JOIN cells x ON x.channel = c.channel AND x.pixel_id = p.pixel_id)"
BH = "qq AS (SELECT *, least(1.0, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM {src}))"


def _projections() -> dict[str, str]:
    exprs = {
        "tic": ("sum(intensity)", 2), "rms": ("sqrt(avg(intensity * intensity) FILTER (intensity > 0))", 3), "median": ("median(intensity) FILTER (intensity > 0)", 3),
        "base_peak": ("max(intensity)", 2), "peak_count": ("CAST(count(mz) AS DOUBLE)", 0), "mean_mz": ("sum(mz * intensity) / nullif(sum(intensity), 0)", 5),
    }
    return {f"proj_{k}": f"WITH {PEAKS}, {PIXELS} SELECT pixel_id, round(coalesce({e}, 0), {n}) AS value FROM pixels LEFT JOIN peaks USING (pixel_id) GROUP BY pixel_id" for k, (e, n) in exprs.items()}


def at_curve(pts: str, mz: str) -> str:
    """The value of a curve's points (gi, mz_grid, ppm) at ``mz``, as an expression over its array ``v`` and range."""
    t = f"greatest(0.0, least(199.0, ({mz} - glo) / ((ghi - glo) / 199)))"
    i = f"least(CAST(floor({t}) AS BIGINT), 198)"
    return f"v[{i} + 1] + (v[{i} + 2] - v[{i} + 1]) * ({t} - {i})"


def _warp(head: str = "", thr: str = "6.0::DOUBLE", seed: int = 7, ds: str = "") -> str:
    """CTEs to ``wp``, the warps of ``ref_obs``; ``thr`` is an expression over ``ref`` (and what ``head`` joins as ``cv``).
    With ``ds``, pixel numbers are those of 256 pixels a dataset."""
    source = f"ref_obs JOIN cv USING ({ds})" if ds else "ref_obs, cv" if head else "ref_obs"
    px = "pixel_id % 256" if ds else "pixel_id"
    return f"""{head}an AS (SELECT pixel_id, row_number() OVER (PARTITION BY pixel_id ORDER BY ref_id) - 1 AS k, mz AS obs, ref, {thr} AS thr FROM {source}),
pn AS (SELECT pixel_id, count(*) AS n FROM an GROUP BY pixel_id HAVING count(*) >= 3),
al AS (SELECT pixel_id, n, a.k AS i, b.k AS j, row_number() OVER (PARTITION BY pixel_id ORDER BY a.k, b.k) - 1 AS t FROM pn JOIN an a USING (pixel_id) JOIN an b USING (pixel_id) WHERE a.k < b.k AND n * (n - 1) / 2 <= 64),
dr AS (SELECT pixel_id, n, range AS t, {md5i(f"'{seed}'", px, "range", "'a'")} % n AS x, {md5i(f"'{seed}'", px, "range", "'b'")} % (n - 1) AS y FROM pn, range(64) WHERE n * (n - 1) / 2 > 64),
tr AS (SELECT pixel_id, i, j, t FROM al UNION ALL SELECT pixel_id, least(x, y2), greatest(x, y2), t FROM (SELECT *, CASE WHEN y >= x THEN y + 1 ELSE y END AS y2 FROM dr)),
ln AS (SELECT tr.pixel_id, t, (q.ref - p.ref) / (q.obs - p.obs) AS slope, p.ref - (q.ref - p.ref) / (q.obs - p.obs) * p.obs AS icpt FROM tr JOIN an p ON p.pixel_id = tr.pixel_id AND p.k = i JOIN an q ON q.pixel_id = tr.pixel_id AND q.k = j WHERE p.obs <> q.obs),
rs AS (SELECT ln.pixel_id, t, slope, icpt, abs((slope * obs + icpt - ref) / ref) * 1e6 AS r, thr FROM ln JOIN an USING (pixel_id)),
bl AS (SELECT pixel_id, slope, icpt FROM (SELECT pixel_id, t, slope, icpt, count(*) AS c, sum(r * r) AS sse FROM rs WHERE r <= thr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY c DESC, sse, t) = 1),
il AS (SELECT pixel_id, obs, ref, count(*) OVER (PARTITION BY pixel_id) AS n_inliers FROM bl JOIN an USING (pixel_id) WHERE abs((slope * obs + icpt - ref) / ref) * 1e6 <= thr),
wp AS (SELECT *, lead(obs) OVER w AS obs2, lead(ref) OVER w AS ref2, row_number() OVER w AS k FROM il WHERE n_inliers >= 3 WINDOW w AS (PARTITION BY pixel_id ORDER BY obs)),
sg AS (SELECT p.* EXCLUDE (mz), CASE WHEN w.obs IS NULL THEN p.mz WHEN p.mz < w.obs THEN p.mz + (w.ref - w.obs) WHEN w.obs2 IS NULL THEN CASE WHEN p.mz > w.obs THEN p.mz + (w.ref - w.obs) ELSE w.ref END ELSE w.ref + (p.mz - w.obs) * (w.ref2 - w.ref) / (w.obs2 - w.obs) END AS mz
  FROM peaks p LEFT JOIN wp w ON w.pixel_id = p.pixel_id AND ((w.k = 1 AND p.mz < w.obs) OR (p.mz >= w.obs AND (w.obs2 IS NULL OR p.mz < w.obs2))))"""


def default_chain() -> str:
    """The recommended chain: anchors, curve, warp, median, noise, density maxima, windows of the curve."""
    from .plans.pipeline import node_seed

    cv = "cv AS (SELECT list(ppm ORDER BY gi) AS v, min(mz_grid) AS glo, max(mz_grid) AS ghi FROM pts),\n"
    return f"""WITH {refs(0.8)}, pairs AS (SELECT pixel_id, ref AS x, abs(ppm_error) AS y FROM ref_obs), {curve('pairs')}, {_warp(cv, "2 * (" + at_curve('pts', 'ref') + ")", node_seed(0, 'recal'))},
f1 AS (SELECT *, intensity / greatest(coalesce(median(intensity) FILTER (intensity > 0) OVER (PARTITION BY pixel_id), 0), 1e-12) AS i1 FROM sg),
f2 AS (SELECT *, median(i1) OVER (PARTITION BY pixel_id) AS m FROM f1), f3 AS (SELECT *, median(abs(i1 - m)) OVER (PARTITION BY pixel_id) AS mad FROM f2),
pp AS (SELECT pixel_id, mz, i1 AS intensity FROM f3 WHERE i1 > 0.5 * 1.4826 * mad), {density('pp')},
aw AS (SELECT ax.*, {at_curve('pts', 'mz')} AS tol FROM ax, cv),
hit AS (SELECT p.*, a.channel FROM pp p JOIN aw a ON p.mz >= a.mz * (1 - tol * 1e-6::DOUBLE) AND p.mz <= a.mz * (1 + tol * 1e-6::DOUBLE)
  AND ((p.mz <= a.mz AND (a.before IS NULL OR p.mz > a.before)) OR (p.mz > a.mz AND (a.after IS NULL OR p.mz <= a.after)))),
ev AS (SELECT pixel_id, channel, max(intensity) AS intensity, count(*) AS k FROM hit GROUP BY pixel_id, channel),
ct AS (SELECT a.channel AS old, a.mz, coalesce(count(*) FILTER (e.intensity > 0), 0) / 256 AS prevalence, coalesce(sum(k), 0) AS n_peaks FROM aw a LEFT JOIN ev e ON e.channel = a.channel GROUP BY a.channel, a.mz)
SELECT CAST(row_number() OVER (ORDER BY mz) - 1 AS INTEGER) AS channel, round(mz, 4) AS mz, round(prevalence, 6) AS prevalence, CAST(n_peaks AS BIGINT) AS n_peaks FROM ct WHERE prevalence >= 0.05"""


def keyed_rows(node: str, src: str, *rows: tuple[str, str, str]) -> str:
    """(node, key, value, grade) of the one row of ``src``; a row is a key, its value and its grade."""
    return " UNION ALL ".join(f"SELECT '{node}' AS node, '{k}' AS key, round(CAST({v} AS DOUBLE), 6) AS value, {g or chr(39) * 2} AS grade FROM {src}" for k, v, g in rows)


def _graded(db: str, fdr: str) -> dict[str, str]:
    """Summaries of operators with their grades."""
    three = lambda c, good, bad: f"CASE WHEN {c} < {bad} THEN 'bad' WHEN {c} >= {good} THEN 'ok' ELSE 'warn' END"
    out = {}
    out["diag_hot_pixels"] = f"""WITH {PEAKS}, {PIXELS}, {hot()}, md AS (SELECT median(tic) AS m FROM tic), s AS (SELECT (SELECT count(*) FROM hot) AS n, (SELECT count(*) FROM hot) / 256 AS f, m, (SELECT median(abs(tic - m)) FROM tic, md) AS mad, (SELECT threshold FROM lim) AS t FROM md)
{keyed_rows('hot', 's', ('n_hot_pixels', 'n', ''), ('fraction_hot', 'f', "CASE WHEN f > 0.15 THEN 'bad' WHEN f <= 0.05 THEN 'ok' ELSE 'warn' END"), ('tic_median', 'm', ''), ('tic_mad', 'mad', ''), ('tic_threshold', 't', ''), ('k_mad', '2.0', ''))}"""
    out["diag_lock_mass"] = f"""WITH {refs(0.5)}, o AS (SELECT pixel_id, (mz / ref - 1) * 1e6 AS x FROM ref_obs QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY abs(ref - 455.0), ref_id) = 1 AND abs(mz - ref) / ref * 1e6 <= 500),
s AS (SELECT count(*) AS n, median(x) AS m, median(abs(x)) AS a, max(abs(x)) AS t FROM o)
{keyed_rows('lock', 's', ('n_pixels_recalibrated', 'n', ''), ('n_pixels_skipped', '256 - n', ''), ('fraction_pixels_recalibrated', 'n / 256', three('n / 256', 0.9, 0.6)), ('ppm_shift_median', 'm', ''), ('ppm_shift_abs_median', 'a', "CASE WHEN a >= 200 THEN 'bad' WHEN a < 50 THEN 'ok' ELSE 'warn' END"), ('ppm_shift_abs_max', 't', ''), ('anchor_strategy_index', '2', ''))}"""
    out["diag_warp"] = f"""WITH {refs(0.5)}, {_warp()},
mv AS (SELECT a.ref, CASE WHEN a.obs < w.obs THEN a.obs + (w.ref - w.obs) WHEN w.obs2 IS NULL THEN a.obs + (w.ref - w.obs) ELSE w.ref + (a.obs - w.obs) * (w.ref2 - w.ref) / (w.obs2 - w.obs) END AS mz
  FROM an a JOIN wp w ON w.pixel_id = a.pixel_id AND ((w.k = 1 AND a.obs < w.obs) OR (a.obs >= w.obs AND (w.obs2 IS NULL OR a.obs < w.obs2)))),
px AS (SELECT pixel_id, any_value(n_inliers) AS k FROM wp GROUP BY pixel_id),
s AS (SELECT (SELECT count(*) FROM px) AS n, (SELECT median(k) FROM px) AS im, (SELECT min(k) FROM px) AS il, (SELECT median(abs(ppm_error)) FROM ref_obs) AS a, (SELECT median(abs((mz - ref) / ref * 1e6)) FROM mv) AS b)
{keyed_rows('recal', 's', ('n_pixels_recalibrated', 'n', ''), ('n_pixels_skipped', '256 - n', ''), ('fraction_pixels_recalibrated', 'n / 256', three('n / 256', 0.9, 0.6)), ('inliers_median', 'im', three('im', 5, 3)), ('inliers_min', 'il', ''), ('pre_residual_median_ppm', 'a', ''), ('post_residual_median_ppm', 'b', ''), ('improvement_ppm', 'a - b', "CASE WHEN a - b <= 0 THEN 'bad' ELSE 'ok' END"))}"""
    out["diag_dbscan"] = f"""{db}, pv AS (SELECT cluster, count(*) FILTER (intensity > 0) / (SELECT count(DISTINCT user_id) FROM events) AS p FROM ev GROUP BY cluster),
s AS (SELECT (SELECT count(*) FROM ch) AS n, (SELECT count(*) FROM pk) AS k, (SELECT count(*) FROM lb) AS h, (SELECT eps FROM ep) AS eps, (SELECT min(p) FROM pv) AS lo, (SELECT median(p) FROM pv) AS md, (SELECT max(p) FROM pv) AS hi)
{keyed_rows('consensus', 's', ('n_consensus_peaks', 'n', three('n', 10, 1)), ('n_clusters_pre_filter', 'n', ''), ('eps_log_mz', 'eps', ''), ('eps_ppm_effective', '(exp(eps) - 1) * 1e6', ''), ('min_samples', '4', ''), ('n_noise_peaks', 'k - h', ''), ('fraction_noise', '1 - h / k', "CASE WHEN 1 - h / k >= 0.8 THEN 'bad' WHEN 1 - h / k < 0.5 THEN 'ok' ELSE 'warn' END"), ('prevalence_min', 'lo', three('lo', 0.5, 0.3)), ('prevalence_median', 'md', three('md', 0.7, 0.5)), ('prevalence_max', 'hi', ''))}"""
    head, tail = fdr.rsplit("\nSELECT ", 1)
    out["diag_prevalence_fdr"] = f"""{head}, s AS (SELECT count(*) AS n, min(p) AS p0, median(p) AS p1, min(q) AS q0, median(q) AS q1 FROM qq)
{keyed_rows('fdr', 's', ('n_channels_in', 'n', ''), ('n_channels_out', 'n', "CASE WHEN n < 1 THEN 'bad' ELSE 'ok' END"), ('n_dropped_by_fdr', '0', ''), ('p_value_min', 'p0', ''), ('p_value_median', 'p1', ''), ('q_value_min', 'q0', ''), ('q_value_median', 'q1', ''), ('warning_conservative_fallback', '0', ''), ('n_permutations', '499', ''), ('q_threshold', '1.5', ''))}"""
    return out


def sql() -> dict[str, str]:
    out = _projections()
    out["image_raster_tic"] = f"WITH {PEAKS}, {PIXELS} SELECT gy, gx, round(coalesce(sum(intensity), 0), 2) AS value FROM pixels LEFT JOIN peaks USING (pixel_id) GROUP BY gy, gx"
    out["pixel_spectrum"] = f"WITH {PEAKS} SELECT round(mz, 6) AS mz, round(intensity, 2) AS intensity FROM peaks WHERE pixel_id = 4 * 16 + 3"
    out["contrast_tic"] = f"WITH {PEAKS}, {PIXELS}, t AS ({TIC.format(src='peaks')}) SELECT round(quantile_cont(tic, 0.01), 2) AS low, round(quantile_cont(tic, 0.99), 2) AS high FROM t WHERE tic > 0"
    for m, e in (("mean", "avg(x)"), ("median", "median(x)"), ("sum", "sum(x)"), ("max", "max(x)")):
        out[f"roi_spectrum_matrix_{m}"] = f"WITH {CELLS}, {DENSE} SELECT channel, 100.0::DOUBLE + channel AS mz, round({e}, 6) AS value FROM dense JOIN pixels USING (pixel_id) WHERE {FG} GROUP BY channel"
    for m, e in (("sum", "sum(intensity)"), ("mean", "avg(intensity)"), ("max", "max(intensity)")):
        out[f"roi_spectrum_raw_{m}"] = f"""WITH {PEAKS}, {PIXELS}, p AS (SELECT ln(mz) AS x, intensity FROM peaks JOIN pixels USING (pixel_id) WHERE {FG} AND intensity > 0), lo AS (SELECT min(x) AS lo FROM p)
SELECT CAST(floor((x - lo) / (50.0::DOUBLE * 1e-6::DOUBLE)) AS BIGINT) AS bin, round(exp(any_value(lo) + (CAST(floor((x - lo) / (50.0::DOUBLE * 1e-6::DOUBLE)) AS BIGINT) + 0.5) * 5e-5::DOUBLE), 6) AS mz, round({e}, 2) AS value FROM p, lo GROUP BY CAST(floor((x - lo) / (50.0::DOUBLE * 1e-6::DOUBLE)) AS BIGINT)"""
    ref_cols = "SELECT ref_id, round(mz, 6) AS mz, round(prevalence, 6) AS prevalence, n_obs FROM ref_ions"
    out["ref_ions"] = f"WITH {refs(0.5)} {ref_cols}"
    out["ref_ions_unmerged"] = f"WITH {refs(0.3, False)} {ref_cols}"
    out["ref_obs_ppm"] = f"WITH {refs(0.5)} SELECT pixel_id, ref_id, round(mz, 6) AS mz, round(intensity, 2) AS intensity, round(ppm_error, 4) AS ppm_error FROM ref_obs"
    pairs = "pairs AS (SELECT pixel_id, ref AS x, abs(ppm_error) AS y FROM ref_obs)"
    out["tolerance_curve"] = f"WITH {refs(0.5)}, {pairs}, {curve('pairs')} SELECT gi AS i, round(mz_grid, 5) AS mz_grid, round(ppm, 4) AS ppm_quantile FROM pts"
    keyed = "((j * a + b) % 2147483647) * ((j * a + b) % 2147483647) % 2147483647 * ((j * a + b) % 2147483647) + j"
    ab = f"""ab AS (SELECT range AS rep, 1 + {md5i("'7'", "range", "'a'")} % 2147483646 AS a, {md5i("'7'", "range", "'b'")} % 2147483647 AS b FROM range(1000))"""
    pixels_drawn = f"dw AS (SELECT rep, ({keyed}) % 2147483647 % 256 AS pixel_id FROM ab, (SELECT range AS j FROM range(256)))"
    # Blocks of 6 x 6 pixels and what the rim leaves; of the last one the first pixels, until there are 256.
    blocks_drawn = f"""bk AS (SELECT pixel_id, gy // 6 * 3 + gx // 6 AS block, row_number() OVER (PARTITION BY gy // 6 * 3 + gx // 6 ORDER BY pixel_id) AS r FROM pixels),
bs AS (SELECT block, count(*) AS size, row_number() OVER (ORDER BY block) - 1 AS k FROM bk GROUP BY block),
bd AS (SELECT rep, j, ({keyed}) % 2147483647 % 9 AS k FROM ab, (SELECT range AS j FROM range(16))),
bc AS (SELECT rep, block, 256 - (sum(size) OVER (PARTITION BY rep ORDER BY j) - size) AS room FROM bd JOIN bs USING (k)),
dw AS (SELECT rep, pixel_id FROM bc JOIN bk USING (block) WHERE r <= room)"""
    for n, drawn in (("bootstrap_ci", pixels_drawn), ("block_bootstrap", f"{PIXELS}, {blocks_drawn}")):
        out[f"tolerance_{n}"] = f"""WITH {refs(0.5)}, {pairs}, {curve('pairs')}, {ab}, {drawn}, bp AS (SELECT rep, x, y FROM pairs JOIN dw USING (pixel_id)), {curve('bp', 'rep', '2')},
band AS (SELECT gi, quantile_cont(ppm, 0.025) AS a, quantile_cont(ppm, 0.975) AS b FROM pts2 GROUP BY gi)
SELECT gi AS i, round(mz_grid, 5) AS mz_grid, round(ppm, 4) AS ppm_quantile, round(a, 4) AS ci_low, round(b, 4) AS ci_high FROM pts JOIN band USING (gi)"""
    for n, o in (("intensity", "-intensity"), ("prevalence", "-prevalence"), ("closest", "abs(ref - 455.0)")):
        out[f"recal_lock_mass_{n}"] = f"WITH {refs(0.5)} SELECT pixel_id, round((mz / ref - 1) * 1e6, 4) AS shift_ppm FROM ref_obs QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY {o}, ref_id) = 1 AND abs(mz - ref) / ref * 1e6 <= 500"
    out["recal_msiwarp_inliers"] = f"WITH {refs(0.5)}, {_warp()} SELECT DISTINCT pixel_id, CAST(n_inliers AS INTEGER) AS n_inliers FROM wp"
    out["recal_msiwarp"] = f"WITH {refs(0.5)}, {_warp()} SELECT pixel_id, peak_idx, round(mz, 5) AS mz, round(intensity, 2) AS intensity FROM sg"
    out["pipeline_default"] = default_chain()
    norm = "SELECT pixel_id, peak_idx, round(mz, 6) AS mz, round(intensity / greatest(coalesce({f}, 0), 1e-12), 8) AS intensity FROM peaks"
    out["norm_median"] = f"WITH {PEAKS}, f AS (SELECT pixel_id, median(intensity) FILTER (intensity > 0) AS f FROM peaks GROUP BY pixel_id) {norm.format(f='f')} JOIN f USING (pixel_id)"
    out["norm_tic"] = f"WITH {PEAKS}, f AS (SELECT pixel_id, sum(intensity) AS f FROM peaks GROUP BY pixel_id) {norm.format(f='f')} JOIN f USING (pixel_id)"
    out["norm_reference"] = f"WITH {refs(0.5)}, f AS (SELECT pixel_id, sum(intensity) AS f FROM ref_obs GROUP BY pixel_id) {norm.format(f='f')} LEFT JOIN f USING (pixel_id)"
    snr = """WITH {peaks}, m AS (SELECT pixel_id, median(intensity) AS m, quantile_cont(intensity, 0.6) AS q FROM peaks GROUP BY pixel_id),
t AS (SELECT pixel_id, {e} AS threshold FROM (SELECT pixel_id, median(abs(intensity - m)) AS mad, any_value(q) AS q FROM peaks JOIN m USING (pixel_id) GROUP BY pixel_id))
SELECT pixel_id, peak_idx, round(mz, 6) AS mz, round(intensity, 2) AS intensity, round(threshold, 3) AS threshold FROM peaks JOIN t USING (pixel_id) WHERE intensity > threshold"""
    out["pick_snr"] = snr.format(peaks=PEAKS, e="greatest(1.5 * 1.4826 * mad, 0)")
    out["pick_snr_quantile"] = snr.format(peaks=PEAKS, e="greatest(0.5 * 1.4826 * mad, 1000.0, q)")
    out["consensus_kde_maxima"] = f"WITH {PEAKS}, {density()} SELECT g, round(mz, 5) AS mz, round(density, 4) AS density, prominent FROM mx"
    out["consensus_kde_axis"] = f"WITH {KDE} SELECT channel, round(mz, 5) AS mz, round(prevalence, 6) AS prevalence, CAST(n_peaks AS BIGINT) AS n_peaks FROM kc"
    out["consensus_kde_cells"] = f"WITH {KDE} SELECT pixel_id, kc.channel, round(intensity, 2) AS intensity FROM ev JOIN kc ON kc.old = ev.channel WHERE intensity > 0"
    out["consensus_budget"] = f"WITH {KDE} SELECT count(*) AS n_candidates, count(*) FILTER (prevalence >= 0.05) AS n_kept, count(*) FILTER (prevalence < 0.05) AS n_rejected, round(median(prevalence), 6) AS prevalence_median FROM ct"
    db = f"""WITH pk AS (SELECT user_id AS pixel_id, event_id AS peak_idx, 100.0::DOUBLE + value AS mz, value AS intensity, ln(100.0::DOUBLE + value) AS x FROM events),
ep AS (SELECT {step(30.0)} AS eps),
nb AS (SELECT *, count(*) OVER (ORDER BY x RANGE BETWEEN (SELECT eps FROM ep) PRECEDING AND (SELECT eps FROM ep) FOLLOWING) >= 4 AS core FROM pk),
cs AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x) > (SELECT eps FROM ep) THEN 1 ELSE 0 END AS s FROM nb WHERE core),
cl AS (SELECT cluster, min(x) AS lo, max(x) AS hi, arg_min(pixel_id, (pixel_id, peak_idx)) AS f1, arg_min(peak_idx, (pixel_id, peak_idx)) AS f2 FROM (SELECT *, sum(s) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster FROM cs) GROUP BY cluster),
lb AS (SELECT nb.*, cluster FROM nb JOIN cl ON lo - x <= (SELECT eps FROM ep) AND x - hi <= (SELECT eps FROM ep) QUALIFY row_number() OVER (PARTITION BY pixel_id, peak_idx ORDER BY f1, f2, cluster) = 1),
ev AS (SELECT pixel_id, cluster, max(intensity) AS intensity FROM lb GROUP BY pixel_id, cluster),
ch AS (SELECT CAST(row_number() OVER (ORDER BY mz) - 1 AS INTEGER) AS channel, * FROM (SELECT cluster, sum(mz * intensity) / sum(intensity) AS mz, count(*) AS n_peaks FROM lb GROUP BY cluster))"""
    out["consensus_dbscan_axis"] = f"{db} SELECT channel, round(any_value(mz), 5) AS mz, round(count(*) FILTER (intensity > 0) / (SELECT count(DISTINCT user_id) FROM events), 6) AS prevalence, any_value(n_peaks) AS n_peaks FROM ch JOIN ev USING (cluster) GROUP BY channel"
    out["consensus_dbscan_cells"] = f"{db} SELECT pixel_id, channel, round(intensity, 4) AS intensity FROM ev JOIN ch USING (cluster) WHERE intensity > 0"
    out["channel_table"] = f"WITH {CELLS} SELECT channel, mz, round(prevalence, 6) AS prevalence FROM channels"
    out["channel_topn"] = f"WITH {CELLS} SELECT channel, mz, round(prevalence, 6) AS prevalence FROM channels ORDER BY channels.prevalence DESC, channel DESC LIMIT 10"
    out["channel_nearest"] = f"WITH {CELLS} SELECT channel, mz FROM channels ORDER BY abs(mz - 123.5), channel LIMIT 1"
    out["channel_image"] = f"WITH {CELLS}, e AS (SELECT * FROM cells WHERE channel = 7) SELECT CAST(g.range // 25 AS INTEGER) AS gy, CAST(g.range % 25 AS INTEGER) AS gx, round(coalesce(intensity, 0), 6) AS value FROM range((SELECT (max(gy) + 1) * 25 FROM pixels)) g LEFT JOIN e ON e.pixel_id = g.range"
    out["axis_nearest_join"] = f"WITH {PEAKS}, ax AS (SELECT CAST(range AS INTEGER) AS channel, 215.0::DOUBLE + 20 * range AS c FROM range(25)), h AS (SELECT pixel_id, peak_idx, mz, intensity, arg_min(channel, (abs(mz - c), channel)) AS channel FROM peaks, ax GROUP BY ALL) SELECT pixel_id, channel, round(max(intensity), 2) AS intensity FROM h GROUP BY pixel_id, channel"
    out["whatif_prevalence"] = f"WITH {CELLS} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (prevalence >= t) AS n, count(*) FILTER (prevalence >= t) - count(*) FILTER (prevalence >= 0.5) AS delta FROM channels, (SELECT unnest([0.3, 0.4, 0.45, 0.5, 0.55, 0.6]) AS t) GROUP BY t"
    out["cdf_prevalence"] = f"WITH {CELLS} SELECT DISTINCT round(prevalence, 6) AS value, round(cume_dist() OVER (ORDER BY prevalence), 6) AS share FROM channels"
    bins = """e AS (SELECT CAST(r.range AS INTEGER) AS bin, lo + r.range * ((hi - lo) / k) AS l, CASE WHEN r.range = k - 1 THEN hi ELSE lo + (r.range + 1) * ((hi - lo) / k) END AS r, r.range = k - 1 AS last FROM range(50) r JOIN s ON r.range < k)
SELECT bin, round(l, 3) AS "left", round(r, 3) AS "right", (SELECT count(*) FROM f WHERE v >= l AND (v < r OR last AND v = r)) AS n FROM e"""
    factors = f"WITH {PEAKS}, f AS (SELECT median(intensity) FILTER (intensity > 0) AS v FROM peaks GROUP BY pixel_id)"
    out["hist_factor"] = f"{factors}, s AS (SELECT min(v) AS lo, max(v) AS hi, 16 AS k FROM f), {bins}"
    out["hist_factor_sqrt"] = f"{factors}, s AS (SELECT min(v) AS lo, max(v) AS hi, CAST(least(50, greatest(8, floor(sqrt(count(v))))) AS INTEGER) AS k FROM f), {bins}"
    out["hist_peak_counts"] = f"""WITH {PEAKS}, f AS (SELECT count(*) AS v FROM peaks GROUP BY pixel_id), s AS (SELECT min(v) AS lo, max(v) AS hi FROM f)
SELECT CAST(g.range - lo AS INTEGER) AS bin, CAST(g.range AS DOUBLE) AS "left", CAST(g.range + 1 AS DOUBLE) AS "right", (SELECT count(*) FROM f WHERE v = g.range) AS n FROM s, range((SELECT lo FROM s), (SELECT hi + 1 FROM s)) g"""
    out["plotted_mz"] = f"WITH {PEAKS} SELECT round(m, 6) AS mz FROM (SELECT DISTINCT mz AS m FROM peaks WHERE pixel_id IN (4 * 16 + 3, 4 * 16 + 4))"
    out["imzml_round_trip"] = f"WITH {PEAKS} SELECT pixel_id, row_number() OVER (PARTITION BY pixel_id ORDER BY peak_idx, mz, intensity) - 1 AS peak_idx, round(mz, 6) AS mz, round(CAST(CAST(intensity AS FLOAT) AS DOUBLE), 2) AS intensity FROM peaks"
    out["tiff_round_trip"] = f"WITH {CELLS} SELECT channel, pixel_id AS grid_idx, round(CAST(CAST(intensity AS FLOAT) AS DOUBLE), 6) AS intensity FROM cells"
    out["imzml_some_pixels"] = f"WITH {PEAKS} SELECT pixel_id, count(*) AS n, round(sum(CAST(CAST(intensity AS FLOAT) AS DOUBLE)), 0) AS tic FROM peaks WHERE pixel_id BETWEEN 100 AND 131 GROUP BY pixel_id"
    out["fdr_prevalence"] = f"""WITH {CELLS}, fl AS (SELECT channel, rep.range AS rep, count(DISTINCT {md5i("'7'", "rep.range", "channel", "ball")} % (SELECT n FROM np)) AS fu FROM (SELECT channel, unnest(range(1, n_peaks + 1)) AS ball FROM channels), range(499) rep GROUP BY channel, rep.range),
pp AS (SELECT channel, any_value(n_peaks) AS balls, any_value(n_peaks // 2) AS obs, (count(*) FILTER (fu >= n_peaks // 2) + 1) / 500.0::DOUBLE AS p FROM fl JOIN channels USING (channel) GROUP BY channel), {BH.format(src='pp')}
SELECT channel, CAST(obs AS BIGINT) AS obs, CAST(balls AS BIGINT) AS balls, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS kept FROM qq"""
    # Ball by ball: the list holds the probabilities of 0, 1, ... filled pixels.
    out["fdr_prevalence_exact"] = f"""WITH RECURSIVE {CELLS}, oc AS (SELECT 0 AS t, list_transform(range(0, n + 1), lambda x: CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, n FROM np
UNION ALL SELECT t + 1, list_transform(range(0, n + 1), lambda x: p[x + 1] * (x / n) + CASE WHEN x > 0 THEN p[x] * ((n - x + 1) / n) ELSE 0 END), n FROM oc WHERE t < (SELECT max(n_peaks) FROM channels)),
pp AS (SELECT channel, n_peaks AS balls, n_peaks // 2 AS obs, least(1.0, list_sum(p[n_peaks // 2 + 1:])) AS p FROM channels JOIN oc ON oc.t = n_peaks), {BH.format(src='pp')}
SELECT channel, CAST(obs AS BIGINT) AS obs, CAST(balls AS BIGINT) AS balls, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS kept FROM qq"""
    for k, e in (("queen", QUEEN), ("rook", ROOK)):
        out[f"morans_i_{k}"] = f"WITH {CELLS}, {DENSE}, {e}, {moran('dense', 'mo')} SELECT channel, round(i, 6) AS i FROM mo"
    out["morans_i_fdr"] = f"""WITH {CELLS}, {DENSE}, {QUEEN}, {moran('dense', 'mo')},
ab AS (SELECT range AS rep, 1 + {md5i("'7'", "range", "'a'")} % 2147483646 AS a, {md5i("'7'", "range", "'b'")} % 2147483647 AS b FROM range(499)),
uu AS (SELECT rep, pixel_id, (pixel_id % 2147483647 * a + b) % 2147483647 AS u FROM pixels, ab),
sf AS (SELECT rep, pixel_id, row_number() OVER (PARTITION BY rep ORDER BY (u * u % 2147483647 * u + pixel_id) % 2147483647, pixel_id) AS k FROM uu),
pl AS (SELECT pixel_id AS to_id, row_number() OVER (ORDER BY pixel_id) AS k FROM pixels),
pd AS (SELECT rep, channel, to_id AS pixel_id, x FROM dense JOIN sf USING (pixel_id) JOIN pl USING (k)), {moran('pd', 'nu', 'rep')},
pp AS (SELECT channel, any_value(mo.i) AS i, (count(*) FILTER (abs(nu.i) >= abs(mo.i) - 1e-12) + 1) / 500.0::DOUBLE AS p FROM mo JOIN nu USING (channel) GROUP BY channel), {BH.format(src='pp')}
SELECT channel, round(i, 6) AS i, round(p, 6) AS p, round(q, 6) AS q, q < 0.2 AS kept FROM qq"""
    out["hot_pixels_mark"] = f"WITH {PEAKS}, {PIXELS}, {hot()} SELECT pixel_id, round(tic, 2) AS tic, round(threshold, 2) AS threshold FROM hot"
    out["hot_pixels_zero"] = f"WITH {PEAKS}, {PIXELS}, {hot()} SELECT pixel_id, peak_idx, round(CASE WHEN pixel_id IN (SELECT pixel_id FROM hot) THEN 0 ELSE intensity END, 3) AS intensity FROM peaks"
    out["hot_pixels_neighbors_pl"] = f"""WITH {PEAKS}, {PIXELS}, {hot()}, {QUEEN}, {NEAR},
lv AS (SELECT near.pixel_id, count(*) AS n, median(tic) AS level FROM near JOIN tic ON tic.pixel_id = near.nb GROUP BY near.pixel_id),
sc AS (SELECT hot.pixel_id, CASE WHEN coalesce(n, 0) < 3 THEN 0 ELSE level / tic END AS scale FROM hot LEFT JOIN lv USING (pixel_id))
SELECT pixel_id, peak_idx, round(intensity * coalesce(scale, 1), 3) AS intensity FROM peaks LEFT JOIN sc USING (pixel_id)"""
    out["hot_pixels_neighbors_pm"] = f"""WITH {CELLS}, {hot('cells')}, {QUEEN}, {NEAR}, {DENSE},
gd AS (SELECT pixel_id FROM near GROUP BY pixel_id HAVING count(*) >= 3),
nw AS (SELECT near.pixel_id, channel, median(x) AS intensity FROM near JOIN gd USING (pixel_id) JOIN dense ON dense.pixel_id = near.nb GROUP BY near.pixel_id, channel)
SELECT pixel_id, channel, round(intensity, 6) AS intensity FROM cells WHERE pixel_id NOT IN (SELECT pixel_id FROM hot) UNION ALL SELECT pixel_id, channel, round(intensity, 6) FROM nw WHERE intensity > 0"""
    bg = f"""WITH {CELLS}, {DENSE}, rt AS (SELECT channel, avg(x) FILTER ({FG}) AS mean_fg, avg(x) FILTER ({BG}) AS mean_bg FROM dense JOIN pixels USING (pixel_id) GROUP BY channel)"""
    out["bg_reject"] = f"{bg} SELECT channel, 100.0::DOUBLE + channel AS mz, round(mean_fg, 6) AS mean_fg, round(mean_bg, 6) AS mean_bg, round(mean_bg / greatest(mean_fg, 1e-9), 6) AS ratio FROM rt WHERE mean_bg / greatest(mean_fg, 1e-9) < 1.0"
    out["bg_subtract"] = f"{bg} SELECT pixel_id, channel, round(intensity - mean_bg, 6) AS intensity FROM cells JOIN rt USING (channel) WHERE intensity > mean_bg"
    # The cohort: pixel numbers of all three datasets in a row, anchors, curves and warps for each, one density for all.
    names = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
    head = PEAKS.replace("l_orderkey % 256 AS pixel_id", f"{names} * 256 + l_orderkey % 256 AS pixel_id")
    cv = "cv AS (SELECT ds, list(ppm ORDER BY gi) AS v, min(mz_grid) AS glo, max(mz_grid) AS ghi FROM pts GROUP BY ds),\n"
    co = f"""WITH {refs(0.5, True, head, 'ds')}, pairs AS (SELECT ds, ref AS x, abs(ppm_error) AS y FROM ref_obs), {curve('pairs', 'ds', '', True)}, {_warp(cv, "2 * (" + at_curve('pts', 'ref') + ")", 0, 'ds')},
f1 AS (SELECT *, intensity / greatest(coalesce(median(intensity) FILTER (intensity > 0) OVER (PARTITION BY pixel_id), 0), 1e-12) AS i1 FROM sg),
f2 AS (SELECT *, median(i1) OVER (PARTITION BY pixel_id) AS m FROM f1), f3 AS (SELECT *, median(abs(i1 - m)) OVER (PARTITION BY pixel_id) AS mad FROM f2),
pp AS (SELECT ds, pixel_id, mz, i1 AS intensity FROM f3 WHERE i1 > 0.5 * 1.4826 * mad), {density('pp')}"""
    out["cohort_axis"] = f"{co} SELECT channel, round(mz, 5) AS mz FROM ax"
    prevalences = f"""{co}, aw AS (SELECT ds, ax.*, {at_curve('pts', 'mz')} AS tol FROM ax, cv),
hit AS (SELECT p.*, a.channel FROM pp p JOIN aw a ON p.ds = a.ds AND p.mz >= a.mz * (1 - tol * 1e-6::DOUBLE) AND p.mz <= a.mz * (1 + tol * 1e-6::DOUBLE)
  AND ((p.mz <= a.mz AND (a.before IS NULL OR p.mz > a.before)) OR (p.mz > a.mz AND (a.after IS NULL OR p.mz <= a.after)))),
ev AS (SELECT ds, pixel_id, channel, max(intensity) AS intensity, count(*) AS k FROM hit GROUP BY ds, pixel_id, channel)"""
    out["cohort_prevalence"] = f"""{prevalences} SELECT a.ds AS dataset_id, a.channel, round(any_value(a.mz), 5) AS mz, round(count(*) FILTER (e.intensity > 0) / 256, 6) AS prevalence, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_peaks FROM aw a LEFT JOIN ev e ON e.ds = a.ds AND e.channel = a.channel GROUP BY a.ds, a.channel"""
    out["cohort_growth"] = f"{prevalences} SELECT a.channel, round(any_value(a.mz), 5) AS mz, round(count(e.pixel_id) FILTER (e.intensity > 0) / 768, 6) AS prevalence FROM ax a LEFT JOIN ev e USING (channel) GROUP BY a.channel"
    out |= _graded(db, out["fdr_prevalence_exact"])
    out["diag_grades"] = f"""WITH {CELLS}, s AS (SELECT CAST(count(*) AS DOUBLE) AS a, min(prevalence) AS b, median(prevalence) AS c FROM channels)
SELECT 'channels' AS node, 'n_channels' AS key, round(a, 6) AS value, '' AS grade FROM s
UNION ALL SELECT 'channels', 'prevalence_min', round(b, 6), CASE WHEN b < 0.3 THEN 'bad' WHEN b >= 0.5 THEN 'ok' ELSE 'warn' END FROM s
UNION ALL SELECT 'channels', 'prevalence_median', round(c, 6), CASE WHEN c < 0.5 THEN 'bad' WHEN c >= 0.7 THEN 'ok' ELSE 'warn' END FROM s"""
    return out
