"""DuckDB SQL of the core queries."""

from __future__ import annotations

from ..functions import constants as K
from .views import PIXEL_COLUMNS


def _basin(lat: str, lon: str) -> str:
    arms = " ".join(f"WHEN {lat} BETWEEN {s}e0 AND {n}e0 AND {lon} BETWEEN {w}e0 AND {e}e0 THEN '{name}'" for name, s, n, w, e in K.BASINS)
    return f"CASE {arms} ELSE 'Other' END"


def _class(t: str) -> str:
    arms = " ".join(f"WHEN {t} > {limit} THEN '{name}'" for limit, name in K.CLASSES)
    return f"CASE WHEN {t} IS NULL THEN '{K.FAILED_CLASS}' {arms} ELSE '{K.COLDEST_CLASS}' END"


def _zone(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {a} AND {col} < {b} THEN {i}" for i, (a, b) in enumerate(K.ZONES)) + " END"


def _even(x: str, digits: int = 1) -> str:
    f = f"{10**digits}.0"
    return f"round_even(({x}) * {f}, 0) / {f}"


def _planck(w: float, t: str) -> str:
    x = f"least(greatest({K.PLANCK_H * K.LIGHT_C!r}::DOUBLE / ({w!r}::DOUBLE * {K.BOLTZMANN_K!r}::DOUBLE * ({t})), 0e0), 500e0)"
    return f"({2 * K.PLANCK_H * K.LIGHT_C**2!r}::DOUBLE / power({w!r}::DOUBLE, 5e0) / (exp({x}) - 1e0) * 1e-6::DOUBLE)"


PIX = f"px AS (SELECT {PIXEL_COLUMNS.replace('{div}', '//')} FROM events)"
ROI = f"roi AS (SELECT * FROM px WHERE solar_zenith > 100 AND latitude BETWEEN {K.CONUS[0]} AND {K.CONUS[1]} AND longitude BETWEEN {K.CONUS[2]} AND {K.CONUS[3]})"

DET = f"""ev AS (SELECT *, CASE WHEN user_id < 10 THEN user_id ELSE user_id * 16 + event_id % 16 END AS site FROM events),
d0 AS (SELECT ts AS datetime_utc, 27.5e0 + ((site * 7919) % 2150) / 100e0 + (event_id % 3) * 0.001e0 AS latitude,
  -111e0 + ((site * 104729) % 3500) / 100e0 + (event_id % 2) * 0.001e0 AS longitude,
  CAST(event_id // 1600 AS VARCHAR) AS granule, CAST((event_id % 1600) // 40 AS INT) AS "row", CAST(event_id % 40 AS INT) AS col,
  CASE WHEN event_id % 23 <> 0 THEN 450.5e0 + (event_id * 7919) % 1900 END AS temperature_K,
  CASE WHEN event_id % 23 <> 0 THEN value / 10e0 END AS radiant_heat_MW FROM ev),
det AS (SELECT *, radiant_heat_MW * 1e6 / ({K.STEFAN_BOLTZMANN}e0 * power(temperature_K, 4e0)) AS source_area_m2,
  {_class('temperature_K')} AS classification, {_basin('latitude', 'longitude')} AS basin, CAST(datetime_utc AS DATE) AS date,
  CAST(round_even(latitude / {K.SITE_STEP}e0, 0) AS BIGINT) AS site_lat_i, CAST(round_even(longitude / {K.SITE_STEP}e0, 0) AS BIGINT) AS site_lon_i FROM d0),
fil AS (SELECT * FROM det WHERE temperature_K BETWEEN 600 AND 2200 AND radiant_heat_MW BETWEEN 0.5 AND 20),
days AS (SELECT site_lat_i, site_lon_i, count(DISTINCT date) AS days_seen FROM fil GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT date) AS n_nights FROM fil),
per AS (SELECT fil.*, days_seen, n_nights, {_even('days_seen / greatest(n_nights, 1) * 100.0')} AS persistence FROM fil JOIN days USING (site_lat_i, site_lon_i), nn)"""
DET = DET.replace(f"{K.STEFAN_BOLTZMANN}e0", f"{K.STEFAN_BOLTZMANN!r}::DOUBLE")

FLARES = "count(*) FILTER (classification = 'gas_flare')"
VOL = f"{K.BCM_PER_MW}e0 * {K.MMSCF_PER_BCM}e0"


def _stats(src: str, band: str, out: str) -> str:
    """CTEs up to ``out``: granule_key, zone, mean, std, threshold, n_pixels."""
    ctes = [f"{out}_v AS (SELECT granule_key, {_zone('swath_col')} AS zone, {band} AS v FROM {src} WHERE {band} > 0)"]
    src_v = f"{out}_v"
    for k in range(K.CLIP_ROUNDS):
        ctes.append(
            f"{out}_{k} AS (SELECT * EXCLUDE (m, s) FROM (SELECT *, avg(v) OVER (PARTITION BY granule_key, zone) AS m, "
            f"stddev_pop(v) OVER (PARTITION BY granule_key, zone) AS s FROM {src_v}) WHERE s = 0 OR v < m + {K.CLIP_SIGMA} * s)"
        )
        src_v = f"{out}_{k}"
    ctes.append(
        f"{out} AS (SELECT granule_key, zone, avg(v) AS mean, stddev_pop(v) AS std, avg(v) + {K.HOT_SIGMA} * stddev_pop(v) AS threshold, "
        f"count(*) AS n_pixels FROM {src_v} WHERE zone IS NOT NULL GROUP BY 1, 2)"
    )
    return ",\n".join(ctes)


HOT = f"hot AS (SELECT px.*, z.zone FROM px JOIN z ON px.granule_key = z.granule_key AND {_zone('px.swath_col')} = z.zone AND px.M10 > z.threshold)"
BACK = f"""bgp AS (SELECT * FROM px WHERE M12 IS NOT NULL AND M13 IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM hot h WHERE h.granule_key = px.granule_key AND h."row" = px."row" AND h.col = px.col)),
bg AS (SELECT h.granule_key, h."row", h.col, count(*) AS n, avg(b.M12) AS a12, stddev_pop(b.M12) AS s12, avg(b.M13) AS a13
  FROM hot h JOIN bgp b ON b.granule_key = h.granule_key AND abs(b."row" - h."row") <= 5 AND abs(b.col - h.col) <= 5
  GROUP BY 1, 2, 3 HAVING count(*) >= {K.LEAST_BACKGROUND}),
back AS (SELECT h.granule_key, h."row", h.col, coalesce(n, 0) AS n_bg, a12 AS bg_m12, s12 AS sd_m12, a13 AS bg_m13,
  coalesce(h.M12 > a12 + {K.LOCAL_SIGMA} * s12, false) AS detected_M12
  FROM hot h LEFT JOIN bg ON bg.granule_key = h.granule_key AND bg."row" = h."row" AND bg.col = h.col)"""

#: Synthetic sources for the fits: true temperature, scaling factor, a small known error.
SOURCE_T = "(600e0 + (event_id * 37) % 1500)"
SOURCE_ESF = "((1 + event_id % 9) * 1e-6::DOUBLE)"
SOURCE_BANDS = ("M07", "M08", "M10", "M11")


def _source_obs(k: int, b: str) -> str:
    return f"{SOURCE_ESF} * {_planck(K.WAVELENGTHS[b], SOURCE_T)} * (1e0 + 0.01e0 * ((event_id * {k + 3}) % 7 - 3)) AS {b}"


def _grid_fit() -> str:
    obs = ", ".join(_source_obs(k, b) for k, b in enumerate(SOURCE_BANDS))
    r = {b: f"({_planck(K.WAVELENGTHS[b], 't')} / ({b} + 1e-20::DOUBLE))" for b in SOURCE_BANDS}
    r0 = {b: f"({b} / ({b} + 1e-20::DOUBLE))" for b in SOURCE_BANDS}
    rs = ", ".join(f"{r[b]} AS r_{b}, {r0[b]} AS o_{b}" for b in SOURCE_BANDS)
    top = " + ".join(f"o_{b} * r_{b}" for b in SOURCE_BANDS)
    square = " + ".join(f"r_{b} * r_{b}" for b in SOURCE_BANDS)
    cost = " + ".join(f"power(esf * r_{b} - o_{b}, 2e0)" for b in SOURCE_BANDS)
    return f"""WITH src AS (SELECT event_id, {obs} FROM events),
g AS (SELECT CAST(unnest(generate_series(400, 4000, 20)) AS DOUBLE) AS t),
m AS (SELECT event_id, t, {rs} FROM src, g),
e AS (SELECT *, least(greatest(({top}) / ({square}), 1e-15::DOUBLE), 1e0) AS esf FROM m),
c AS (SELECT event_id, t, esf, ({cost}) * 0.5e0 AS cost FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cost, t) AS k FROM c)
SELECT event_id, CAST(t AS INT) AS temperature_K, round(log10(esf), 6) AS log_esf FROM b WHERE k = 1"""


def _grid_detections(stats: str, hot: str) -> str:
    """Hot pixels of the region, their background, and the best of a grid of temperatures."""
    back = BACK.replace("FROM px WHERE M12", "FROM roi WHERE M12").replace("px.", "roi.")
    confirm = _stats("roi", "M11", "y")
    bands = ("M07", "M08", "M10", "M11", "M12", "M13")
    obs = [f"CASE WHEN {b} > 0 THEN {b} END AS o_{b}" for b in bands[:4]]
    obs += [f"CASE WHEN {b} > 0 AND bg_m12 IS NOT NULL AND {b} - bg_{b.lower()} > 0 THEN {b} - bg_{b.lower()} END AS o_{b}" for b in bands[4:]]
    r = {b: f"coalesce({_planck(K.WAVELENGTHS[b], 't')} / (o_{b} + 1e-20::DOUBLE), 0e0)" for b in bands}
    o = {b: f"coalesce(o_{b} / (o_{b} + 1e-20::DOUBLE), 0e0)" for b in bands}
    n = " + ".join(f"CASE WHEN o_{b} IS NULL THEN 0 ELSE 1 END" for b in bands)
    top = "greatest(" + ", ".join(f"o_{b}" for b in bands) + ")"
    start = "CASE " + " ".join(f"WHEN o_{b} = {top} THEN o_{b} / {_planck(K.WAVELENGTHS[b], '1800e0')}" for b in reversed(bands)) + " END"
    return f"""WITH {PIX}, {ROI}, {stats}, {hot}, {confirm}, {back},
f AS (SELECT h.granule_key, h."row", h.col, latitude, longitude, coalesce(M11 > y.threshold, false) AS detected_M11, b.detected_M12, {', '.join(obs)}
  FROM hot h JOIN back b ON b.granule_key = h.granule_key AND b."row" = h."row" AND b.col = h.col LEFT JOIN y ON y.granule_key = h.granule_key AND y.zone = h.zone),
u AS (SELECT *, {n} AS n, {start} AS start FROM f),
g AS (SELECT CAST(unnest(generate_series(400, 4000, 20)) AS DOUBLE) AS t),
m AS (SELECT granule_key, "row", col, t, {', '.join(f'{r[b]} AS r_{b}, {o[b]} AS q_{b}' for b in bands)} FROM u, g WHERE n >= 2 AND start <= 1),
e AS (SELECT *, least(greatest(({' + '.join(f'q_{b} * r_{b}' for b in bands)}) / ({' + '.join(f'r_{b} * r_{b}' for b in bands)}), 1e-15::DOUBLE), 1e0) AS esf FROM m),
c AS (SELECT granule_key, "row", col, t, esf, row_number() OVER (PARTITION BY granule_key, "row", col ORDER BY {' + '.join(f'power(esf * r_{b} - q_{b}, 2e0)' for b in bands)}, t) AS k FROM e)
SELECT u.granule_key, u."row", u.col, {_basin('latitude', 'longitude')} AS basin, CAST(t AS INT) AS temperature_K, round(log10(esf), 6) AS log_esf,
  {_class('t')} AS classification, detected_M11, detected_M12, CASE WHEN t IS NULL THEN 0 ELSE n END AS n_bands_used
FROM u LEFT JOIN c ON c.k = 1 AND c.granule_key = u.granule_key AND c."row" = u."row" AND c.col = u.col"""


NAMES = """nm AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'odd' || event_id
    ELSE 'VJ10' || (2 + event_id % 2) || 'MOD.A2024' || lpad(CAST(1 + (event_id // 2) % 366 AS VARCHAR), 3, '0') || '.' || lpad(CAST((event_id // 2) % 24 AS VARCHAR), 2, '0')
      || lpad(CAST(((event_id // 2) % 10) * 6 AS VARCHAR), 2, '0') || '.021.nc' END AS name FROM events),
files AS (SELECT event_id, 'data/' || CAST(event_id % 3 AS VARCHAR) || '/' || name AS path, name,
    CASE WHEN len(string_split(name, '.')) >= 3 THEN string_split(name, '.')[2] || '.' || string_split(name, '.')[3] END AS granule_key FROM nm),
pairs AS (SELECT r.granule_key, r.path AS rad_path, g.geo_path FROM files r
  JOIN (SELECT granule_key, max(path) AS geo_path FROM files WHERE name LIKE 'VJ103MOD%' GROUP BY 1) g ON r.granule_key = g.granule_key
  WHERE r.name LIKE 'VJ102MOD%')"""


def sql() -> dict[str, str]:
    with_px = f"WITH {PIX}"
    z = _stats("px", "M10", "z")
    q: dict[str, str] = {}
    q["zonal_stats"] = f"{with_px}, {z} SELECT granule_key, zone, round(mean, 8) AS mean, round(std, 6) AS std, round(threshold, 6) AS threshold, n_pixels FROM z"
    q["hot_pixels"] = f'{with_px}, {z}, {HOT} SELECT granule_key, "row", col, zone, M10 FROM hot'
    q["local_background"] = f'{with_px}, {z}, {HOT}, {BACK} SELECT granule_key, "row", col, n_bg, round(bg_m12, 8) AS bg_m12, round(sd_m12, 6) AS sd_m12, round(bg_m13, 8) AS bg_m13, detected_M12 FROM back'
    q["region_counts"] = f"{with_px}, {ROI} SELECT p.granule_key, p.n_pixels, coalesce(r.n, 0) AS n_region FROM (SELECT granule_key, count(*) AS n_pixels FROM px GROUP BY 1) p LEFT JOIN (SELECT granule_key, count(*) AS n FROM roi GROUP BY 1) r USING (granule_key)"
    left = {b: f"CASE WHEN {b} > 0 AND bg_{b.lower()} IS NOT NULL AND {b} - bg_{b.lower()} > 0 THEN {b} - bg_{b.lower()} END" for b in ("M12", "M13")}
    q["background_subtract"] = f"""{with_px}, {z}, {HOT}, {BACK}
SELECT h.granule_key, h."row", h.col, round({left['M12']}, 6) AS left_M12, round({left['M13']}, 6) AS left_M13,
  4 + CASE WHEN ({left['M12']}) IS NULL THEN 0 ELSE 1 END + CASE WHEN ({left['M13']}) IS NULL THEN 0 ELSE 1 END AS n_bands
FROM hot h JOIN back b ON b.granule_key = h.granule_key AND b."row" = h."row" AND b.col = h.col"""
    q["calibrate_mask"] = f"""WITH r AS (SELECT event_id, CAST(CASE WHEN event_id % 50 = 0 THEN 65535 WHEN event_id % 51 = 0 THEN 65528 ELSE (event_id * 131) % 65528 END AS INT) AS raw FROM events)
SELECT event_id, round(CASE WHEN raw < {K.VALID_MAX} + 1 AND raw <> {K.FILL_VALUE} AND raw * 0.01e0 - 20e0 > 0 THEN raw * 0.01e0 - 20e0 END, 6) AS radiance FROM r"""
    q["planck_forward"] = "WITH t AS (SELECT event_id, 450.5e0 + (event_id * 7919) % 1900 AS t FROM events) SELECT event_id, " + ", ".join(f"round(log10({_planck(K.WAVELENGTHS[b], 't')}), 6) AS log_{b}" for b in K.BANDS) + ", round(2.897771955e-3::DOUBLE / t * 1e9, 6) AS wien_nm FROM t"
    q["heat"] = f"WITH t AS (SELECT event_id, 450.5e0 + (event_id * 7919) % 1900 AS t, (1 + event_id % 97) * 1e-6::DOUBLE AS esf FROM events) SELECT event_id, round(esf * {K.PIXEL_AREA_M2}e0, 6) AS area_m2, round(esf * {K.PIXEL_AREA_M2}e0 * {K.STEFAN_BOLTZMANN!r}::DOUBLE * power(t, 4e0) / 1e6, 6) AS heat_mw FROM t"
    q["classify_source"] = f'WITH {DET} SELECT granule, "row", col, temperature_K, classification FROM det'
    q["classify_basin"] = f'WITH {DET} SELECT granule, "row", col, basin FROM det'
    q["backfill_basin"] = f'WITH {DET} SELECT granule, "row", col, CASE WHEN col % 3 = 0 THEN \'kept\' ELSE basin END AS basin FROM det'
    q["site_grid"] = f'WITH {DET} SELECT granule, "row", col, site_lat_i, site_lon_i FROM det'
    q["planck_fit_grid"] = _grid_fit()
    q["parse_filename"] = f"""WITH {NAMES} SELECT event_id, granule_key, CASE WHEN name LIKE 'VJ10%' THEN
  make_timestamp(2024, 1, 1, CAST(substr(name, 19, 2) AS BIGINT), CAST(substr(name, 21, 2) AS BIGINT), 0) + to_days(CAST(substr(name, 15, 3) AS INT) - 1) END AS datetime_utc FROM files"""
    q["granule_pairs"] = f"WITH {NAMES} SELECT granule_key, rad_path, geo_path FROM pairs"
    q["pending_pairs"] = f"WITH {NAMES} SELECT granule_key, rad_path, geo_path FROM pairs WHERE granule_key NOT IN (SELECT granule_key FROM files WHERE event_id % 5 = 0 AND granule_key IS NOT NULL)"
    q["filters"] = f"""WITH {DET} SELECT granule, "row", col, CAST(date AS VARCHAR) AS date, temperature_K, radiant_heat_MW FROM det WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND classification IN ('gas_flare', 'smoldering') AND temperature_K BETWEEN 500 AND 2000 AND radiant_heat_MW BETWEEN 0.5 AND 20 AND basin IN ('Permian', 'Bakken', 'Other')"""
    q["dashboard_defaults"] = f"WITH {DET} SELECT CAST(trunc(min(temperature_K)) AS INT) AS t_min, CAST(trunc(max(temperature_K)) AS INT) AS t_max, min(radiant_heat_MW) AS rh_min, least(max(radiant_heat_MW), 20e0) AS rh_max FROM det"
    q["site_persistence"] = f'WITH {DET} SELECT granule, "row", col, days_seen, persistence FROM per'
    q["persistence_filter"] = f"WITH {DET} SELECT count(*) AS n, count(DISTINCT site_lat_i * 100000 + site_lon_i) AS n_sites FROM per WHERE persistence BETWEEN 5 AND 50"
    q["kpis"] = f"WITH {DET} SELECT count(*) AS n_detections, {FLARES} AS n_flares, round(sum(radiant_heat_MW), 4) AS sum_rh, round(avg(temperature_K), 4) AS mean_t, round({VOL} * sum(radiant_heat_MW) / greatest(any_value(n_nights), 1), 2) AS avg_mmscfd FROM per WHERE persistence BETWEEN 5 AND 100"
    q["daily"] = f"WITH {DET} SELECT CAST(det.date AS VARCHAR) AS date, count(temperature_K) AS detections, {FLARES} AS flares, {_even('sum(radiant_heat_MW)')} AS total_rh, {_even('avg(temperature_K)')} AS mean_t FROM det GROUP BY det.date"
    q["basin_summary"] = f"WITH {DET} SELECT basin, count(temperature_K) AS detections, {_even('sum(radiant_heat_MW)')} AS total_rh, {_even('avg(temperature_K)')} AS mean_t FROM det GROUP BY basin"
    q["class_counts"] = f"WITH {DET} SELECT classification, count(*) AS n FROM det GROUP BY 1"
    q["daily_ts"] = f"WITH {DET} SELECT CAST(det.date AS VARCHAR) AS date, round(sum(radiant_heat_MW), 4) AS sum_rh, {FLARES} AS flares, round(avg(temperature_K), 4) AS mean_t FROM det GROUP BY det.date"
    for name, by in (("volume_daily", ""), ("volume_basin", ", basin"), ("volume_class", ", classification")):
        q[name] = f"WITH {DET} SELECT CAST(fil.date AS VARCHAR) AS date{by}, round(sum(radiant_heat_MW), 4) AS sum_rh, round({VOL} * sum(radiant_heat_MW), 2) AS mmscfd FROM fil GROUP BY fil.date{by}"
    q["volume_summary"] = f"""WITH {DET}, dd AS (SELECT date, sum(radiant_heat_MW) AS rh FROM per WHERE persistence BETWEEN 5 AND 100 GROUP BY 1),
w AS (SELECT coalesce(sum(rh), 0) AS rh, coalesce(max(rh), 0) AS peak FROM dd)
SELECT round({K.BCM_PER_MW}e0 * rh, 4) AS total_bcm, round({VOL} * rh / greatest(n_nights, 1), 2) AS avg_mmscfd, round({VOL} * peak, 2) AS peak_mmscfd,
  round(CASE WHEN n_nights > 1 THEN {VOL} * rh / greatest(n_nights, 1) * 365 / 1000 END, 2) AS annual_bscf FROM w, nn"""
    q["rh_p98"] = f"WITH {DET} SELECT round(greatest(coalesce(quantile_cont(radiant_heat_MW, 0.98), 1e0), 1e0), 6) AS p98 FROM det"
    ext = "min(latitude) AS a, max(latitude) AS b, avg(latitude) AS c, min(longitude) AS d, max(longitude) AS e, avg(longitude) AS f"
    q["extent_view"] = f"""WITH {DET}, x AS (SELECT {ext} FROM det) SELECT a AS min_latitude, b AS max_latitude, round(c, 6) AS mean_latitude, d AS min_longitude, e AS max_longitude, round(f, 6) AS mean_longitude,
  CASE WHEN greatest(b - a, e - d) < 3 THEN 7 WHEN greatest(b - a, e - d) < 8 THEN 6 WHEN greatest(b - a, e - d) < 15 THEN 5 ELSE 3 END AS zoom,
  round(greatest((b - a) * 0.08e0, 0.5e0), 6) AS pad_lat, round(greatest((e - d) * 0.08e0, 0.5e0), 6) AS pad_lon FROM x"""

    def hist(col: str, split: str = "", below: float | None = None) -> str:
        cond = f"{col} < {below}" if below is not None else f"{col} IS NOT NULL"
        return f"""WITH {DET}, v AS (SELECT {col} AS x{split} FROM det WHERE {cond}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS INT) AS bin{split}, count(*) AS n FROM v, e GROUP BY ALL"""

    q["hist_temp"] = hist("temperature_K", ", classification")
    q["hist_rh"] = hist("radiant_heat_MW", ", basin", 5)
    q["hist_area"] = hist("source_area_m2", "", 10)
    q["options"] = f"WITH {DET} SELECT DISTINCT basin FROM det"
    q["distinct_granules"] = f"WITH {DET} SELECT count(DISTINCT granule) AS n_granules FROM det"
    q["flare_ranges"] = f"WITH {DET} SELECT count(*) AS n_flares, min(temperature_K) AS t_min, max(temperature_K) AS t_max, min(radiant_heat_MW) AS rh_min, max(radiant_heat_MW) AS rh_max FROM det WHERE classification = 'gas_flare'"
    q["top_flares"] = f"""WITH {DET}, r AS (SELECT *, row_number() OVER (ORDER BY radiant_heat_MW DESC NULLS LAST, datetime_utc, granule, "row", col) AS rank FROM det)
SELECT CAST(rank AS INT) AS rank, datetime_utc, latitude, longitude, basin, classification, temperature_K, radiant_heat_MW, round(source_area_m2, 4) AS source_area_m2, granule, "row", col FROM r WHERE rank <= 25"""
    q["calendar_spine"] = f"""WITH {DET}, s AS (SELECT * FROM det), k AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT CAST(s.date AS VARCHAR) AS date, false AS placeholder, count(*) AS n, round(coalesce(sum(radiant_heat_MW), 0), 4) AS sum_rh FROM s GROUP BY s.date
UNION ALL SELECT CAST(date AS VARCHAR), true, 1, 0e0 FROM k WHERE date NOT IN (SELECT date FROM s)"""
    q["map_points"] = f"WITH {DET} SELECT latitude, longitude, temperature_K IS NOT NULL AS fitted, temperature_K, round(CASE WHEN temperature_K IS NOT NULL THEN least(greatest(radiant_heat_MW, 0.1e0), 50e0) * 10 END, 6) AS size_px FROM det"
    q["map_extent"] = f"WITH {DET} SELECT min(latitude) - 0.5e0 AS south, max(latitude) + 0.5e0 AS north, min(longitude) - 0.5e0 AS west, max(longitude) + 0.5e0 AS east FROM det"
    q["map_frames"] = f"""WITH {DET}, s AS (SELECT * FROM det), k AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM s),
p AS (SELECT greatest(quantile_cont(radiant_heat_MW, 0.98), 1e0) AS p98 FROM s WHERE radiant_heat_MW > 0),
z AS (SELECT date, latitude, longitude, least(greatest(radiant_heat_MW / p98, 0.02e0), 1e0) * 80 AS size_px FROM s, p WHERE radiant_heat_MW > 0)
SELECT CAST(k.date AS VARCHAR) AS date, latitude, longitude, round(size_px, 6) AS size_px FROM k LEFT JOIN z ON z.date = k.date"""
    # written out from the map format, not from the code's tables: red, orange and yellow as aabbggrr
    q["kml_rows"] = f"""WITH {DET}, r AS (SELECT *, printf('%.0f', round_even(temperature_K, 0)) AS t,
  printf('%.2f', round_even(radiant_heat_MW * 100e0, 0) / 100e0) AS h, printf('%.1f', round_even(source_area_m2 * 10e0, 0) / 10e0) AS a FROM det WHERE temperature_K IS NOT NULL)
SELECT t || 'K, ' || h || 'MW' AS name,
  'Temperature: ' || t || ' K' || chr(10) || 'Radiant Heat: ' || h || ' MW' || chr(10) || 'Source Area: ' || a || ' m²' || chr(10) || 'Classification: ' || classification || chr(10) AS description,
  CASE classification WHEN 'gas_flare' THEN 'ff0000ff' WHEN 'biomass_burning' THEN 'ff00a5ff' ELSE 'ff00ffff' END AS colour, longitude, latitude FROM r"""
    roi_z = _stats("roi", "M10", "z")
    roi_hot = HOT.replace("SELECT px.*", "SELECT roi.*").replace("FROM px JOIN", "FROM roi JOIN").replace("px.", "roi.")
    q["granule_counts"] = f"""{with_px}, {ROI}, {roi_z}, {roi_hot}
SELECT p.granule_key, p.n_pixels, coalesce(r.n, 0) AS n_region, coalesce(h.n, 0) AS n_hot FROM (SELECT granule_key, count(*) AS n_pixels FROM px GROUP BY 1) p
  LEFT JOIN (SELECT granule_key, count(*) AS n FROM roi GROUP BY 1) r USING (granule_key) LEFT JOIN (SELECT granule_key, count(*) AS n FROM hot GROUP BY 1) h USING (granule_key)"""
    q["detections_grid"] = _grid_detections(roi_z, roi_hot)
    q["calibrated_scan"] = """WITH p AS (SELECT event_id AS e, event_id // 1600 AS granule_key, CAST((event_id % 1600) // 40 AS INT) AS "row", CAST(event_id % 40 AS INT) AS col FROM events),
r AS (SELECT *, CASE WHEN e % 50 = 0 THEN 65535 WHEN e % 51 = 0 THEN 65530 ELSE (e * 131) % 65528 END AS a, CASE WHEN e % 49 = 0 THEN 60000 ELSE (e * 37) % 65000 END AS b FROM p),
v AS (SELECT *, a * ((granule_key % 7 + 1) * 0.01e0) + (-20e0 - granule_key % 3) AS x, b * ((granule_key % 5 + 1) * 0.002e0) - 1e0 AS y FROM r)
SELECT granule_key, "row", col, round(CASE WHEN a < 65528 AND a <> 65535 AND x > 0 THEN x END, 6) AS M10, round(CASE WHEN b < 64001 AND b <> 60000 AND y > 0 THEN y END, 6) AS M11 FROM v"""
    q["site_keys"] = f"""WITH {DET} SELECT granule, "row", col, CAST(hour(datetime_utc) AS INT) AS hour_utc,
  CAST(CAST(round_even(latitude / 0.0075e0, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round_even(longitude / 0.0075e0, 0) AS BIGINT) AS VARCHAR) AS site FROM det"""
    q["append_align"] = f'WITH {DET} SELECT granule, "row", col, temperature_K, NULL::VARCHAR AS detected_M12 FROM det WHERE col % 2 = 0 UNION ALL SELECT granule, "row", col, NULL, CAST(radiant_heat_MW > 5 AS VARCHAR) FROM det WHERE col % 2 = 1'
    return q
