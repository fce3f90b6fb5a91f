"""Queries run over their whole tables, and the flagship's fits beside a fine grid in SQL."""

import duckdb
import numpy as np
import pytest
from test_queries import SF

from emberscan.functions import constants as K
from emberscan.operators import fit
from emberscan.plans import oracle, registry

BANDS = oracle.SOURCE_BANDS


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    return c


def test_no_query_takes_a_part_of_its_table(spark, con):
    n = con.execute("select count(*) from events").fetchone()[0]
    fitted = con.execute("select count(*) from events where event_id % 23 <> 0").fetchone()[0]
    q = registry.queries()
    assert q["planck_fit"](spark, SF).count() == q["planck_fit_grid"](spark, SF).count() == n
    assert q["kml_rows"](spark, SF).count() == fitted == sum(r.n for r in q["hist_temp"](spark, SF).collect())
    assert q["map_frames"](spark, SF).filter("latitude is not null").count() == fitted


def fine_grid(con, rows: str, bands, step: float = 1.0) -> dict:
    """Least squares over a fine grid of temperatures in SQL written for this test alone: id -> (t, cost)."""
    h, c, k = 6.62607015e-34, 2.99792458e8, 1.380649e-23
    wave = {"M07": 0.865e-6, "M08": 1.24e-6, "M10": 1.61e-6, "M11": 2.25e-6, "M12": 3.7e-6, "M13": 4.05e-6}
    b = {x: f"({2 * h * c * c / wave[x] ** 5 * 1e-6!r}::DOUBLE / (exp({h * c / (wave[x] * k)!r}::DOUBLE / t) - 1e0))" for x in bands}
    num = " + ".join(f"coalesce({b[x]} / {x}, 0e0)" for x in bands)
    den = " + ".join(f"coalesce(power({b[x]} / {x}, 2e0), 0e0)" for x in bands)
    cost = " + ".join(f"coalesce(power(esf * {b[x]} / {x} - 1e0, 2e0), 0e0)" for x in bands)
    sql = f"""with r as ({rows}), g as (select cast(unnest(generate_series(0, {int(3600 / step)})) as double) * {step} + 400 as t),
    e as (select *, least(greatest(({num}) / ({den}), 1e-15), 1e0) as esf from r, g), f as (select id, t, 0.5e0 * ({cost}) as cost from e)
    select id, arg_min(t, cost), min(cost) from f group by id"""
    return {i: (t, v) for i, t, v in con.execute(sql).fetchall()}


def test_planck_fit_beside_a_fine_grid(spark, con):
    got = registry.queries()["planck_fit"](spark, SF).toPandas()
    obs = ", ".join(oracle._source_obs(j, b) for j, b in enumerate(BANDS))
    want = fine_grid(con, f"select event_id as id, {obs} from events", BANDS)
    assert set(want) == set(got["event_id"]) and got["success"].all()
    for r in got.itertuples():
        t, cost = want[r.event_id]
        assert r.cost <= cost + 1e-9 and abs(r.temperature_K - t) <= 1.0


def test_detections_beside_a_fine_grid(spark, con):
    got = registry.queries()["detections"](spark, SF).toPandas()
    sql = registry.oracle_sql()["detections_grid"]
    names = [*K.SWIR_BANDS, *K.MWIR_BANDS]
    rows = sql[: sql.index("u AS (SELECT")].rstrip().rstrip(",") + f' SELECT granule_key * 1600 + "row" * 40 + col AS id, {", ".join(f"o_{b} AS {b}" for b in names)} FROM f'
    want = fine_grid(con, rows, names)
    ok = got[got["classification"] != "fit_failed"]
    assert len(ok) and set(want) >= {int(r.granule) * 1600 + r.row * 40 + r.col for r in ok.itertuples()}
    for r in ok.itertuples():
        t, cost = want[int(r.granule) * 1600 + r.row * 40 + r.col]
        assert r.fit_cost <= cost + 1e-9 and (abs(r.temperature_K - t) <= 1.0 or abs(r.fit_cost - cost) < 1e-6)


def test_residuals_are_model_less_observed():
    obs = {"M10": 2.0, "M11": 1.0}
    got = fit._fit_rows([[{"band": b, "obs": v} for b, v in obs.items()]])[0]
    for b, v in obs.items():
        model = got["esf"] * float(fit.planck(np.array(K.WAVELENGTHS[b]), np.array(got["temperature_K"])))
        assert got["residuals"][b] == pytest.approx(model - v)
