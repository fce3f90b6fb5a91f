"""Planck fits: temperature and emission scaling factor of each source.

For a fixed temperature the best scaling factor is a closed form, so the two
parameter problem is a search over temperature alone: a grid of 20 K, then golden
section within the bracket.  This finds the global minimum of the relative least
squares; a local solver started at 1800 K can stop in a worse one.

``planck_fit`` runs as an Arrow-batched function over arrays; ``grid_fit`` is the
grid alone, as one Catalyst expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

FIT_TYPE = (
    "struct<temperature_K:double,esf:double,source_area_m2:double,radiant_heat_MW:double,"
    "radiant_heat_intensity_W_m2:double,cost:double,residuals:map<string,double>,bands_used:array<string>,success:boolean,error:string>"
)
GRID_STEP, TINY = 20.0, 1e-20


def planck(w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Radiance per micrometre."""
    x = np.clip(K.PLANCK_H * K.LIGHT_C / (w * K.BOLTZMANN_K * t), 0, 500)
    with np.errstate(divide="ignore", over="ignore"):
        return 2e-6 * K.PLANCK_H * K.LIGHT_C**2 / w**5 / np.expm1(x)


def _profile(wave, inv, r0, t):
    """(cost, esf) at a temperature for each row; ``inv`` and ``r0`` are 0 where a band is missing."""
    r = planck(wave, t[:, None]) * inv
    esf = np.clip((r0 * r).sum(axis=1) / np.maximum((r * r).sum(axis=1), 1e-300), *K.FIT_ESF)
    res = esf[:, None] * r - r0
    return 0.5 * (res * res).sum(axis=1), esf


def fit_arrays(wave: np.ndarray, obs: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(temperature, esf, cost) of each row of (rows, bands) radiances.

    The grid's radiances are the same for all rows, so its costs are matrix
    products; the bracket around its best is searched by golden section.
    """
    used = ok.any(axis=0)
    wave, obs, ok = wave[used], obs[:, used], ok[:, used]
    inv, r0 = (np.where(ok, v / (obs + TINY), 0.0) for v in (1.0, obs))
    grid = np.arange(K.FIT_T[0], K.FIT_T[1] + 1, GRID_STEP)
    table = planck(wave[:, None], grid[None, :])
    both, square = (r0 * inv) @ table, (inv * inv) @ (table * table)
    esf = np.clip(both / np.maximum(square, 1e-300), *K.FIT_ESF)
    best = grid[(esf * (esf * square - 2 * both)).argmin(axis=1)]
    a, b = np.maximum(best - GRID_STEP, K.FIT_T[0]), np.minimum(best + GRID_STEP, K.FIT_T[1])
    g = (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    at_c, at_d = (_profile(wave, inv, r0, x)[0] for x in (c, d))
    for _ in range(40):
        left = at_c <= at_d
        a, b = np.where(left, a, c), np.where(left, d, b)
        new = np.where(left, b - g * (b - a), a + g * (b - a))
        at = _profile(wave, inv, r0, new)[0]
        c, d = np.where(left, new, d), np.where(left, c, new)
        at_c, at_d = np.where(left, at, at_d), np.where(left, at_c, at)
    t = (a + b) / 2
    cost, esf = _profile(wave, inv, r0, t)
    return t, esf, cost


#: What a fit can come to; the place in the list is its code.
ERRORS = (None, "fewer than two usable bands", "start outside the bounds")


def fit_matrix(obs: np.ndarray) -> dict[str, np.ndarray]:
    """Fits of a (rows, ``K.BANDS``) matrix of radiances; what is not positive and finite is no band.

    Returns temperature, esf, cost, code (of ``ERRORS``) and the residuals model - observed.
    """
    ok = np.isfinite(obs) & (obs > 0)
    clean = np.where(ok, obs, 1.0)
    wave = np.array([K.WAVELENGTHS[b] for b in K.BANDS])
    t, esf, cost = fit_arrays(wave, clean, ok)
    brightest = np.where(ok, obs, -np.inf).argmax(axis=1)
    rows = np.arange(len(obs))
    start = clean[rows, brightest] / planck(wave[brightest], np.full(len(obs), K.FIT_START_T))
    code = np.where(ok.sum(axis=1) < 2, 1, np.where(start > K.FIT_ESF[1], 2, 0))
    with np.errstate(invalid="ignore"):
        residual = np.where(ok, esf[:, None] * planck(wave, t[:, None]) - obs, np.nan)
    return {"t": t, "esf": esf, "cost": cost, "code": code, "residual": residual}


def _fit_rows(rows: list) -> list[dict]:
    """Fits of lists of (band, obs), as rows of the result."""
    obs = np.full((len(rows), len(K.BANDS)), np.nan)
    for i, r in enumerate(rows):
        for x in r or []:
            if x["obs"] is not None:
                obs[i, K.BANDS.index(x["band"])] = x["obs"]
    got, out = fit_matrix(obs), []
    for i in range(len(rows)):
        used = [j for j in range(len(K.BANDS)) if np.isfinite(obs[i, j]) and obs[i, j] > 0]
        names = [K.BANDS[j] for j in used]
        if got["code"][i]:
            out.append({"success": False, "bands_used": names, "error": ERRORS[got["code"][i]]})
            continue
        heat = K.STEFAN_BOLTZMANN * got["t"][i] ** 4
        area = got["esf"][i] * K.PIXEL_AREA_M2
        out.append(
            {
                "temperature_K": got["t"][i], "esf": got["esf"][i], "source_area_m2": area, "radiant_heat_MW": area * heat / 1e6,
                "radiant_heat_intensity_W_m2": heat, "cost": got["cost"][i],
                "residuals": {n: float(got["residual"][i, j]) for n, j in zip(names, used)}, "bands_used": names, "success": True, "error": None,
            }
        )
    return out


def planck_fit(bands: Column) -> Column:
    """array<struct<band, w, obs>> -> fit struct; ``success`` false with an error if it cannot be done.

    Python gets one column of radiances for each band and gives numbers back; names,
    maps and what follows from temperature and scaling factor are put together in the JVM.
    """
    numbers = ", ".join(f"r_{b}:double" for b in K.BANDS)

    @F.pandas_udf(f"struct<t:double,esf:double,cost:double,code:int,{numbers}>")
    def run(*series: pd.Series) -> pd.DataFrame:
        got = fit_matrix(np.column_stack([s.to_numpy(np.float64, na_value=np.nan) for s in series]))
        out = {k: got[k] for k in ("t", "esf", "cost")} | {"code": got["code"].astype(np.int32)}
        return pd.DataFrame(out | {f"r_{b}": got["residual"][:, j] for j, b in enumerate(K.BANDS)})

    def obs(b: str) -> Column:
        return F.get(F.filter(bands, lambda x: x["band"] == b), F.lit(0))["obs"].cast("double")

    def whole(f: Column) -> Column:
        ok = f["code"] == 0
        heat, area = C.exitance(f["t"]), C.source_area(f["esf"])
        left = F.filter(
            F.array(*[F.struct(F.lit(b).alias("band"), f[f"r_{b}"].alias("r"), obs(b).alias("o")) for b in K.BANDS]),
            lambda x: (x["o"] > 0) & (x["o"] < float("inf")),
        )
        when = lambda c: F.when(ok, c)
        return F.struct(
            when(f["t"]).alias("temperature_K"), when(f["esf"]).alias("esf"), when(area).alias("source_area_m2"),
            when(area * heat / 1e6).alias("radiant_heat_MW"), when(heat).alias("radiant_heat_intensity_W_m2"), when(f["cost"]).alias("cost"),
            when(F.map_from_entries(F.transform(left, lambda x: F.struct(x["band"], x["r"])))).alias("residuals"),
            F.transform(left, lambda x: x["band"]).alias("bands_used"), ok.alias("success"),
            F.when(f["code"] == 1, ERRORS[1]).when(f["code"] == 2, ERRORS[2]).alias("error"),
        )

    return F.transform(F.array(run(*[obs(b) for b in K.BANDS])), whole)[0]


def can_fit(obs: dict[str, Column]) -> Column:
    """Two bands at least, and a start within the bounds."""
    ok = {b: F.coalesce((o > 0) & (o < float("inf")), F.lit(False)) for b, o in obs.items()}
    n = None
    for v in ok.values():
        n = v.cast("int") if n is None else n + v.cast("int")
    start = F.array(*[F.struct(F.when(ok[b], o).alias("o"), (o / F.lit(float(planck(np.array(K.WAVELENGTHS[b]), np.array(K.FIT_START_T))))).alias("s")) for b, o in obs.items()])
    return (n >= 2) & (F.array_max(F.filter(start, lambda x: x["o"].isNotNull()))["s"] <= K.FIT_ESF[1])


def grid_fit(bands: dict[str, Column], step: int = 20) -> Column:
    """struct<cost, t, esf> of the best grid temperature, without leaving the JVM.

    The radiances of the grid do not depend on a row: they are one constant array,
    which leaves a few multiplications for each temperature.
    """
    temperatures = np.arange(K.FIT_T[0], K.FIT_T[1] + 1, step)
    table = F.array(
        *[
            F.struct(F.lit(float(t)).alias("t"), *[F.lit(float(planck(np.array(K.WAVELENGTHS[b]), np.array(t)))).alias(b) for b in bands])
            for t in temperatures
        ]
    )

    def total(terms: list[Column]) -> Column:
        out = terms[0]
        for x in terms[1:]:
            out = out + x
        return out

    def best(k: Column) -> Column:
        def at(x: Column) -> Column:
            r = {b: x[b] * k[f"i_{b}"] for b in bands}
            esf = total([k[f"r_{b}"] * r[b] for b in bands]) / total([r[b] * r[b] for b in bands])
            esf = F.least(F.greatest(esf, F.lit(K.FIT_ESF[0])), F.lit(K.FIT_ESF[1]))
            return F.struct(x["t"].alias("t"), esf.alias("esf"), *[r[b].alias(b) for b in bands])

        def cost(x: Column) -> Column:
            res = [x["esf"] * x[b] - k[f"r_{b}"] for b in bands]
            return F.struct((total([v * v for v in res]) * 0.5).alias("cost"), x["t"].alias("t"), x["esf"].alias("esf"))

        return F.array_min(F.transform(F.transform(table, at), cost))

    # what depends on the row alone is worked out once; a band that is missing adds nothing
    known = [F.coalesce(v / (o + TINY), F.lit(0.0)).alias(f"{n}_{b}") for b, o in bands.items() for n, v in (("i", F.lit(1.0)), ("r", o))]
    return F.transform(F.array(F.struct(*known)), best)[0]


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores: a fit costs far more than moving its few numbers, and small files make few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_fit(candidates: DataFrame) -> DataFrame:
    """Fit columns, class and number of bands beside each row with ``fit_bands``."""
    df = spread(candidates).withColumn("fit", planck_fit(F.col("fit_bands")))
    ok = F.col("fit.success")
    t = F.when(ok, F.col("fit.temperature_K"))
    return df.select(
        *[c for c in candidates.columns if c != "fit_bands"],
        t.alias("temperature_K"),
        *[F.when(ok, F.col(f"fit.{c}")).alias(c) for c in ("esf", "source_area_m2", "radiant_heat_MW")],
        F.when(ok, F.col("fit.cost")).alias("fit_cost"),
        C.source_class(t).alias("classification"),
        F.when(ok, F.size("fit.bands_used")).otherwise(0).alias("n_bands_used"),
    )
