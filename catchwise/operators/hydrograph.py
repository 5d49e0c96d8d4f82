"""Synthetic unit hydrographs of every catchment with all methods in one pass.

One row per catchment becomes one row per (catchment, method) and then one row
per ordinate.  Ordinates, volume and normalisation are computed on the row's own
arrays, so no shuffle happens at any point.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.functions.numeric import finite

# Dimensionless curvilinear ordinates t/Tp and q/Qp (fixed values)
SCS_T = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.8, 2.0, 2.2,
         2.4, 2.6, 2.8, 3.0, 3.5, 4.0, 4.5, 5.0)
SCS_Q = (0.000, 0.015, 0.075, 0.160, 0.280, 0.430, 0.600, 0.770, 0.890, 0.970, 1.000, 0.980, 0.920, 0.840, 0.750,
         0.660, 0.560, 0.420, 0.320, 0.240, 0.180, 0.130, 0.098, 0.075, 0.036, 0.018, 0.009, 0.004)

METHODS = ("scs", "nakayasu", "snyder_alexeyev", "gama1", "limantara", "itb1b", "itb2b")

# Default parameters and their admitted ranges: default, low, high (fixed values)
PARAMETERS = {
    "scs": {"Ct": (1.0, 0.05, 10.0)},
    "nakayasu": {"alpha": (2.0, 0.2, 10.0)},
    "snyder_alexeyev": {"Ct": (1.0, 0.05, 10.0), "Cp": (1.0, 0.05, 5.0)},
    "gama1": {},
    "limantara": {"n": (0.05, 0.005, 0.5)},
    "itb1b": {"Ct": (1.0, 0.05, 10.0), "Cp": (1.0, 0.05, 5.0), "alpha": (3.7, 0.1, 20.0), "k": (10.0, 5.0, 20.0)},
    "itb2b": {"Ct": (1.0, 0.05, 10.0), "Cp": (1.0, 0.05, 5.0), "alpha": (1.7, 0.1, 20.0), "beta": (0.84, 0.05, 10.0),
              "k": (10.0, 5.0, 20.0)},
}

REQUIRED = {
    "scs": ("A", "L", "Lc"), "nakayasu": ("A", "L"), "snyder_alexeyev": ("A", "L", "Lc"),
    "gama1": ("A", "L", "S", "D", "JN", "SF", "SN", "WF", "RUA", "SIM"),
    "limantara": ("A", "L", "Lc", "S"), "itb1b": ("A", "L"), "itb2b": ("A", "L"),
}

INPUTS = ("A", "L", "Lc", "S", "Lt", "L1", "N", "N1", "WU", "WL", "AU", "D", "JN", "SF", "SN", "WF", "RUA", "SIM")


def lngamma_sql(x: str) -> str:
    """ln of the gamma function for x > 0 as SQL: argument raised by 8, then Stirling's series."""
    z = f"({x} + 8)"
    product = " * ".join(f"({x} + {i})" for i in range(8))
    series = f"1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7))"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ln({product}))"


# --- inputs ---------------------------------------------------------------------------

def resolve_inputs(df: DataFrame) -> DataFrame:
    """Choose L, Lc and S: main river when it is valid, otherwise the flow path.

    Expects ``point_id, area_km2, main_length_km, main_lc_km, main_slope_pct,
    flow_length_km, flow_lc_km, flow_slope_pct`` and the Gama-I measurements.
    """
    pos = {c: finite(F.col(c), positive=True) for c in (
        "area_km2", "main_length_km", "main_lc_km", "main_slope_pct", "flow_length_km", "flow_lc_km", "flow_slope_pct")}
    ml, mc, ms = pos["main_length_km"], pos["main_lc_km"], pos["main_slope_pct"]
    fl, fc, fs = pos["flow_length_km"], pos["flow_lc_km"], pos["flow_slope_pct"]
    limit = ml * 1.001
    valid = ml.isNotNull() & F.when(mc.isNotNull(), mc <= limit).otherwise(fc.isNull() | (fc <= limit))
    gama = {"Lt": "total_stream_length_km", "N": "stream_count", "WU": "width_upstream_km", "WL": "width_lower_km",
            "AU": "upstream_area_km2", "D": "drainage_density", "JN": "junction_count", "SF": "source_factor",
            "SN": "source_frequency", "WF": "width_factor", "RUA": "relative_upstream_area", "SIM": "symmetry_factor"}
    return df.select(
        "point_id",
        pos["area_km2"].alias("A"),
        F.when(valid, ml).otherwise(F.coalesce(fl, ml)).alias("L"),
        F.when(valid, F.coalesce(mc, fc)).otherwise(F.coalesce(fc, mc)).alias("Lc"),
        (F.when(valid, ms).otherwise(F.coalesce(fs, ms)) / 100.0).alias("S"),
        finite(F.col("source_stream_length_km")).alias("L1"),
        finite(F.col("source_stream_count")).alias("N1"),
        *[finite(F.col(c), positive=True).alias(k) for k, c in gama.items()],
    ).select("point_id", *INPUTS)


def apply_overrides(inputs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Replace source measurements by edited ones and derive the ratios again.

    ``overrides``: ``point_id`` and any of ``A L Lc S_pct Lt L1 N N1 JN WU WL AU``;
    values below the lower bound are ignored; ratios are never taken from the editor.
    """
    low = {"A": 1e-9, "L": 1e-9, "Lc": 1e-9, "S_pct": 1e-9, "Lt": 1e-9, "L1": 0.0, "N": 1.0, "N1": 0.0,
           "JN": 1e-9, "WU": 1e-9, "WL": 1e-9, "AU": 1e-9}
    df = inputs
    if overrides is not None:
        given = [c for c in low if c in overrides.columns]
        clean = overrides.select("point_id", *[
            F.when(finite(F.col(c)) >= low[c], F.col(c).cast("double")).alias(f"_{c}") for c in given])
        df = inputs.join(clean, "point_id", "left")
        for c in given:
            target, value = ("S", F.col("_S_pct") / 100.0) if c == "S_pct" else (c, F.col(f"_{c}"))
            df = df.withColumn(target, F.coalesce(value, F.col(target)))
    pos = {c: finite(F.col(c), positive=True) for c in ("A", "Lt", "N", "WU", "WL", "AU")}
    wf = pos["WU"] / pos["WL"]
    rua = pos["AU"] / pos["A"]
    df = df.select(
        "point_id", *[c for c in INPUTS if c not in ("D", "SF", "SN", "WF", "RUA", "SIM")], "SIM",
        F.coalesce(pos["Lt"] / pos["A"], F.col("D")).alias("D"),
        F.coalesce(finite(F.col("L1")) / pos["Lt"], F.col("SF")).alias("SF"),
        F.coalesce(finite(F.col("N1")) / pos["N"], F.col("SN")).alias("SN"),
        F.coalesce(wf, F.col("WF")).alias("WF"),
        F.coalesce(rua, F.col("RUA")).alias("RUA"),
        (wf.isNotNull() | rua.isNotNull()).alias("_redo"),
    )
    both = finite(F.col("WF"), positive=True) * finite(F.col("RUA"), positive=True)
    return df.withColumn("SIM", F.when(F.col("_redo"), F.coalesce(both, F.col("SIM"))).otherwise(F.col("SIM"))).select(
        "point_id", *INPUTS)


# --- method parameters: peak time, peak flow, base time, break points, shape -----------------
# Expressions are SQL text: one parsed string per method instead of hundreds of Column calls.

def _clamped(method: str, given: dict | None) -> dict[str, float]:
    out = {}
    for name, (default, lo, hi) in PARAMETERS[method].items():
        try:
            value = float((given or {}).get(name))
        except (TypeError, ValueError):
            value = default
        out[name] = min(hi, max(lo, value if math.isfinite(value) else default))
    return out


_TG = "(CASE WHEN L >= 15 THEN 0.5279D + 0.058D * L ELSE 0.21D * pow(L, 0.7D) END)"


def _method_fields(method: str, tr: float, given: dict | None) -> dict[str, str]:
    p = {k: f"{v!r}D" for k, v in _clamped(method, given).items()}
    r = f"{tr!r}D"
    f = dict.fromkeys(("lag_hours", "e1", "e2", "e3", "s1", "s2", "s3"), "NULL")
    f["dt_hours"] = r
    if method == "scs":
        lag = f"({p['Ct']} * pow(L * Lc, 0.3D))"
        tp = f"({lag} + 0.5D * {r})"
        f |= {"lag_hours": lag, "tp": tp, "qp": f"0.2083D * A / {tp}", "tb": f"5 * {tp}", "e1": tp}
    elif method == "nakayasu":
        tp, t03 = f"({_TG} + 0.8D * {r})", f"({p['alpha']} * {_TG})"
        f |= {"tp": tp, "qp": f"A / (3.6D * (0.3D * {tp} + {t03}))", "tb": f"{tp} + 8.5D * {t03}", "e1": tp, "e2": f"{tp} + {t03}", "e3": f"{tp} + 2.5D * {t03}", "s1": t03}
    elif method == "snyder_alexeyev":
        lag = f"({p['Ct']} * pow(L * Lc, 0.3D))"
        tp = f"greatest(0.05D, CASE WHEN {lag} / 5.5D > {r} THEN {lag} + 0.25D * ({r} - {lag} / 5.5D) ELSE {lag} + 0.5D * {r} END)"
        # peak flow times peak time over the unit volume does not depend on either of them
        lam = f"(0.275D * {p['Cp']} * 3.6D)"
        f |= {"lag_hours": lag, "tp": tp, "qp": f"0.275D * {p['Cp']} * A / {tp}", "tb": f"10 * {tp}", "e1": tp, "s1": f"1.32D * {lam} * {lam} + 0.15D * {lam} + 0.045D", "s2": lam}
    elif method == "gama1":
        tp = "(0.43D * pow(L / (100 * SF), 3) + 1.0665D * SIM + 1.2775D)"
        tb = f"greatest(27.4132D * pow({tp}, 0.1457D) * pow(S, -0.0986D) * pow(SN, 0.7344D) * pow(RUA, 0.2574D), {tp} + 0.05D)"
        tail = f"greatest({tp}, {tb} - 1)"
        f |= {"dt_hours": "1.0D", "tp": tp, "qp": f"0.1836D * pow(A, 0.5886D) * pow(JN, 0.2381D) * pow({tp}, -0.4008D)", "tb": tb, "e1": tp, "e2": tail,
              "s1": "0.5617D * pow(A, 0.1798D) * pow(S, -0.1446D) * pow(SF, -1.0897D) * pow(D, 0.0452D)", "s2": tail}
    elif method == "limantara":
        tp = f"({_TG} + 0.8D * {r})"
        f |= {"tp": tp, "qp": f"0.042D * pow(A, 0.451D) * pow(L, 0.497D) * pow(Lc, 0.356D) * pow(S, -0.131D) * pow({p['n']}, 0.168D)", "tb": f"{tp} + 3 / 0.175D", "e1": tp}
    elif method == "itb1b":
        lag, m = f"({p['Ct']} * 0.81225D * pow(L, 0.6D))", f"({p['alpha']} * {p['Cp']})"
        tp = f"({lag} + 0.5D * {r})"
        area = f"exp({m} + {lngamma_sql(f'({m} + 1)')} - ({m} + 1) * ln({m}))"
        f |= {"lag_hours": lag, "tp": tp, "qp": f"A / (3.6D * {area} * {tp})", "tb": f"{p['k']} * {tp}", "e1": tp, "s1": m, "s2": area}
    else:
        lag, nb = f"({p['Ct']} * (0.0394D * L + 0.201D * sqrt(L)))", f"({p['beta']} * {p['Cp']})"
        tp = f"({lag} + 0.5D * {r})"
        area = f"(1 / ({p['alpha']} + 1) + 1 / {nb})"
        f |= {"lag_hours": lag, "tp": tp, "qp": f"A / (3.6D * {area} * {tp})", "tb": f"{p['k']} * {tp}", "e1": tp, "s1": p["alpha"], "s2": nb, "s3": area}
    return f


def _method_struct(method: str, tr: float, given: dict | None) -> str:
    fields = _method_fields(method, tr, given)
    need = REQUIRED[method]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in need)
    missing = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in need)
    parts = [f"'method', '{method}'", f"'missing', array_compact(array({missing}))", f"'dt_hours', {fields['dt_hours']}"]
    for name in ("tp", "qp", "tb", "e1", "e2", "e3", "s1", "s2", "s3", "lag_hours"):
        parts.append(f"'{name}', CASE WHEN {ok} THEN CAST({fields[name]} AS DOUBLE) END")
    return f"named_struct({', '.join(parts)})"


def _flow_sql(t: str) -> str:
    """Discharge at time ``t`` for the row's method."""
    x = f"({t} / tp)"
    scs = " ".join(f"WHEN {x} <= {SCS_T[i]}D THEN {SCS_Q[i - 1]}D + ({x} - {SCS_T[i - 1]}D) * {(SCS_Q[i] - SCS_Q[i - 1]) / (SCS_T[i] - SCS_T[i - 1])!r}D" for i in range(1, len(SCS_T)))
    tail = "(CASE WHEN s2 > tp THEN exp(-(s2 - tp) / s1) ELSE 1 END)"
    ratio = f"""CASE method
      WHEN 'scs' THEN CASE {scs} ELSE 0 END
      WHEN 'nakayasu' THEN CASE WHEN {t} <= tp THEN pow({x}, 2.4D) WHEN {t} <= tp + s1 THEN pow(0.3D, ({t} - tp) / s1)
        WHEN {t} <= tp + 2.5D * s1 THEN pow(0.3D, ({t} - tp + 0.5D * s1) / (1.5D * s1)) ELSE pow(0.3D, ({t} - tp + 1.5D * s1) / (2 * s1)) END
      WHEN 'snyder_alexeyev' THEN CASE WHEN {x} > 0 THEN pow(10.0D, -s1 * (1 - {x}) * (1 - {x}) / {x}) ELSE 0 END
      WHEN 'gama1' THEN CASE WHEN {t} >= s2 THEN {tail} * greatest(0D, least(1D, (tb - {t}) / greatest(tb - s2, 1e-9D))) WHEN {t} <= tp THEN {x} ELSE exp(-({t} - tp) / s1) END
      WHEN 'limantara' THEN CASE WHEN {t} <= tp THEN pow({x}, 1.107D) ELSE pow(10.0D, 0.175D * (tp - {t})) END
      WHEN 'itb1b' THEN pow({x} * exp(1 - {x}), s1)
      ELSE CASE WHEN {x} <= 1 THEN pow({x}, s1) ELSE exp((1 - {x}) * s2) END END"""
    return f"CAST(qp * {ratio} AS DOUBLE)"


def time_grid_sql(end: str, step: str, extras: list[str]) -> str:
    """0..end by ``step`` joined with the break points inside and the end itself."""
    inner = ", ".join(f"CASE WHEN {e} > 0 AND {e} < {end} THEN {e} END" for e in extras)
    return (f"array_sort(array_distinct(transform(array_compact(concat(transform(sequence(0, CAST(ceil({end} / {step} + 0.5D) AS INT) - 1), i -> i * {step}), "
            f"array({inner}, {end}))), v -> round(v, 10))))")


def hydrographs(inputs: DataFrame, *, methods=METHODS, parameters: dict | None = None, tr: float = 1.0) -> DataFrame:
    """One row per (catchment, method): peak data, volume check and ordinate arrays."""
    tr = min(24.0, max(0.05, tr if tr and math.isfinite(tr) and tr > 0 else 1.0))
    chosen = [m for m in methods if m in METHODS]
    if not chosen:
        raise ValueError("choose at least one hydrograph method")
    structs = ", ".join(_method_struct(m, tr, (parameters or {}).get(m)) for m in chosen)
    used = ("A", "L", "Lc", "S", "D", "JN", "SF", "SN", "WF", "RUA", "SIM")
    clean = inputs.selectExpr("point_id", *[f"CASE WHEN {c} > 0 AND {c} < double('infinity') THEN {c} END AS {c}" for c in used])
    rows = clean.selectExpr("point_id", "A", f"inline(array({structs}))")
    inf = "double('infinity')"
    rows = rows.selectExpr("*", f"size(missing) = 0 AND abs(tp) < {inf} AND abs(qp) < {inf} AND abs(tb) < {inf} AND tp > 0 AND tb > 0 AS ok").selectExpr("* EXCEPT (ok)", "coalesce(ok, false) AS available")
    rows = rows.selectExpr("*", f"CASE WHEN available THEN {time_grid_sql('tb', 'dt_hours', ['e1', 'e2', 'e3'])} END AS t")
    # the last ordinate of the Gama method is zero by definition
    rows = rows.selectExpr("*", f"transform(t, (x, i) -> CASE WHEN method = 'gama1' AND i = size(t) - 1 THEN 0D ELSE {_flow_sql('x')} END) AS q")
    rows = rows.selectExpr("*", "aggregate(sequence(1, size(t) - 1), 0D, (acc, i) -> acc + (t[i] - t[i - 1]) * 3600 * (q[i - 1] + q[i]) / 2) AS volume_m3")
    return rows.selectExpr(
        "point_id", "method", "available", "missing", "dt_hours", "lag_hours", "tp AS tp_hours", "qp AS qp_m3s", "tb AS tb_hours", "s1", "s2", "s3",
        "CASE WHEN available THEN A * 1000 END AS volume_target_m3", "volume_m3", "volume_m3 / (A * 1000) AS equivalent_mm", "(volume_m3 - A * 1000) / (A * 1000) * 100 AS volume_error_pct",
        "CASE WHEN volume_m3 > 0 THEN A * 1000 / volume_m3 WHEN available THEN 1D END AS normalization_factor", "t", "q")


def ordinates(curves: DataFrame) -> DataFrame:
    """Long form: one row per ordinate of every available curve."""
    rows = curves.filter("available").selectExpr("point_id", "method", "tp_hours", "qp_m3s", "normalization_factor", "posexplode(arrays_zip(t, q)) AS (step, o)")
    return rows.selectExpr("point_id", "method", "step", "o.t AS t_h", "o.t / tp_hours AS t_over_tp", "CASE WHEN qp_m3s > 0 THEN o.q / qp_m3s ELSE 0D END AS q_over_qp", "o.q AS q",
                           "o.q * normalization_factor AS q_norm")


def availability(curves: DataFrame) -> DataFrame:
    """Requested and available method counts with the missing inputs per method."""
    return curves.select("point_id", "method", "available", F.array_join("missing", ",").alias("missing_inputs"))
