"""Boundary generalisation on ordered ring vertices and reference segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.operators import ordered
from catchwise.operators.geometry import densify
from catchwise.operators.spatial import _projected, near_segments
from catchwise.runtime import cut, small, spread

MATCH_M = 90.0
SMOOTH_M = 150.0
SIMPLIFY_M = 3.0


def sample_step(match_m: float) -> float:
    return min(30.0, max(8.0, match_m / 4.0))


# --- smoothing ---------------------------------------------------------------------------

def stations(vertices: DataFrame, closed: bool = True) -> DataFrame:
    """Distance along each ring and its total length: adds ``station, ring_length``.

    ``vertices``: ``ring_id, seq, x, y`` without a repeated closing vertex.
    """
    nxt = ordered.neighbours(vertices, ["ring_id"], ["seq"], ["x", "y"], ahead=True)
    first = vertices.groupBy("ring_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("_f"))
    j = nxt.join(first, "ring_id")
    to = F.coalesce("next", F.col("_f")) if closed else F.col("next")
    j = j.withColumn("_out", F.coalesce(F.hypot(F.col("x") - to["x"], F.col("y") - to["y"]), F.lit(0.0)))
    run = ordered.running_sum(j.drop("next", "_f"), ["ring_id"], ["seq"], {"_cum": "_out"})
    total = j.groupBy("ring_id").agg(F.sum("_out").alias("ring_length"), F.count("*").alias("n"))
    return run.join(total, "ring_id").select("ring_id", "seq", "x", "y", (F.col("_cum") - F.col("_out")).alias("station"), "ring_length", "n")


def smooth(vertices: DataFrame, tolerance_m: float, *, closed: bool = True) -> DataFrame:
    """Local quadratic regression along the ring with kernel ``exp(-(u/tol)^2)``.

    The window of three tolerances is a range join on bucketed stations; ring ends
    wrap by copies shifted by the ring length.  The fitted value at ``u = 0`` is the
    closed-form intercept of the weighted moments.  Open lines keep their ends, and
    sequences under 3 (rings) or 4 (lines) vertices stay unchanged.
    """
    radius = max(tolerance_m * 3.0, tolerance_m + 1.0)
    s = cut(stations(vertices, closed))
    shifts = [-1, 0, 1] if closed else [0]
    copies = s.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in shifts]))).select(
        "ring_id", (F.col("station") + F.col("_k") * F.col("ring_length")).alias("_s2"), F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    b = F.floor(F.col("_s2") / radius)
    near = copies.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    j = s.withColumn("_b", F.floor(F.col("station") / radius)).join(near, ["ring_id", "_b"])
    u = F.col("_s2") - F.col("station")
    j = j.withColumn("_u", u).filter(F.abs("_u") <= radius)
    w = F.exp(-(F.col("_u") / tolerance_m) * (F.col("_u") / tolerance_m))
    j = j.withColumn("_w", w)
    def mom(p, v=None):
        base = F.col("_w") * (F.pow(F.col("_u"), F.lit(float(p))) if p else F.lit(1.0))
        return F.sum(base if v is None else base * F.col(v))
    agg = j.groupBy("ring_id", "seq").agg(
        F.count("*").alias("_m"), (F.max("_u") - F.min("_u")).alias("_span"), *[mom(p).alias(f"_s{p}") for p in range(5)],
        *[mom(p, v).alias(f"_t{p}{a}") for p in range(3) for v, a in (("_x2", "x"), ("_y2", "y"))])
    s0, s1, s2, s3, s4 = (F.col(f"_s{p}") for p in range(5))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    def fit(a):
        t0, t1, t2 = (F.col(f"_t{p}{a}") for p in range(3))
        top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
        mean = t0 / F.nullif(s0, F.lit(0.0))
        return F.when((F.col("_span") < 1e-9) | (F.abs(det) < 1e-300), mean).otherwise(top / F.nullif(det, F.lit(0.0)))
    out = s.join(agg, ["ring_id", "seq"], "left")
    least = 3 if closed else 4
    fixed = (F.col("n") < least) | (F.col("_m") < 3)
    if not closed:
        fixed = fixed | (F.col("station") == 0) | (F.col("station") == F.col("ring_length"))
    return out.select("ring_id", "seq", F.when(fixed, F.col("x")).otherwise(fit("x")).alias("x"), F.when(fixed, F.col("y")).otherwise(fit("y")).alias("y"))


def _heights(xy: np.ndarray, closed: bool) -> np.ndarray:
    """Height of every vertex over the line through its two neighbours; the ends of a line stay."""
    before, after = np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0)
    base, out = after - before, xy - before
    length = np.hypot(base[:, 0], base[:, 1])
    height = np.divide(np.abs(base[:, 0] * out[:, 1] - base[:, 1] * out[:, 0]), length, out=np.zeros(len(xy)), where=length > 1e-12)
    if not closed:
        height[[0, -1]] = np.inf
    return height


def _simplify_ring(pdf: pd.DataFrame, tolerance: float, closed: bool) -> pd.DataFrame:
    """Rounds of whole-array steps: every vertex whose height is under the tolerance and the least among its neighbours'
    goes, the earlier one of equals; heights are then taken anew. Rings keep three vertices, lines two."""
    pdf = pdf.sort_values("seq", ignore_index=True)
    xy, kept, least = pdf[["x", "y"]].to_numpy(float), np.arange(len(pdf)), 3 if closed else 2
    while len(kept) > least:
        height = _heights(xy[kept], closed)
        place = np.lexsort((kept, height)).argsort()
        goes = (height < tolerance) & (place < np.roll(place, 1)) & (place < np.roll(place, -1))
        spare = len(kept) - least
        if goes.sum() > spare:
            goes &= place < np.sort(place[goes])[spare]
        if not goes.any():
            break
        kept = kept[~goes]
    return pdf.iloc[kept]


def simplify(vertices: DataFrame, tolerance_m: float = SIMPLIFY_M, *, closed: bool = True) -> DataFrame:
    """Effective-height simplification, one ring per group (sequential inside a ring)."""
    if tolerance_m <= 0:
        return vertices

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _simplify_ring(pdf, tolerance_m, closed)

    kind = vertices.schema["ring_id"].dataType.simpleString()
    return spread(vertices.select("ring_id", "seq", "x", "y"), "ring_id").groupBy("ring_id").applyInPandas(run, f"ring_id {kind}, seq long, x double, y double")


# --- contact with the reference boundary -----------------------------------------------------

def classify_contacts(edges: DataFrame, reference: DataFrame, match_m: float = MATCH_M, owner: DataFrame | None = None) -> DataFrame:
    """Densified ring pieces with ``matched`` (midpoint within the match distance) and
    ``near`` (start vertex within the wider contact corridor).

    ``reference``: segments ``seg_id, x1, y1, x2, y2``; with ``owner`` (``poly_id, basin_code``) they carry ``basin_code``
    too, and a ring meets only the segments of its own basin.
    """
    step = sample_step(match_m)
    dense = cut(densify(edges, F.lit(step)))
    ids = ["poly_id", "part", "ring", "seq", "piece"]
    same = [] if owner is None else ["basin_code"]
    known = dense if owner is None else dense.join(small(owner), "poly_id")
    mid = known.select(*ids, *same, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    hit = near_segments(mid, reference, match_m, same=same).select(*ids, F.lit(True).alias("_m")).distinct()
    start = known.select(*ids, *same, F.col("x1").alias("x"), F.col("y1").alias("y"))
    wide = near_segments(start, reference, match_m * 1.6 + step, same=same).select(*ids, F.lit(True).alias("_w")).distinct()
    return dense.join(hit, ids, "left").join(wide, ids, "left").select(
        *ids, "x1", "y1", "x2", "y2", F.coalesce("_m", F.lit(False)).alias("matched"), F.coalesce("_w", F.lit(False)).alias("near"))


def _runs(pieces: DataFrame, flag: str) -> DataFrame:
    """Number cyclic runs of equal ``flag`` along each ring: adds ``run`` (0-based)."""
    ring = ["poly_id", "part", "ring"]
    seq = ordered.neighbours(pieces, ring, ["seq", "piece"], [flag], ahead=False)
    last = pieces.groupBy(*ring).agg(F.max_by(flag, F.struct("seq", "piece")).alias("_last"), F.count("*").alias("_n"))
    j = seq.join(last, ring)
    change = F.coalesce(F.col(f"prev.{flag}"), F.col("_last")) != F.col(flag)
    j = j.withColumn("_c", change.cast("int")).drop("prev", "_last")
    run = ordered.running_sum(j, ring, ["seq", "piece"], {"_r": "_c"})
    # pieces before the first change belong to the run that closes the ring
    top = run.groupBy(*ring).agg(F.max("_r").alias("_max"))
    return run.join(top, ring).withColumn("run", F.when(F.col("_max") == 0, 0).otherwise((F.col("_r") + F.col("_max") - 1) % F.nullif(F.col("_max"), F.lit(0)))).drop("_c", "_r", "_max", "_n")


def contact_runs(pieces: DataFrame, match_m: float = MATCH_M) -> DataFrame:
    """Alternating contact runs per ring after short near-boundary gaps are promoted.

    A gap of at most max(300, 2.5 match) metres whose vertices all stay in the corridor
    counts as contact.  Result: pieces with ``matched`` and ``run``.
    """
    ring = ["poly_id", "part", "ring"]
    gap_limit = max(300.0, match_m * 2.5)
    first = cut(_runs(pieces, "matched"))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    gaps = first.groupBy(*ring, "run").agg(F.bool_and(~F.col("matched")).alias("_gap"), F.sum(length).alias("_len"), F.bool_and("near").alias("_near"))
    several = gaps.groupBy(*ring).agg(F.count("*").alias("_k"))
    promoted = gaps.join(several, ring).filter(F.col("_gap") & (F.col("_len") <= gap_limit) & F.col("_near") & (F.col("_k") > 1)).select(*ring, "run", F.lit(True).alias("_up"))
    again = first.join(promoted, [*ring, "run"], "left").withColumn("matched", F.col("matched") | F.coalesce("_up", F.lit(False))).drop("run", "_up")
    return _runs(again, "matched")


def run_summary(pieces: DataFrame) -> DataFrame:
    """Length and piece count of every run."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return pieces.groupBy("poly_id", "part", "ring", "run").agg(F.first("matched").alias("matched"), F.count("*").alias("pieces"), F.sum(length).alias("length_m"))


def stitch_mode(df: DataFrame) -> DataFrame:
    """Processing mode from ``has_reference, matched_m, boundary_m, overlap_m2, reference_m2, raw_m2``."""
    cover = F.coalesce(F.col("overlap_m2") / F.nullif(F.col("reference_m2"), F.lit(0.0)), F.lit(0.0))
    inside = F.coalesce(F.col("overlap_m2") / F.nullif(F.col("raw_m2"), F.lit(0.0)), F.lit(0.0))
    match = F.coalesce(F.col("matched_m") / F.nullif(F.col("boundary_m"), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({
        "raw_match_percent": match * 100.0,
        "mode": F.when(~F.col("has_reference"), "no_reference").when(F.col("matched_m") <= 0.5, "no_match")
        .when((cover >= 0.90) & (inside >= 0.90) & (match >= 0.35), "full_reference").otherwise("hybrid")})


def candidate_gate(df: DataFrame) -> DataFrame:
    """Accept a stitched candidate: Jaccard at least 0.68 and area ratio 0.68 to 1.42.

    ``raw_cells, candidate_cells, shared_cells`` are cell-set counts.
    """
    jac = F.coalesce(F.col("shared_cells") / F.nullif(F.col("raw_cells") + F.col("candidate_cells") - F.col("shared_cells"), F.lit(0)), F.lit(0.0))
    ratio = F.coalesce(F.col("candidate_cells") / F.nullif(F.col("raw_cells"), F.lit(0)), F.lit(0.0))
    return df.withColumns({"jaccard": jac, "area_ratio": ratio, "accepted": (jac >= 0.68) & ratio.between(0.68, 1.42)})


def adjustment(df: DataFrame) -> DataFrame:
    """Boundary adjustment: final minus raw area."""
    return df.withColumn("boundary_adjustment_km2", F.col("final_km2") - F.col("raw_km2"))


def diagnostics(runs: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One row per polygon: boundary lengths, contact percent, segment counts and, from ``areas``
    (``poly_id, raw_km2, final_km2``), the change of area."""
    agg = runs.groupBy("poly_id").agg(
        F.sum("length_m").alias("boundary_m"), F.sum(F.when(F.col("matched"), F.col("length_m")).otherwise(0.0)).alias("contact_m"),
        F.count_if("matched").alias("contact_runs"), F.count_if(~F.col("matched")).alias("internal_runs"))
    if areas is not None:
        change = F.col("final_km2") - F.col("raw_km2")
        agg = agg.join(areas.select("poly_id", "raw_km2", "final_km2"), "poly_id", "left").withColumns({
            "area_change_km2": change, "area_change_percent": change / F.nullif(F.col("raw_km2"), F.lit(0.0)) * 100.0}).drop("raw_km2", "final_km2")
    return agg.withColumns({"internal_m": F.col("boundary_m") - F.col("contact_m"), "contact_percent": F.col("contact_m") / F.nullif(F.col("boundary_m"), F.lit(0.0)) * 100.0})


# --- best reference arc per run -----------------------------------------------------------------

def ring_segments(edges: DataFrame) -> DataFrame:
    """Reference ring segments with station and ring length: ``ref_id, seg_id, x1..y2, s0, s1, ring_m``."""
    seg = edges.filter("ring = 0").select(F.col("poly_id").alias("ref_id"), "seq", "x1", "y1", "x2", "y2").withColumn("_len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    run = ordered.running_sum(seg, ["ref_id"], ["seq"], {"s1": "_len"})
    total = seg.groupBy("ref_id").agg(F.sum("_len").alias("ring_m"))
    return run.join(total, "ref_id").select("ref_id", F.col("seq").alias("seg_id"), "x1", "y1", "x2", "y2", (F.col("s1") - F.col("_len")).alias("s0"), "s1", "ring_m")


def best_arc(runs: DataFrame, rings: DataFrame, match_m: float = MATCH_M) -> DataFrame:
    """Reference arc that best follows each matched run.

    ``runs``: ordered vertices ``run_id, seq, x, y``; ``rings`` from ``ring_segments``.
    Both arcs between the projected end points compete; gates and score follow the
    directed distances run -> arc and arc -> run, length difference and end offsets.
    """
    step = sample_step(match_m)
    end_limit = match_m + max(5.0, step * 1.5)
    contact = match_m * 1.6 + step
    runs = cut(runs)
    ends = runs.groupBy("run_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    tips = ends.select("run_id", F.lit("a").alias("tip"), "a.x", "a.y").unionByName(ends.select("run_id", F.lit("b").alias("tip"), "b.x", "b.y"))
    proj = near_segments(tips, rings, end_limit).groupBy("run_id", "ref_id", "tip").agg(F.min(F.struct(
        F.round("d", 7).alias("d"), (F.col("s0") + F.col("t") * (F.col("s1") - F.col("s0"))).alias("s"), F.col("ring_m"))).alias("_b"))
    pair = proj.groupBy("run_id", "ref_id").agg(
        F.max(F.when(F.col("tip") == "a", F.col("_b"))).alias("pa"), F.max(F.when(F.col("tip") == "b", F.col("_b"))).alias("pb")).filter("pa is not null and pb is not null")
    fwd = F.pmod(F.col("pb.s") - F.col("pa.s"), F.col("pa.ring_m"))
    arcs = pair.select("run_id", "ref_id", F.col("pa.d").alias("d0"), F.col("pb.d").alias("d1"), F.col("pa.ring_m").alias("ring_m"), F.explode(F.array(
        F.struct(F.lit("forward").alias("arc"), F.col("pa.s").alias("from_s"), fwd.alias("arc_m")),
        F.struct(F.lit("reverse").alias("arc"), F.col("pb.s").alias("from_s"), (F.col("pa.ring_m") - fwd).alias("arc_m")))).alias("k")).select("run_id", "ref_id", "d0", "d1", "ring_m", "k.*").filter("arc_m > 0.1")
    nxt = ordered.neighbours(runs, ["run_id"], ["seq"], ["x", "y"], ahead=True)
    raw_seg = cut(nxt.filter("next is not null").select("run_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("next.x").alias("x2"), F.col("next.y").alias("y2")))
    raw_len = raw_seg.groupBy("run_id").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("raw_m"))
    ratio = F.col("arc_m") / F.greatest(F.col("raw_m"), F.lit(1.0))
    arcs = cut(arcs.join(raw_len, "run_id").withColumn("ratio", ratio).filter(F.col("ratio").between(0.20, 5.0)))
    # ring segments cut to the arc: the arc runs from from_s over arc_m, wrapping at ring_m
    key = ["run_id", "ref_id", "arc"]
    r = rings.select("ref_id", "x1", "y1", "x2", "y2", "s0", "s1")
    pieces = arcs.join(r, "ref_id").withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "_a": F.greatest(F.col("from_s"), F.col("s0") + F.col("_k") * F.col("ring_m")), "_z": F.least(F.col("from_s") + F.col("arc_m"), F.col("s1") + F.col("_k") * F.col("ring_m"))}).filter("_z > _a")
    def at(s, c1, c2):
        f = (F.col(s) - F.col("_k") * F.col("ring_m") - F.col("s0")) / F.nullif(F.col("s1") - F.col("s0"), F.lit(0.0))
        return F.col(c1) + f * (F.col(c2) - F.col(c1))
    pieces = cut(pieces.select(*key, at("_a", "x1", "x2").alias("x1"), at("_a", "y1", "y2").alias("y1"), at("_z", "x1", "x2").alias("x2"), at("_z", "y1", "y2").alias("y2")))
    there = _projected(runs.select("run_id", "seq", "x", "y").join(pieces, "run_id")).groupBy(*key, "seq").agg(F.min("d").alias("d"))
    there = there.groupBy(*key).agg(F.max("d").alias("raw_max"), F.avg("d").alias("raw_mean"))
    spots = pieces.select(*key, F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(pieces.select(*key, F.col("x2").alias("x"), F.col("y2").alias("y"))).distinct()
    back = _projected(spots.join(raw_seg, "run_id")).groupBy(*key, "x", "y").agg(F.min("d").alias("d")).groupBy(*key).agg(F.max("d").alias("ref_max"), F.avg("d").alias("ref_mean"))
    scored = arcs.join(there, key).join(back, key).filter((F.col("raw_max") <= max(end_limit + step, contact)) & (F.col("ref_max") <= max(2000.0, match_m * 16.0)))
    score = 2.0 * F.col("raw_max") + F.col("raw_mean") + 0.15 * F.col("ref_mean") + 0.02 * F.abs(F.col("arc_m") - F.col("raw_m")) + 0.5 * (F.col("d0") + F.col("d1"))
    best = scored.withColumn("score", score).groupBy("run_id").agg(F.min(F.struct("score", "ref_id", "arc", "from_s", "arc_m", "ratio", "raw_max", "ref_max")).alias("_b"))
    return best.select("run_id", "_b.*")


def arc_distance_score(samples: DataFrame, arcs: DataFrame, target: DataFrame) -> DataFrame:
    """Choose between the arcs of a ring: mean + max/4 + 8 |ln length ratio|, smallest wins.

    ``samples``: ``run_id, arc, i, x, y``; ``arcs``: ``run_id, arc, arc_m, target_m``;
    ``target``: ``run_id, x1, y1, x2, y2``.
    """
    d = _projected(samples.join(target, "run_id")).groupBy("run_id", "arc", "i").agg(F.min("d").alias("d"))
    agg = d.groupBy("run_id", "arc").agg(F.avg("d").alias("mean_m"), F.max("d").alias("max_m")).join(small(arcs), ["run_id", "arc"])
    penalty = F.abs(F.log(F.greatest(F.col("arc_m") / F.greatest(F.col("target_m"), F.lit(1.0)), F.lit(1e-9))))
    agg = agg.withColumn("score", F.col("mean_m") + 0.25 * F.col("max_m") + 8.0 * penalty)
    return agg.groupBy("run_id").agg(F.min(F.struct("score", "arc", "max_m", "mean_m")).alias("_b")).select("run_id", "_b.*")


def display_tiers(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """River geometry per display tier: order filter, then simplification by the tier's tolerance.

    ``vertices``: ``linkno, seq, x, y``; ``lines``: ``linkno, river_order`` (1 = largest).
    """
    tiers = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(t).alias("tolerance_m"), F.array(*[F.lit(o) for o in (orders or ())]).cast("array<int>").alias("orders"))
                      for k, t, orders in DISPLAY_TIERS])
    kept = lines.select("linkno", "river_order", F.inline(tiers)).filter((F.size("orders") == 0) | F.array_contains("orders", F.col("river_order")))
    v = vertices.join(kept.select("linkno", "tier", "tolerance_m"), "linkno")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tol = float(pdf.tolerance_m.iloc[0])
        return pdf if tol <= 0 else _simplify_ring(pdf, tol, False)

    rows = v.select("linkno", F.col("seq").cast("long").alias("seq"), "x", "y", "tier", "tolerance_m")
    return spread(rows, "linkno", "tier").groupBy("linkno", "tier").applyInPandas(
        run, "linkno long, seq long, x double, y double, tier string, tolerance_m double")


# display tier, simplification tolerance in metres, river orders shown (fixed values)
DISPLAY_TIERS = (("z6-8", 300.0, (1, 2)), ("z8-10", 150.0, (1, 2)), ("z10-11", 75.0, (1, 2, 3)), ("z11-12", 35.0, (1, 2, 3)), ("z12-14", 12.0, None), ("full", 0.0, None))
