"""How good predictions were, and how to correct the next ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import daypart, horizon
from ledgerline.plans.ranks import nearest_rank


def model_quality(evals: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean absolute error and P80 coverage, with the readiness of the model."""
    out = evals.groupBy(*by).agg(F.count("*").alias("evaluations"), F.round(F.avg(F.abs("residual")), 4).alias("mae_minutes"), F.round(F.avg("within_p80") * 100, 4).alias("p80_coverage"), F.sum("replay").alias("replays"), F.sum(1 - F.col("replay")).alias("prospective"))
    return out.withColumn("readiness", F.when(F.col("prospective") >= 20, "operational").when(F.col("evaluations") >= 10, "warming").otherwise("insufficient-evidence"))


def dimensions(generation: int) -> list[tuple[str, Column]]:
    """Name and key of every grouping of a generation of profiles, the most specific first."""
    segment = F.concat_ws(">", "from_station", "to_station")
    source, category, time, far = F.col("source_id"), F.col("model_version"), daypart("evaluated_at"), horizon("predicted")
    v3 = [("source-segment", F.concat_ws(":", source, segment)), ("category-segment", F.concat_ws(":", category, segment)), ("segment", segment)]
    v4 = [("source-category-segment-time-horizon", F.concat_ws(":", source, category, segment, time, far)), ("source-segment-horizon", F.concat_ws(":", source, segment, far)), ("category-segment", F.concat_ws(":", category, segment)), ("segment", segment)]
    v5 = [v4[0], ("source-category-segment-time", F.concat_ws(":", source, category, segment, time)), ("category-segment-time", F.concat_ws(":", category, segment, time)), *v4[1:]]
    return {1: [("category-segment", F.concat_ws(":", category, segment))], 3: v3, 4: v4, 5: v5}[generation]


def spread_dimensions(evals: DataFrame, generation: int) -> DataFrame:
    """One row for each evaluation and grouping: a single shuffle serves all groupings."""
    names = F.array(*[F.struct(F.lit(name).alias("type"), key.alias("key"), F.lit(i).alias("place")) for i, (name, key) in enumerate(dimensions(generation))])
    return evals.select("*", F.explode(names).alias("d")).select("*", F.col("d.type").alias("dimension"), F.col("d.key").alias("key"), F.col("d.place").alias("place")).drop("d")


#: Fixed values: (evaluations, prospective) from which a profile is operational and warming.
READY = {1: ((10, 3), (3, 0)), 3: ((12, 8), (6, 3)), 4: ((12, 8), (6, 3)), 5: ((12, 8), (6, 3))}


def profiles(evals: DataFrame, generation: int) -> DataFrame:
    """Residual percentiles, error, coverage, bias and readiness of every grouping."""
    if generation >= 4:
        evals = evals.where("replay = 0")
    keys = ["dimension", "key"]
    rows = spread_dimensions(evals, generation)
    base = rows.groupBy(*keys).agg(F.count("*").alias("evaluations"), F.sum(1 - F.col("replay")).alias("prospective"), F.round(F.avg(F.abs("residual")), 4).alias("mae_minutes"), F.round(F.avg("within_p80") * 100, 4).alias("p80_coverage"), F.round(F.avg("residual"), 4).alias("bias_minutes"), F.min("evaluated_at").alias("window_start"), F.max("evaluated_at").alias("window_end"))
    ranks = nearest_rank(rows, keys, "residual", {"r10": 0.1, "r50": 0.5, "r90": 0.9}).drop("n")
    out = base.join(ranks, keys)
    (n1, p1), (n2, p2) = READY[generation]
    ready = F.when((F.col("evaluations") >= n1) & (F.col("prospective") >= p1), "operational").when((F.col("evaluations") >= n2) & (F.col("prospective") >= p2), "warming").otherwise("insufficient-evidence")
    inflate = F.when(F.col("p80_coverage") >= 78, 1.0).otherwise(F.least(F.lit(2.5), F.greatest(F.lit(1.05), 80 / F.greatest(F.lit(35.0), F.col("p80_coverage")))))
    return out.withColumn("uncertainty", F.round(inflate, 3)).withColumn("readiness", ready)


#: What decides the keys of an edge in every grouping.
KINDS = {"source_id": F.col, "model_version": F.col, "from_station": F.col, "to_station": F.col, "daypart": lambda _: daypart("evaluated_at"), "horizon": lambda _: horizon("predicted")}


def _by_kind(edges: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """The edges with what decides their keys as ``_k*``; and each combination of it once, spread over the groupings.

    Edges are far more than combinations, so profiles are looked up for combinations and an edge is neither spread nor grouped.
    """
    kinds = {f"_k{i}": of(name) for i, (name, of) in enumerate(KINDS.items())}
    rows = edges.withColumns(kinds)
    one = rows.groupBy(*kinds).agg(F.first("evaluated_at").alias("evaluated_at"), F.first("predicted").alias("predicted"))
    one = one.withColumns({name: F.col(k) for k, name in zip(kinds, KINDS, strict=True) if name in edges.columns})
    return rows, spread_dimensions(one, generation).select(*kinds, "dimension", "key", "place")


def _with_kind(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each edge with what was found for its combination, nulls equal."""
    keys = [f"_k{i}" for i in range(len(KINDS))]
    found = found.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in found.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.select("edge_id", "p10", "p50", "p90", *keys).join(found, on, "left")


def _applied(rows: DataFrame) -> DataFrame:
    """Shift the median by the median residual and widen to the larger corrected half range."""
    p50 = F.greatest(F.lit(1.0), F.col("p50") + F.col("r50"))
    low = F.least(p50, F.greatest(F.lit(1.0), F.col("p10") + F.col("r10")))
    high = F.greatest(p50, F.col("p90") + F.col("r90"))
    half = F.greatest(p50 - low, high - p50) * F.col("uncertainty")
    return rows.withColumns({"c50": p50, "c10": F.greatest(F.lit(1.0), p50 - half), "c90": p50 + half})


def _corrected(rows: DataFrame, *more: str | Column) -> DataFrame:
    """The corrected range where a profile was found (``found``), else the edge's own."""
    return rows.select("edge_id", *more, *[F.round(F.when(F.col("found"), F.col(f"c{p}")).otherwise(F.col(f"p{p}")), 6).alias(f"p{p}") for p in (10, 50, 90)])


def apply_best(edges: DataFrame, found: DataFrame, generation: int) -> DataFrame:
    """Correct each edge ``(edge_id, p10, p50, p90, ..)`` by one profile.

    Generations 1 and 3 take the readiest, then the one with most prospective evaluations; generation 4 the one with
    most prospective evaluations, at least three.
    """
    ready = F.when(F.col("readiness") == "operational", 2).when(F.col("readiness") == "warming", 1).otherwise(0)
    least = F.col("prospective") >= 3 if generation == 4 else F.col("evaluations") >= 3
    usable = found.where(least).withColumn("rank", ready)
    rows, wanted = _by_kind(edges, generation)
    first = [F.col("prospective").desc(), F.col("evaluations").desc(), F.col("place")]
    keys = [f"_k{i}" for i in range(len(KINDS))]
    order = Window.partitionBy(*keys).orderBy(*([] if generation == 4 else [F.col("rank").desc()]), *first)
    best = wanted.join(usable, ["dimension", "key"]).withColumn("_place", F.row_number().over(order)).where("_place = 1")
    best = best.select(*keys, "dimension", "readiness", "r10", "r50", "r90", "uncertainty", F.lit(True).alias("found"))
    return _corrected(_applied(_with_kind(rows, best)), "dimension", "readiness")


def apply_blend(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Generation 5: blend all profiles of an edge by samples, readiness and how specific they are, shrunk towards none."""
    rows, wanted = _by_kind(edges, 5)
    keys = [f"_k{i}" for i in range(len(KINDS))]
    wanted = wanted.join(found.where("prospective >= 3"), ["dimension", "key"])
    ready = F.when(F.col("readiness") == "operational", 1.0).when(F.col("readiness") == "warming", 0.78).otherwise(0.5)
    wanted = wanted.withColumn("w", F.sqrt("prospective") * ready * F.greatest(F.lit(0.45), 1 - F.col("place") * 0.16))
    means = {c: F.sum(F.col(c) * F.col("w")) / F.sum("w") for c in ("r10", "r50", "r90", "uncertainty")}
    cover = F.sum(F.when(F.col("p80_coverage") == 0, 80.0).otherwise(F.col("p80_coverage")) * F.col("w")) / F.sum("w")
    blend = wanted.groupBy(*keys).agg(F.count("*").alias("blended"), F.sum("prospective").alias("prospective"), cover.alias("coverage"), *[v.alias(k) for k, v in means.items()])
    blend = blend.withColumn("shrink", F.least(F.lit(0.92), F.col("prospective") / (F.col("prospective") + 10))).withColumn("found", F.lit(True))
    rows = _with_kind(rows, blend)
    p50 = F.greatest(F.lit(1.0), F.col("p50") + F.col("r50") * F.col("shrink"))
    low, high = F.greatest(F.lit(1.0), F.col("p10") + F.col("r10") * F.col("shrink")), F.greatest(p50, F.col("p90") + F.col("r90") * F.col("shrink"))
    seen, plain = F.greatest(p50 - low, high - p50), F.greatest(F.lit(1.0), p50 - F.col("p10"), F.col("p90") - p50)
    inflate = F.greatest(F.lit(1.0), F.col("uncertainty")) * F.when(F.col("coverage") < 75, F.least(F.lit(2.0), 75 / F.greatest(F.lit(35.0), F.col("coverage")))).otherwise(1.0)
    half = F.greatest(plain, seen) * inflate
    rows = rows.withColumns({"c10": F.greatest(F.lit(1.0), p50 - half), "c50": p50, "c90": p50 + half})
    return _corrected(rows, F.coalesce("blended", F.lit(0)).alias("blended"), F.round("shrink", 3).alias("shrinkage"))


def newest(evals: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("evaluated_at").desc(), F.col("evaluation_id"))
    return evals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def recent_against_before(evals: DataFrame, by: list[str], n: int) -> DataFrame:
    """Error and coverage of the last ``n`` evaluations and of the ``n`` before them."""
    new, old = F.col("place") <= n, F.col("place") > n
    return newest(evals, by, 2 * n).groupBy(*by).agg(F.count_if(new).alias("recent"), F.count_if(old).alias("before"), F.avg(F.when(new, F.abs("residual"))).alias("mae"), F.avg(F.when(old, F.abs("residual"))).alias("mae_before"), (F.avg(F.when(new, F.col("within_p80"))) * 100).alias("coverage"), (F.avg(F.when(old, F.col("within_p80"))) * 100).alias("coverage_before"))


def _regression(n: int, full: bool) -> Column:
    return F.when((F.col("mae_before") > 0) & (F.col("before") >= (n if full else 1)), (F.col("mae") - F.col("mae_before")) / F.col("mae_before") * 100)


def quality_gate(evals: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    rows = recent_against_before(evals, by, n).withColumn("regression", _regression(n, True))
    worse = F.coalesce(F.col("regression"), F.lit(-1e9))
    status = F.when(F.col("recent") < n, "insufficient-evidence").when((F.col("coverage") < 65) & (worse >= 35), "degraded").when((F.col("coverage") < 72) | (worse >= 20), "watch").otherwise("healthy")
    return rows.select(*by, status.alias("status"), F.round("mae", 3).alias("mae_minutes"), F.round("coverage", 3).alias("p80_coverage"), F.round("regression", 3).alias("regression_percent"))


def release_decision(evals: DataFrame, by: list[str], n: int = 40) -> DataFrame:
    rows = recent_against_before(evals, by, n).withColumn("regression", F.coalesce(_regression(n, False), F.lit(0.0)))
    enough = (F.col("recent") >= n) & (F.col("before") >= n)
    back = (F.col("regression") >= 25) & (F.col("coverage") < F.greatest(F.lit(65.0), F.col("coverage_before") - 10))
    forth = (F.col("regression") <= -8) & (F.col("coverage") >= F.greatest(F.lit(72.0), F.col("coverage_before") - 3))
    decision = F.when(~enough, "hold").when(back, "rollback").when(forth, "promote").otherwise("hold")
    reason = F.when(~enough, "insufficient-comparable-evidence").when(back, "measured-regression").when(forth, "measured-improvement").otherwise("within-guardrails")
    return rows.select(*by, decision.alias("decision"), reason.alias("reason"), F.round("mae", 3).alias("mae_minutes"), F.round("mae_before", 3).alias("mae_before"), F.round("regression", 3).alias("regression_percent"))
