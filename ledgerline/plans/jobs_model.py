"""Registered queries: evaluation, calibration, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import calibration
from ledgerline.plans.proxy import EVALS, evals
from ledgerline.plans.registry import job

SEGMENT = "concat_ws('>', from_station, to_station)"
TIME = "CASE WHEN hour(evaluated_at) < 6 THEN 'night' WHEN hour(evaluated_at) < 12 THEN 'morning' WHEN hour(evaluated_at) < 18 THEN 'day' ELSE 'evening' END"
FAR = "CASE WHEN predicted <= 30 THEN 'short' WHEN predicted <= 120 THEN 'medium' ELSE 'long' END"
CS = f"concat_ws(':', model_version, {SEGMENT})"
DIMENSIONS = {
    1: [("category-segment", CS)],
    3: [("source-segment", f"concat_ws(':', source_id, {SEGMENT})"), ("category-segment", CS), ("segment", SEGMENT)],
    4: [("source-category-segment-time-horizon", f"concat_ws(':', source_id, model_version, {SEGMENT}, {TIME}, {FAR})"), ("source-segment-horizon", f"concat_ws(':', source_id, {SEGMENT}, {FAR})"), ("category-segment", CS), ("segment", SEGMENT)],
}
DIMENSIONS[5] = [DIMENSIONS[4][0], ("source-category-segment-time", f"concat_ws(':', source_id, model_version, {SEGMENT}, {TIME})"), ("category-segment-time", f"concat_ws(':', model_version, {SEGMENT}, {TIME})"), *DIMENSIONS[4][1:]]
READY = {1: "evaluations >= 10 AND prospective >= 3 THEN 'operational' WHEN evaluations >= 3", 3: "evaluations >= 12 AND prospective >= 8 THEN 'operational' WHEN evaluations >= 6 AND prospective >= 3"}


def spread_sql(table: str, generation: int) -> str:
    return " UNION ALL ".join(f"SELECT *, '{name}' AS dimension, {key} AS key, {i} AS place FROM {table}" for i, (name, key) in enumerate(DIMENSIONS[generation]))


def profiles_sql(generation: int) -> str:
    source = "(SELECT * FROM evals WHERE replay = 0)" if generation >= 4 else "evals"
    at = "list_sort(list(residual))[(floor((count(*) - 1) * {} + 0.5) + 1)::INTEGER]"
    return f"""{EVALS}, spread AS ({spread_sql(source, generation)}),
base AS (SELECT dimension, key, count(*) AS evaluations, sum(1 - replay)::BIGINT AS prospective, round(avg(abs(residual)), 4) AS mae_minutes, round(avg(within_p80) * 100, 4) AS p80_coverage,
  round(avg(residual), 4) AS bias_minutes, epoch_us(min(evaluated_at)) AS window_start, epoch_us(max(evaluated_at)) AS window_end, {at.format(0.1)} AS r10, {at.format(0.5)} AS r50, {at.format(0.9)} AS r90 FROM spread GROUP BY dimension, key),
profiles AS (SELECT *, round(CASE WHEN p80_coverage >= 78 THEN 1.0::DOUBLE ELSE least(2.5, greatest(1.05, 80 / greatest(35.0, p80_coverage))) END, 3) AS uncertainty,
  CASE WHEN {READY[min(3, generation)]} THEN 'warming' ELSE 'insufficient-evidence' END AS readiness FROM base)"""


@job("e10_model_quality", f"""WITH {EVALS}, q AS (SELECT model_version, count(*) AS evaluations, round(avg(abs(residual)), 4) AS mae_minutes, round(avg(within_p80) * 100, 4) AS p80_coverage, sum(replay)::BIGINT AS replays, sum(1 - replay)::BIGINT AS prospective FROM evals GROUP BY model_version)
SELECT *, CASE WHEN prospective >= 20 THEN 'operational' WHEN evaluations >= 10 THEN 'warming' ELSE 'insufficient-evidence' END AS readiness FROM q""")
def e10(spark, sf):
    return calibration.model_quality(evals(spark, sf), ["model_version"])


def _profiles(generation: int):
    def query(spark, sf):
        out = calibration.profiles(evals(spark, sf), generation)
        return out.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})

    return query


for _name, _generation in (("e11_calibration_v1", 1), ("e12_calibration_v3", 3), ("e13_calibration_v4", 4), ("e14_calibration_v5", 5)):
    job(_name, f"WITH {profiles_sql(_generation)} SELECT * FROM profiles")(_profiles(_generation))

EDGES = "edges AS (SELECT *, evaluation_id AS edge_id, predicted * 0.8 AS p10, predicted AS p50, predicted * 1.3 AS p90 FROM evals)"


def _edges(spark, sf):
    return evals(spark, sf).withColumns({"edge_id": F.col("evaluation_id"), "p10": F.col("predicted") * 0.8, "p50": F.col("predicted"), "p90": F.col("predicted") * 1.3})


def applied_sql(generation: int) -> str:
    least = "prospective >= 3" if generation == 4 else "evaluations >= 3"
    rank = "" if generation == 4 else "CASE readiness WHEN 'operational' THEN 2 WHEN 'warming' THEN 1 ELSE 0 END DESC, "
    return f"""WITH {profiles_sql(generation)}, {EDGES}, wanted AS ({spread_sql('edges', generation)}),
best AS (SELECT w.edge_id, w.p10, w.p50, w.p90, p.* FROM wanted w JOIN profiles p USING (dimension, key) WHERE {least}
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY {rank}prospective DESC, evaluations DESC, place) = 1),
m AS (SELECT *, greatest(1.0, p50 + r50) AS c50 FROM best),
h AS (SELECT *, greatest(c50 - least(c50, greatest(1.0, p10 + r10)), greatest(c50, p90 + r90) - c50) * uncertainty AS half FROM m)
SELECT e.edge_id, dimension, readiness, round(coalesce(greatest(1.0, c50 - half), e.p10), 6) AS p10, round(coalesce(c50, e.p50), 6) AS p50, round(coalesce(c50 + half, e.p90), 6) AS p90 FROM edges e LEFT JOIN h USING (edge_id)"""


def _applied(generation: int):
    return lambda spark, sf: calibration.apply_best(_edges(spark, sf), calibration.profiles(evals(spark, sf), generation), generation)


for _name, _generation in (("m8_apply_v1", 1), ("m8_apply_v3", 3), ("m9_apply_v4", 4)):
    job(_name, applied_sql(_generation))(_applied(_generation))


@job("m9_apply_v5", f"""WITH {profiles_sql(5)}, {EDGES}, wanted AS ({spread_sql('edges', 5)}),
r AS (SELECT w.edge_id, w.p10, w.p50, w.p90, p.*, sqrt(prospective) * CASE readiness WHEN 'operational' THEN 1.0 WHEN 'warming' THEN 0.78 ELSE 0.5 END * greatest(0.45, 1 - place * 0.16) AS w FROM wanted w JOIN profiles p USING (dimension, key) WHERE prospective >= 3),
b AS (SELECT edge_id, first(p10) AS p10, first(p50) AS p50, first(p90) AS p90, count(*) AS blended, sum(prospective) AS prospective, sum(CASE WHEN p80_coverage = 0 THEN 80 ELSE p80_coverage END * w) / sum(w) AS coverage,
  sum(r10 * w) / sum(w) AS r10, sum(r50 * w) / sum(w) AS r50, sum(r90 * w) / sum(w) AS r90, sum(uncertainty * w) / sum(w) AS uncertainty FROM r GROUP BY edge_id),
k AS (SELECT *, least(0.92::DOUBLE, prospective / (prospective + 10)::DOUBLE) AS shrink FROM b),
m AS (SELECT *, greatest(1.0, p50 + r50 * shrink) AS c50 FROM k),
h AS (SELECT *, greatest(greatest(1.0, c50 - p10, p90 - c50), greatest(c50 - greatest(1.0, p10 + r10 * shrink), greatest(c50, p90 + r90 * shrink) - c50)) * greatest(1.0, uncertainty) * CASE WHEN coverage < 75 THEN least(2.0, 75 / greatest(35.0, coverage)) ELSE 1.0 END AS half FROM m)
SELECT e.edge_id, coalesce(blended, 0) AS blended, round(shrink, 3) AS shrinkage, round(coalesce(greatest(1.0, c50 - half), e.p10), 6) AS p10, round(coalesce(c50, e.p50), 6) AS p50, round(coalesce(c50 + half, e.p90), 6) AS p90 FROM edges e LEFT JOIN h USING (edge_id)""")
def m9_v5(spark, sf):
    return calibration.apply_blend(_edges(spark, sf), calibration.profiles(evals(spark, sf), 5))


def recent_sql(by: str, n: int) -> str:
    return f"""{EVALS}, nw AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY evaluated_at DESC, evaluation_id) AS place FROM evals QUALIFY place <= {2 * n}),
ra AS (SELECT {by}, count(*) FILTER (place <= {n}) AS recent, count(*) FILTER (place > {n}) AS before, avg(abs(residual)) FILTER (place <= {n}) AS mae, avg(abs(residual)) FILTER (place > {n}) AS mae_before,
  avg(within_p80) FILTER (place <= {n}) * 100 AS coverage, avg(within_p80) FILTER (place > {n}) * 100 AS coverage_before FROM nw GROUP BY ALL)"""


@job("f13_recent_against_before", f"WITH {recent_sql('source_id, model_version', 20)} SELECT source_id, model_version, recent, before, round(mae, 4) AS mae, round(mae_before, 4) AS mae_before, round(coverage, 3) AS coverage, round(coverage_before, 3) AS coverage_before FROM ra")
def f13(spark, sf):
    out = calibration.recent_against_before(evals(spark, sf), ["source_id", "model_version"], 20)
    return out.select("source_id", "model_version", "recent", "before", F.round("mae", 4).alias("mae"), F.round("mae_before", 4).alias("mae_before"), F.round("coverage", 3).alias("coverage"), F.round("coverage_before", 3).alias("coverage_before"))


@job("m11_quality_gate", f"""WITH {recent_sql('source_id, model_version', 20)}, g AS (SELECT *, CASE WHEN mae_before > 0 AND before >= 20 THEN (mae - mae_before) / mae_before * 100 END AS regression FROM ra)
SELECT source_id, model_version, CASE WHEN recent < 20 THEN 'insufficient-evidence' WHEN coverage < 65 AND coalesce(regression, -1e9) >= 35 THEN 'degraded' WHEN coverage < 72 OR coalesce(regression, -1e9) >= 20 THEN 'watch' ELSE 'healthy' END AS status,
  round(mae, 3) AS mae_minutes, round(coverage, 3) AS p80_coverage, round(regression, 3) AS regression_percent FROM g""")
def m11(spark, sf):
    return calibration.quality_gate(evals(spark, sf), ["source_id", "model_version"], 20)


@job("m12_release_decision", f"""WITH {recent_sql('model_version, source_id', 40)}, g AS (SELECT *, coalesce(CASE WHEN mae_before > 0 AND before >= 1 THEN (mae - mae_before) / mae_before * 100 END, 0.0) AS regression FROM ra),
d AS (SELECT *, recent >= 40 AND before >= 40 AS enough, regression >= 25 AND coverage < greatest(65.0, coverage_before - 10) AS back, regression <= -8 AND coverage >= greatest(72.0, coverage_before - 3) AS forth FROM g)
SELECT model_version, source_id, CASE WHEN NOT enough THEN 'hold' WHEN back THEN 'rollback' WHEN forth THEN 'promote' ELSE 'hold' END AS decision,
  CASE WHEN NOT enough THEN 'insufficient-comparable-evidence' WHEN back THEN 'measured-regression' WHEN forth THEN 'measured-improvement' ELSE 'within-guardrails' END AS reason,
  round(mae, 3) AS mae_minutes, round(mae_before, 3) AS mae_before, round(regression, 3) AS regression_percent FROM d""")
def m12(spark, sf):
    return calibration.release_decision(evals(spark, sf), ["model_version", "source_id"], 40)
