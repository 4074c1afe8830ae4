"""Skill and statistics queries and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.expr import rounded
from freshet.operators import skill, statistics
from freshet.plans.panels import FLAG_FLOW, FLOW, PAIRS, flag_flow, flow, num, pairs, read

G = ["gauge_id"]


def scored(operator):
    return lambda spark, d: rounded(operator(pairs(spark, d), G))


def tested(operator, panel=flow):
    return lambda spark, d: rounded(operator(panel(spark, d)))


def _best(spark, d):
    """Two models of the same flow: the prices, and the flow of the day before."""
    from freshet.functions.expr import by

    base = pairs(spark, d)
    lagged = base.withColumn("sim", F.lag("obs").over(by("gauge_id", "date")))
    both = base.withColumn("model", F.lit("price")).unionByName(lagged.withColumn("model", F.lit("persistence")))
    scores = skill.quality_grades(both, ["gauge_id", "model"])
    return rounded(skill.best_model(scores, G).select("gauge_id", "model", "NSE", "composite_score"))


def _spearman(spark, d):
    return rounded(skill.spearman(pairs(spark, d), "obs", "sim", G))


def _mann_whitney(spark, d):
    parts = read(spark, d, "part").select((F.col("p_size") > 25).alias("large"), F.col("p_retailprice").alias("price"))
    return rounded(skill.mann_whitney(parts, "large", "price"))


QUERIES = {
    "skill_evaluate": scored(skill.evaluate),
    "skill_enhanced": scored(skill.enhanced),
    "skill_quantile_nse": scored(lambda p, k: skill.quantile_nse(p, k, 0.25, 0.75)),
    "skill_flow_bands": scored(skill.flow_bands),
    "skill_quality_grades": scored(skill.quality_grades),
    "skill_signature_errors": scored(skill.signature_errors),
    "skill_generalization_gap": scored(lambda p, k: skill.generalization_gap(p, k, "1999-01-01")),
    "skill_best_model": _best,
    "skill_spearman": _spearman,
    "skill_mann_whitney": _mann_whitney,
    "stat_linear_trend": tested(statistics.linear_trend),
    "stat_linear_trend_p": tested(lambda s: statistics.with_p_value(statistics.linear_trend(s))),
    "stat_annual_mann_kendall": tested(lambda s: statistics.mann_kendall(statistics.annual(s))),
    "stat_seasonal_mann_kendall": tested(statistics.seasonal_mann_kendall),
    "stat_piecewise_trends": tested(lambda s: statistics.piecewise_trends(s, [1997, 1999])),
    "stat_pettitt": tested(statistics.pettitt),
    "stat_buishand": tested(statistics.buishand),
    "stat_snht": tested(statistics.snht),
    "stat_von_neumann": tested(statistics.von_neumann),
    "stat_runs": tested(statistics.runs),
    "stat_ljung_box": tested(statistics.ljung_box),
    "stat_ljung_box_p": tested(lambda s: statistics.chi_square_p(statistics.ljung_box(s))),
    "stat_homogeneity": tested(statistics.homogeneity),
    "stat_variance_changes": tested(statistics.variance_changes),
    "stat_broken_trends": lambda s, d: rounded(statistics.broken_trends(flow(s, d), statistics.detected_breaks(flow(s, d)))),
    "stat_change_points": tested(statistics.change_points, flag_flow),
}


def nse(o: str = "obs", s: str = "sim", where: str = "") -> str:
    f = f" FILTER ({where})" if where else ""
    return f"1 - sum(pow({o} - ({s}), 2)){f} / nullif(var_pop({o}){f} * count({o}){f}, 0)"


def r(o: str = "obs", s: str = "sim") -> str:
    return f"(covar_pop({o}, {s}) / nullif(stddev_pop({o}) * stddev_pop({s}), 0))"


KGE = f"""CASE WHEN max(abs(sim)) > 1e6 THEN -999.0 WHEN avg(obs) <> 0 AND stddev_pop(obs) <> 0 THEN 1 - sqrt(pow(coalesce({r()}, 0) - 1, 2)
  + pow(greatest(0, least(1e6, stddev_pop(sim) / nullif(stddev_pop(obs), 0))) - 1, 2) + pow(greatest(0, least(1e6, avg(sim) / nullif(avg(obs), 0))) - 1, 2)) END"""
PBIAS = "100 * sum(sim - obs) / nullif(sum(obs), 0)"
LOG_NSE = f"CASE WHEN min(obs) > 0 AND min(sim) > 0 THEN {nse('ln(greatest(obs, 0) + 0.01)', 'ln(greatest(sim, 0) + 0.01)')} END"
PFE = "100 * sum(sim - obs) FILTER (obs >= pk) / nullif(sum(obs) FILTER (obs >= pk), 0)"
_PEAK = f"WITH p AS ({PAIRS}), k AS (SELECT gauge_id, quantile_cont(obs, 0.95) AS pk FROM p GROUP BY 1), t AS (SELECT * FROM p JOIN k USING (gauge_id))"


def grade(value: str, cuts: list[float], rising: bool) -> str:
    op = ">" if rising else "<="
    return f"CAST(CASE WHEN {value} {op} {cuts[0]} THEN 3 WHEN {value} {op} {cuts[1]} THEN 2 WHEN {value} {op} {cuts[2]} THEN 1 ELSE 0 END AS INTEGER)"


def composite(score: str) -> str:
    return f"CAST(CASE WHEN {score} < 0.5 THEN 0 WHEN {score} < 1.5 THEN 1 WHEN {score} < 2.5 THEN 2 ELSE 3 END AS INTEGER)"


def tail(z: str) -> str:
    """The rational approximation of the two-sided normal tail."""
    x = f"(abs({z}) / 1.4142135623730951)"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + ({c}))"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def _grades_sql(source: str, keys: str) -> str:
    return f"""g0 AS (SELECT {keys}, count(*) AS n, {nse()} AS a, {PBIAS} AS b FROM ({source}) WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY {keys}),
    g1 AS (SELECT {keys}, CASE WHEN n >= 3 THEN a END AS a, CASE WHEN n >= 3 THEN b END AS b FROM g0),
    g2 AS (SELECT *, {grade('a', [0.8, 0.7, 0.5], True)} AS ga, {grade('abs(b)', [10, 15, 35], False)} AS gb, {grade('a', [0.85, 0.7, 0.5], True)} AS gc FROM g1),
    g3 AS (SELECT *, (ga + gb + gc) / 3.0 AS sc FROM g2)"""


_BANDS = f"""WITH p AS ({PAIRS}), k AS (SELECT gauge_id, quantile_cont(obs, 0.1) AS a, quantile_cont(obs, 0.3) AS b, quantile_cont(obs, 0.7) AS c, quantile_cont(obs, 0.9) AS d FROM p GROUP BY 1),
  t AS (SELECT p.*, CASE WHEN obs <= a THEN 0 WHEN obs <= b THEN 1 WHEN obs <= c THEN 2 WHEN obs <= d THEN 3 ELSE 4 END AS band FROM p JOIN k USING (gauge_id))"""

_KENDALL_Z = "CASE WHEN s > 0 THEN (s - 1) / nullif(sqrt(v), 0) WHEN s < 0 THEN (s + 1) / nullif(sqrt(v), 0) ELSE 0 END"


def _kendall(source: str, keys: str) -> str:
    return f"""ys AS ({source}), i AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i FROM ys),
    pr AS (SELECT {keys}, sum(sign(y.q - x.q)) AS s, quantile_cont((y.q - x.q) / (y.i - x.i), 0.5) AS sen FROM i x JOIN i y USING ({keys}) WHERE y.i > x.i GROUP BY {keys}),
    ti AS (SELECT {keys}, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS tt FROM (SELECT {keys}, q, count(*)::DOUBLE AS t FROM ys GROUP BY {keys}, q) GROUP BY {keys}),
    mk AS (SELECT *, (n * (n - 1) * (2 * n + 5) - tt) / 18 AS v FROM pr JOIN ti USING ({keys}))"""


_ANNUAL = f"SELECT gauge_id, make_date(year(date), 12, 31) AS date, avg(q) AS q FROM ({FLOW}) GROUP BY gauge_id, year(date)"
_MONTHLY = f"SELECT gauge_id, month(date) AS month, year(date) AS date, avg(q) AS q FROM ({FLOW}) GROUP BY 1, 2, 3"


def _trend(source: str, keys: str = "gauge_id") -> str:
    return f"""x AS (SELECT *, year(date) - min(year(date)) OVER (PARTITION BY {keys}) AS x FROM ({source})),
    f AS (SELECT {keys}, count(*) AS n, regr_slope(q, x) AS b, regr_intercept(q, x) AS a, {r('q', 'x')} AS r, var_pop(q) * count(*) AS yy, var_pop(x) * count(*) AS xx FROM x GROUP BY {keys} HAVING count(*) >= 3),
    e AS (SELECT *, sqrt(greatest(0, yy * (1 - r * r)) / nullif(xx * (n - 2), 0)) AS se FROM f)
    SELECT {keys}, n, {num(slope='b', intercept='a', r_squared='r * r', std_err='se', t_statistic='b / nullif(se, 0)', trend_per_decade='b * 10')},
      CASE WHEN b > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'no trend' END AS direction FROM e"""


_T = f"WITH ts AS ({FLOW}), o AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY date) AS t, count(*) OVER (PARTITION BY gauge_id) AS n FROM ts QUALIFY n >= 10)"

ORACLE_SQL = {
    "skill_evaluate": f"""{_PEAK} SELECT gauge_id, {num(NSE=nse(), KGE=KGE, PBIAS=PBIAS, RMSE='sqrt(avg(pow(sim - obs, 2)))', MAE='avg(abs(sim - obs))', logNSE=LOG_NSE, R2=f'pow({r()}, 2)', r=r(), PFE=PFE)} FROM t GROUP BY gauge_id""",
    "skill_enhanced": f"""{_PEAK}, a AS (SELECT gauge_id, {nse('1 / (obs + 0.01)', '1 / (sim + 0.01)')} AS i, CASE WHEN min(obs) >= 0 AND min(sim) >= 0 THEN {nse('sqrt(greatest(obs, 0))', 'sqrt(greatest(sim, 0))')} END AS s, {LOG_NSE} AS l, {nse()} AS n, {PFE} AS f FROM t GROUP BY 1)
      SELECT gauge_id, {num(invNSE='i', sqrtNSE='s', composite_low='coalesce(0.5 * l + 0.5 * i, l, i)', composite_high='CASE WHEN n IS NOT NULL THEN CASE WHEN f IS NULL THEN n ELSE 0.7 * n - 0.3 * greatest(-1, least(1, f / 100)) END END')} FROM a""",
    "skill_quantile_nse": f"""WITH p AS ({PAIRS}), k AS (SELECT gauge_id, quantile_cont(obs, 0.25) AS a, quantile_cont(obs, 0.75) AS b FROM p GROUP BY 1)
      SELECT gauge_id, {num(quantile_nse=nse())} FROM p JOIN k USING (gauge_id) WHERE obs BETWEEN a AND b GROUP BY gauge_id""",
    "skill_flow_bands": f"""{_BANDS} SELECT gauge_id, {num(**{f'{b}_{k}': v for i, b in enumerate(skill.BANDS) for k, v in (('nse', nse(where=f'band = {i}')), ('pbias', f'100 * sum(sim - obs) FILTER (band = {i}) / nullif(sum(obs) FILTER (band = {i}), 0)'))}, overall_nse=nse(), overall_kge=KGE, overall_pbias=PBIAS)} FROM t GROUP BY gauge_id""",
    "skill_quality_grades": f"""WITH {_grades_sql(PAIRS, 'gauge_id')} SELECT gauge_id, {num(NSE='a', PBIAS='b', R2='a', composite_score='sc')}, ga AS NSE_grade, gb AS PBIAS_grade, gc AS R2_grade, {composite('sc')} AS composite_grade FROM g3""",
    "skill_signature_errors": f"""WITH p AS ({PAIRS}), s AS (SELECT gauge_id, avg(obs) AS o1, quantile_cont(obs, 0.95) AS o2, quantile_cont(obs, 0.05) AS o3, avg(sim) AS s1, quantile_cont(sim, 0.95) AS s2, quantile_cont(sim, 0.05) AS s3 FROM p GROUP BY 1),
      e AS (SELECT *, {", ".join(f"CASE WHEN abs(o{i}) < {x} THEN s{i} - o{i} ELSE (s{i} - o{i}) * 100 / nullif(o{i}, 0) END AS e{i}" for i, x in ((1, .01), (2, .1), (3, .01)))} FROM s),
      g AS (SELECT *, {grade('abs(e1)', [5, 10, 25], False)} AS g1, {grade('abs(e2)', [15, 25, 50], False)} AS g2, {grade('abs(e3)', [20, 35, 60], False)} AS g3 FROM e)
      SELECT gauge_id, {num(obs_mean='o1', obs_q5='o2', obs_q95='o3', sim_mean='s1', sim_q5='s2', sim_q95='s3', mean_error_pct='e1', q5_error_pct='e2', q95_error_pct='e3')}, g1 AS mean_flow_grade, g2 AS q5_grade, g3 AS q95_grade,
      {num(signature_composite_score='(g1 + g2 + g3) / 4.0')}, {composite('(g1 + g2 + g3) / 4.0')} AS signature_composite_grade FROM g""",
    "skill_generalization_gap": f"""WITH p AS ({PAIRS}), d AS (SELECT gauge_id, CASE WHEN count(*) FILTER (date < DATE '1999-01-01') >= 30 THEN {nse(where="date < DATE '1999-01-01'")} END AS a,
      CASE WHEN count(*) FILTER (date >= DATE '1999-01-01') >= 30 THEN {nse(where="date >= DATE '1999-01-01'")} END AS b FROM p GROUP BY 1)
      SELECT gauge_id, {num(train_nse='a', test_nse='b', delta_nse='b - a')}, b - a < 0 AS degraded FROM d""",
    "skill_best_model": f"""WITH p AS ({PAIRS}), m AS (SELECT gauge_id, date, obs, sim, 'price' AS model FROM p UNION ALL SELECT gauge_id, date, obs, lag(obs) OVER (PARTITION BY gauge_id ORDER BY date), 'persistence' FROM p), {_grades_sql('SELECT * FROM m', 'gauge_id, model')}
      SELECT gauge_id, model, {num(NSE='a', composite_score='sc')} FROM g3 QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY sc DESC, a DESC, model DESC) = 1""",
    "skill_spearman": f"""WITH p AS ({PAIRS}), k AS (SELECT gauge_id, rank() OVER (PARTITION BY gauge_id ORDER BY obs) + (count(*) OVER (PARTITION BY gauge_id, obs) - 1) / 2.0 AS a, rank() OVER (PARTITION BY gauge_id ORDER BY sim) + (count(*) OVER (PARTITION BY gauge_id, sim) - 1) / 2.0 AS b FROM p)
      SELECT gauge_id, {num(rho=r('a', 'b'))}, count(*) AS n FROM k GROUP BY gauge_id""",
    "skill_mann_whitney": f"""WITH v AS (SELECT p_retailprice AS v, count(*) FILTER (p_size > 25) AS a, count(*) FILTER (NOT p_size > 25) AS b FROM part GROUP BY 1), l AS (SELECT *, coalesce(sum(b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM v),
      t AS (SELECT sum(a * (less + b / 2.0)) AS u, sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2, sum(pow(a + b, 3) - (a + b)) AS tt FROM l)
      SELECT {num(u='u', n1='n1', n2='n2', z='(u - n1 * n2 / 2) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tt / nullif((n1 + n2) * (n1 + n2 - 1), 0))), 0)')} FROM t""",
    "stat_linear_trend": f"WITH {_trend(FLOW)}",
    "stat_piecewise_trends": f"WITH {_trend(f'SELECT ts.*, segment FROM ({FLOW}) ts JOIN (VALUES (0, -99999, 1997), (1, 1997, 1999), (2, 1999, 99999)) v(segment, a, b) ON year(date) BETWEEN a AND b', 'gauge_id, segment')}",
    "stat_annual_mann_kendall": f"""WITH {_kendall(_ANNUAL, 'gauge_id')}, z AS (SELECT *, {_KENDALL_Z} AS z FROM mk), p AS (SELECT *, {tail('z')} AS p FROM z)
      SELECT gauge_id, {num(s='s', var_s='v', z='z', p_value='p', tau='s / nullif(n * (n - 1) / 2, 0)', sen_slope='sen')}, p < 0.05 AS significant, CASE WHEN NOT p < 0.05 THEN 'no trend' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM p""",
    "stat_seasonal_mann_kendall": f"""WITH {_kendall(_MONTHLY, 'gauge_id, month')}, g AS (SELECT gauge_id, sum(s) AS s, sum(v) AS v, quantile_cont(sen, 0.5) AS sen FROM mk GROUP BY 1), z AS (SELECT *, {_KENDALL_Z} AS z FROM g)
      SELECT gauge_id, {num(s='s', var_s='v', z='z', p_value=tail('z'), sen_slope='sen')} FROM z""",
    "stat_pettitt": f"""{_T}, k AS (SELECT *, rank() OVER (PARTITION BY gauge_id ORDER BY q) + (count(*) OVER (PARTITION BY gauge_id, q) - 1) / 2.0 AS r FROM o),
      u AS (SELECT *, abs(2 * sum(r) OVER (PARTITION BY gauge_id ORDER BY date) - t * (n + 1)) AS u FROM k QUALIFY t < n),
      b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY u DESC, t) = 1), p AS (SELECT *, 2 * exp(-6 * u * u / (pow(n, 3) + pow(n, 2))) AS p FROM b)
      SELECT gauge_id, {num(kt_statistic='u')}, CAST(t - 1 AS INTEGER) AS change_point_index, CAST(date AS VARCHAR) AS change_date, {num(p_value='p')}, p < 0.05 AS change_point_detected FROM p""",
    "stat_buishand": f"""{_T}, a AS (SELECT *, q - avg(q) OVER (PARTITION BY gauge_id) AS a FROM o), c AS (SELECT *, sum(a) OVER (PARTITION BY gauge_id ORDER BY date) AS c FROM a),
      s AS (SELECT gauge_id, (max(c) - min(c)) / nullif(stddev_samp(q) * sqrt(count(*)), 0) AS s, CASE WHEN count(*) >= 50 THEN 1.747 ELSE 1.4 + 0.3 * log10(count(*)) END AS cr FROM c GROUP BY 1)
      SELECT gauge_id, {num(q_statistic='s', critical_value='cr')}, s < cr AS homogeneous FROM s""",
    "stat_snht": f"""{_T}, z AS (SELECT *, (q - avg(q) OVER (PARTITION BY gauge_id)) / nullif(stddev_samp(q) OVER (PARTITION BY gauge_id), 0) AS z FROM o),
      c AS (SELECT *, sum(z) OVER (PARTITION BY gauge_id ORDER BY date) AS c, sum(z) OVER (PARTITION BY gauge_id) AS al FROM z), v AS (SELECT *, c * c / t + pow(al - c, 2) / nullif(n - t, 0) AS v FROM c WHERE t < n),
      b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY v DESC, t) = 1)
      SELECT gauge_id, {num(t_statistic='v', critical_value='8.45')}, CAST(t - 1 AS INTEGER) AS change_point_index, v > 8.45 AS change_point_detected FROM b""",
    "stat_von_neumann": f"""{_T}, d AS (SELECT *, q - lag(q) OVER (PARTITION BY gauge_id ORDER BY date) AS c FROM o), s AS (SELECT gauge_id, sum(c * c) / nullif(var_pop(q) * count(*), 0) AS v, count(*)::DOUBLE AS n FROM d GROUP BY 1),
      z AS (SELECT *, (v - 2) / sqrt(4 * (n - 2) / ((n + 1) * (n - 1))) AS z FROM s) SELECT gauge_id, {num(von_neumann_ratio='v', z_statistic='z', p_value=tail('z'))}, {tail('z')} > 0.05 AS random FROM z""",
    "stat_runs": f"""{_T}, m AS (SELECT gauge_id, quantile_cont(q, 0.5) AS m FROM o GROUP BY 1), u AS (SELECT o.*, q > m AS up FROM o JOIN m USING (gauge_id)), c AS (SELECT *, coalesce(up <> lag(up) OVER (PARTITION BY gauge_id ORDER BY date), true) AS nw FROM u),
      s AS (SELECT gauge_id, count(*) FILTER (nw) AS rn, count(*) FILTER (up)::DOUBLE AS a, count(*) FILTER (NOT up)::DOUBLE AS b, count(*)::DOUBLE AS n FROM c GROUP BY 1), e AS (SELECT *, 2 * a * b / n + 1 AS ex FROM s),
      z AS (SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE coalesce((rn + CASE WHEN rn > ex THEN -0.5 ELSE 0.5 END - ex) / nullif(sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1))), 0), 0) END AS z FROM e),
      p AS (SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE {tail('z')} END AS p FROM z)
      SELECT gauge_id, rn AS runs, {num(expected_runs='CASE WHEN a = 0 OR b = 0 THEN 0 ELSE ex END', z_statistic='z', p_value='p')}, p > 0.05 AS random FROM p""",
    "stat_ljung_box": f"""{_T}, l AS (SELECT gauge_id, n, q, {", ".join(f"lag(q, {k}) OVER w AS l{k}" for k in range(1, 11))} FROM o WINDOW w AS (PARTITION BY gauge_id ORDER BY date) QUALIFY n >= 15)
      SELECT gauge_id, {num(lb_statistic='count(*)::DOUBLE * (count(*) + 2) * (' + ' + '.join(f'pow(coalesce(covar_pop(q, l{k}) / nullif(stddev_pop(q) FILTER (l{k} IS NOT NULL) * stddev_pop(l{k}), 0), 0), 2) / (count(*) - {k})' for k in range(1, 11)) + ')')}, 10 AS degrees_of_freedom FROM l GROUP BY gauge_id""",
    "stat_variance_changes": f"""WITH ts AS ({FLOW}), o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY gauge_id) AS n, CASE WHEN count(*) OVER h = 50 THEN var_samp(q) OVER h END AS v FROM ts
      WINDOW w AS (PARTITION BY gauge_id ORDER BY date), h AS (PARTITION BY gauge_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)), d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY gauge_id ORDER BY date)) AS c FROM o WHERE n >= 100),
      k AS (SELECT gauge_id, quantile_cont(c, 0.95) AS lim FROM d GROUP BY 1) SELECT gauge_id, CAST(date AS VARCHAR) AS date, CAST(i - 1 AS INTEGER) AS index, {num(variance_change='c')} FROM d JOIN k USING (gauge_id) WHERE c > lim""",
}
