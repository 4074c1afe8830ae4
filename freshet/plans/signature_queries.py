"""Signature queries and the SQL that states the same."""

from __future__ import annotations

from freshet.functions.expr import rounded
from freshet.operators import models
from freshet.operators import signatures as s
from freshet.plans.panels import FLAG_FLOW, FLOW, HYDRO_YEAR, RAIN, SEASON, cv, flag_flow, flow, num, positive, rain, slope


def _q(p: float) -> str:
    return f"quantile_cont(q, {p})"


def on(operator, panel=flow):
    return lambda spark, sf_dir: rounded(operator(panel(spark, sf_dir)))


QUERIES = {
    "sig_duration_curve": on(s.duration_curve),
    "sig_duration_metrics": on(s.duration_metrics),
    "sig_regime_classes": on(s.regime_classes),
    "sig_baseflow_regime": on(s.baseflow_regime),
    "sig_flow_quantiles": on(s.flow_quantiles),
    "sig_high_flows": on(s.high_flows),
    "sig_low_flows": on(s.low_flows),
    "sig_drought_indices": on(s.drought_indices),
    "sig_flood_indices": on(s.flood_indices, flag_flow),
    "sig_extreme_ratios": on(s.extreme_ratios),
    "sig_half_flow_date": on(s.half_flow_date, flag_flow),
    "sig_seasonal_flows": on(s.seasonal_flows),
    "sig_extreme_timing": on(s.extreme_timing, flag_flow),
    "sig_regime_stability": on(s.regime_stability, flag_flow),
    "sig_basic_statistics": on(s.basic_statistics),
    "sig_temporal_variability": on(s.temporal_variability),
    "sig_autocorrelation": on(s.autocorrelation),
    "sig_flashiness": on(s.flashiness),
    "sig_seasonal_variability": on(s.seasonal_variability),
    "sig_interannual_variability": on(s.interannual_variability),
    "sig_stability_index": on(s.stability_index),
    "sig_magnitude_indices": on(s.magnitude_indices),
    "sig_frequency_duration_indices": on(s.frequency_duration_indices),
    "sig_timing_indices": on(s.timing_indices, flag_flow),
    "sig_rate_indices": on(s.rate_indices),
    "sig_extreme_metrics": on(s.extreme_metrics, flag_flow),
    "sig_timing_metrics": on(s.timing_metrics, flag_flow),
    "sig_variability_metrics": on(s.variability_metrics),
    "sig_comprehensive": lambda spark, d: rounded(s.comprehensive(flag_flow(spark, d), models.baseflow_stats(flag_flow(spark, d)))),
    "sig_period_metrics": on(lambda x: s.period_metrics(x, baseflow=False)),
    "sig_period_metrics_with_baseflow": on(s.period_metrics),
    "sig_period_aggregate": lambda spark, d: rounded(s.aggregated_periods(s.period_metrics(flow(spark, d), baseflow=False))),
    "sig_baseflow_index": on(s.baseflow_index),
    "sig_runoff_ratio": lambda spark, d: rounded(s.runoff_ratio(flag_flow(spark, d), rain(spark, d))),
}


def _runs(mask: str, stats: str, source: str = FLOW) -> str:
    """Rows with statistics of their gauge (st), the mask (m), and its runs (ev: start, stop, duration)."""
    return f"""ts AS ({source}), st AS (SELECT gauge_id, {stats} FROM ts GROUP BY 1),
    m AS (SELECT ts.*, st.* EXCLUDE (gauge_id), ({mask}) AS hit, lead(date) OVER w AS after FROM ts JOIN st USING (gauge_id) WINDOW w AS (PARTITION BY gauge_id ORDER BY date)),
    m2 AS (SELECT *, coalesce(lag(hit) OVER w, false) AS was FROM m WINDOW w AS (PARTITION BY gauge_id ORDER BY date)),
    m3 AS (SELECT *, sum(CASE WHEN hit AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY gauge_id ORDER BY date) AS run FROM m2),
    ev AS (SELECT gauge_id, run, date_diff('day', min(date), coalesce(max(after), max(date))) + 1 AS duration FROM m3 WHERE hit GROUP BY 1, 2)"""


def _flows(name: str, op: str, base: str, factor: float, extreme: str, far: str) -> str:
    return f"""WITH {_runs(f'q {op} t', f'{base} * {factor} AS t')}, e AS (SELECT gauge_id, count(*) AS n, avg(duration) AS a, max(duration) AS x FROM ev GROUP BY 1),
    b AS (SELECT gauge_id, any_value(t) AS t, count(*) FILTER (hit) * 100.0 / count(*) AS f, avg(q) FILTER (hit) AS m, {far}(q) FILTER (hit) AS x FROM m GROUP BY 1)
    SELECT gauge_id, {num(**{f'{name}_threshold': 't', f'{name}_frequency': 'f', f'{name}_mean': 'm', f'{name}_{extreme}': 'b.x'})},
      coalesce(n, 0) AS {name}_events, {num(**{f'{name}_avg_duration': 'coalesce(a, 0)', f'{name}_max_duration': 'coalesce(e.x, 0)'})}
    FROM b LEFT JOIN e USING (gauge_id)"""


def _agg(source: str = FLOW, **columns: str) -> str:
    return f"WITH ts AS ({source}) SELECT gauge_id, {num(**columns)} FROM ts GROUP BY gauge_id"


_DIFF = """d AS (SELECT *, q - lag(q) OVER w AS c, row_number() OVER w AS i, avg(q) OVER (PARTITION BY gauge_id ORDER BY date ROWS 6 PRECEDING) AS w7
  FROM ts WINDOW w AS (PARTITION BY gauge_id ORDER BY date))"""

_DAYS = """d AS (SELECT gauge_id, year(date) AS y, count(*) AS n, arg_max(date, (q, -epoch(date))) AS hi, arg_min(date, (q, epoch(date))) AS lo FROM ts GROUP BY 1, 2)"""


def _period() -> str:
    return f"""ts0 AS ({FLOW}), ts AS (SELECT gauge_id || '|' || {HYDRO_YEAR} AS gauge_id, gauge_id AS g, {HYDRO_YEAR} AS period, date, q FROM ts0)"""


def _period_table() -> str:
    runs = {}
    for name, op, base, factor in (("high", ">", "quantile_cont(q, 0.5)", 2.0), ("low", "<", "avg(q)", 0.2)):
        runs[name] = f"""{name}_m AS (SELECT *, q {op} {factor} * {base} OVER (PARTITION BY gauge_id) AS hit, lead(date) OVER (PARTITION BY gauge_id ORDER BY date) AS after FROM ts),
        {name}_r AS (SELECT *, sum(CASE WHEN hit AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY gauge_id ORDER BY date) AS run FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY gauge_id ORDER BY date), false) AS was FROM {name}_m)),
        {name}_e AS (SELECT gauge_id, avg(duration) AS a FROM (SELECT gauge_id, run, date_diff('day', min(date), coalesce(max(after), max(date))) + 1 AS duration FROM {name}_r WHERE hit GROUP BY 1, 2) GROUP BY 1),
        {name}_f AS (SELECT gauge_id, count(*) FILTER (hit) * 100.0 / count(*) AS f FROM {name}_m GROUP BY 1)"""
    hfd = """h1 AS (SELECT gauge_id, date, sum(q) OVER (PARTITION BY gauge_id ORDER BY date) AS c, sum(q) OVER (PARTITION BY gauge_id) AS t, count(*) OVER (PARTITION BY gauge_id) AS n FROM ts),
      h AS (SELECT gauge_id, CASE WHEN month(min(date)) >= 10 THEN dayofyear(min(date)) - 273 ELSE dayofyear(min(date)) + 92 END AS d FROM h1 WHERE n >= 300 AND c >= t / 2 GROUP BY 1)"""
    table = f"""pm AS (SELECT any_value(g) AS g, any_value(period) AS period, avg(q) AS mean_discharge, quantile_cont(q, 0.5) AS median_discharge, stddev_pop(q) AS std_discharge, sum(q) AS total_discharge,
      {positive('stddev_pop(q)', 'avg(q)')} AS cv_discharge, {slope()} AS fdc_slope, {_q(.95)} AS q05, {_q(.5)} AS q50, {_q(.05)} AS q95, gauge_id FROM ts GROUP BY gauge_id),
      pt AS (SELECT pm.* EXCLUDE (gauge_id, g), g AS gauge_id, high_f.f AS high_flow_frequency, coalesce(high_e.a, 0) AS high_flow_avg_duration, low_f.f AS low_flow_frequency,
      coalesce(low_e.a, 0) AS low_flow_avg_duration, h.d AS mean_half_flow_date FROM pm LEFT JOIN high_f USING (gauge_id) LEFT JOIN high_e USING (gauge_id)
      LEFT JOIN low_f USING (gauge_id) LEFT JOIN low_e USING (gauge_id) LEFT JOIN h USING (gauge_id))"""
    return f"WITH {_period()}, {runs['high']}, {runs['low']}, {hfd}, {table}"


PERIOD_COLUMNS = [
    "mean_discharge", "median_discharge", "std_discharge", "total_discharge", "cv_discharge", "fdc_slope", "q05", "q50", "q95",
    "high_flow_frequency", "high_flow_avg_duration", "low_flow_frequency", "low_flow_avg_duration", "mean_half_flow_date",
]

ORACLE_SQL = {
    "sig_duration_curve": f"""WITH ts AS ({FLOW}), r AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY q DESC, date) AS k, count(*) OVER (PARTITION BY gauge_id) AS n FROM ts)
      SELECT gauge_id, CAST(k AS INTEGER) AS rank, {num(exceedance_probability='k * 100.0 / (n + 1)', discharge='q')} FROM r""",
    "sig_duration_metrics": _agg(
        **{f"q{p:02d}": _q((100 - p) / 100) for p in s.PERCENTILES}, fdc_slope=slope(), q5_q95_ratio=positive(_q(.95), _q(.05)),
        q5_q50_ratio=positive(_q(.95), _q(.5)), q50_q95_ratio=positive(_q(.5), _q(.05)), iqr_median_ratio=positive(f"({_q(.75)} - {_q(.25)})", _q(.5)),
        mean_flow="avg(q)", median_flow=_q(.5), cv_flow=cv("q"), skewness="skewness(q)", kurtosis="kurtosis(q)",
    ),
    "sig_regime_classes": f"""WITH ts AS ({FLOW}), a AS (SELECT gauge_id, {slope()} AS sl, {cv('q')} AS c FROM ts GROUP BY 1),
      b AS (SELECT *, CASE WHEN sl < -1.5 THEN 'steep' WHEN sl > -0.5 THEN 'flat' ELSE 'moderate' END AS slope_class, CASE WHEN c < 0.5 THEN 'low' WHEN c > 1.5 THEN 'high' ELSE 'moderate' END AS variability_class FROM a)
      SELECT gauge_id, CASE WHEN slope_class = 'steep' AND variability_class = 'high' THEN 'flashy' WHEN slope_class = 'flat' AND variability_class = 'low' THEN 'stable'
      WHEN slope_class = 'moderate' THEN 'intermediate' ELSE variability_class || '_' || slope_class END AS flow_regime, slope_class, variability_class, {num(fdc_slope='sl', coefficient_variation='c')} FROM b""",
    "sig_baseflow_regime": f"""WITH ts AS ({FLOW}), a AS (SELECT gauge_id, {slope()} AS sl, {cv('q')} AS c, {positive(_q(.05), 'avg(q)')} AS b FROM ts GROUP BY 1)
      SELECT gauge_id, CASE WHEN sl IS NULL OR c IS NULL THEN 'unclassified' WHEN sl < -2 AND c > 1 THEN 'flashy' WHEN sl > -0.8 AND c < 0.7 THEN 'baseflow_dominated'
      WHEN sl BETWEEN -2 AND -0.8 THEN 'intermediate' ELSE 'variable' END AS regime_classification, {num(coefficient_of_variation='c', fdc_slope='sl', baseflow_ratio='b')} FROM a""",
    "sig_flow_quantiles": _agg(q01_0=_q(.01), q05_0=_q(.05), q10_0=_q(.1), q90_0=_q(.9), q95_0=_q(.95), q99_0=_q(.99)),
    "sig_high_flows": _flows("high_flow", ">", _q(.5), 2.0, "max", "max"),
    "sig_low_flows": _flows("low_flow", "<", "avg(q)", 0.2, "min", "min"),
    "sig_drought_indices": f"""WITH ts AS ({FLOW}), st AS (SELECT gauge_id, {_q(.05)} AS a, {_q(.1)} AS b, avg(q) AS m, {_q(.5)} AS h FROM ts GROUP BY 1)
      SELECT gauge_id, {num(q95_flow='any_value(a)', q90_flow='any_value(b)', bfi_approx=positive('any_value(a)', 'any_value(m)'), low_flow_cv='stddev_pop(q) FILTER (q <= a) / nullif(avg(q) FILTER (q <= a), 0)', q95_ratio=positive('any_value(a)', 'any_value(h)'))}
      FROM ts JOIN st USING (gauge_id) GROUP BY gauge_id""",
    "sig_flood_indices": f"""WITH ts AS ({FLAG_FLOW}), y AS (SELECT gauge_id, max(q) AS p FROM ts GROUP BY gauge_id, year(date) HAVING count(*) > 300), f AS (SELECT gauge_id, avg(p) AS p FROM y GROUP BY 1),
      st AS (SELECT ts.gauge_id, coalesce(any_value(p), avg(q)) AS fl, avg(q) AS m FROM ts LEFT JOIN f USING (gauge_id) GROUP BY 1), {_DIFF}
      SELECT gauge_id, {num(q05_flow=_q(.95), q10_flow=_q(.9), mean_annual_flood='any_value(fl)', flood_threshold='2 * any_value(fl)', flood_frequency='count(*) FILTER (q > 2 * fl) * 100.0 / count(*)', max_daily_rise='max(c)', mean_daily_rise='avg(c) FILTER (c > 0)', flood_flashiness=positive('max(c)', 'any_value(m)'))}
      FROM d JOIN st USING (gauge_id) GROUP BY gauge_id""",
    "sig_extreme_ratios": _agg(
        q05_q95_ratio=positive(_q(.95), _q(.05)), q05_q50_ratio=positive(_q(.95), _q(.5)), q50_q95_ratio=positive(_q(.5), _q(.05)),
        extreme_range_ratio=positive(f"({_q(.95)} - {_q(.05)})", _q(.5)),
    ),
    "sig_half_flow_date": f"""WITH ts AS ({FLAG_FLOW}), h1 AS (SELECT gauge_id, date, {HYDRO_YEAR} AS y, sum(q) OVER (PARTITION BY gauge_id, {HYDRO_YEAR} ORDER BY date) AS c, sum(q) OVER (PARTITION BY gauge_id, {HYDRO_YEAR}) AS t, count(*) OVER (PARTITION BY gauge_id, {HYDRO_YEAR}) AS n FROM ts),
      h AS (SELECT gauge_id, min(date) AS d FROM h1 WHERE n >= 300 AND c >= t / 2 GROUP BY gauge_id, y), k AS (SELECT gauge_id, CASE WHEN month(d) >= 10 THEN dayofyear(d) - 273 ELSE dayofyear(d) + 92 END AS v FROM h)
      SELECT gauge_id, {num(hfd_mean='avg(v)', hfd_std='stddev_pop(v)')} FROM (SELECT DISTINCT gauge_id FROM ts) LEFT JOIN k USING (gauge_id) GROUP BY gauge_id""",
    "sig_seasonal_flows": f"WITH ts AS (SELECT *, {SEASON} AS s FROM ({FLOW})) SELECT gauge_id, " + num(
        **{f"{n}_{k}": sql.replace("q)", f"q) FILTER (s = '{n}')") for n in s.SEASONS for k, sql in (("mean", "avg(q)"), ("std", "stddev_pop(q)"), ("cv", "stddev_pop(q) / nullif(avg(q), 0)"))},
    ) + ", " + num(**{f"{n}_ratio": f"avg(q) FILTER (s = '{n}') / nullif(avg(q), 0)" for n in s.SEASONS}) + " FROM ts GROUP BY gauge_id",
    "sig_extreme_timing": f"""WITH ts AS ({FLAG_FLOW}), {_DAYS} SELECT gauge_id, {num(max_timing_mean='avg(dayofyear(hi))', max_timing_std='stddev_pop(dayofyear(hi))', min_timing_mean='avg(dayofyear(lo))', min_timing_std='stddev_pop(dayofyear(lo))')}
      FROM (SELECT DISTINCT gauge_id FROM ts) LEFT JOIN (SELECT * FROM d WHERE n >= 300) USING (gauge_id) GROUP BY gauge_id""",
    "sig_timing_indices": f"""WITH ts AS ({FLAG_FLOW}), {_DAYS} SELECT gauge_id, {num(ta01='avg(dayofyear(hi))', ta02='avg(dayofyear(lo))')}
      FROM (SELECT DISTINCT gauge_id FROM ts) LEFT JOIN (SELECT * FROM d WHERE n > 300) USING (gauge_id) GROUP BY gauge_id""",
    "sig_regime_stability": f"""WITH ts AS (SELECT *, {SEASON} AS s, count(*) OVER (PARTITION BY gauge_id, year(date)) AS n FROM ({FLAG_FLOW})), y AS (SELECT gauge_id, year(date) AS y, s, avg(q) AS m FROM ts WHERE n >= 300 GROUP BY 1, 2, 3)
      SELECT gauge_id, {num(**{f'{n}_interannual_cv': f"CASE WHEN count(m) FILTER (s = '{n}') > 1 THEN stddev_pop(m) FILTER (s = '{n}') / nullif(avg(m) FILTER (s = '{n}'), 0) END" for n in s.SEASONS})}
      FROM (SELECT DISTINCT gauge_id FROM ts) LEFT JOIN y USING (gauge_id) GROUP BY gauge_id""",
    "sig_basic_statistics": _agg(
        mean="avg(q)", median=_q(.5), std="stddev_pop(q)", variance="var_pop(q)", cv=cv("q"), skewness="skewness(q)", kurtosis="kurtosis(q)",
        min="min(q)", max="max(q)", range="max(q) - min(q)", iqr=f"{_q(.75)} - {_q(.25)}",
    ),
    "sig_temporal_variability": f"""WITH ts AS ({FLOW}), {_DIFF}, e AS (SELECT *, CASE WHEN i >= 7 THEN w7 END AS w FROM d), f AS (SELECT *, w - lag(w) OVER (PARTITION BY gauge_id ORDER BY date) AS wd FROM e),
      mo AS (SELECT gauge_id, avg(q) AS v FROM ts GROUP BY gauge_id, date_trunc('month', date)), mm AS (SELECT gauge_id, CASE WHEN count(*) > 1 THEN {cv('v')} END AS mc FROM mo GROUP BY 1)
      SELECT gauge_id, {num(daily_change_mean='avg(c)', daily_change_std='stddev_pop(c)', daily_change_cv='stddev_pop(c) / nullif(abs(avg(c)), 0)', weekly_change_std='CASE WHEN count(*) > 7 THEN stddev_pop(wd) END', weekly_cv=f"CASE WHEN count(*) > 7 THEN {cv('w')} END", monthly_cv='CASE WHEN count(*) > 30 THEN any_value(mc) END')}
      FROM f JOIN mm USING (gauge_id) GROUP BY gauge_id""",
    "sig_autocorrelation": f"WITH ts AS ({FLOW}), l AS (SELECT gauge_id, q, " + ", ".join(f"lag(q, {k}) OVER w AS l{k}" for k in (1, 7, 30, 365)) + " FROM ts WINDOW w AS (PARTITION BY gauge_id ORDER BY date)) SELECT gauge_id, " + num(
        **{f"lag{k}_autocorr": ("coalesce({})" if k == 1 else "{}").format(f"covar_pop(q, l{k}) / nullif(stddev_pop(q) FILTER (l{k} IS NOT NULL) * stddev_pop(l{k}), 0)" + (", 0" if k == 1 else "")) for k in (1, 7, 30, 365)}
    ) + " FROM l GROUP BY gauge_id",
    "sig_flashiness": f"""WITH ts AS ({FLOW}), {_DIFF} SELECT gauge_id, {num(flashiness_index=positive('sum(abs(c))', 'sum(q) FILTER (c IS NOT NULL)'), mean_abs_daily_change='avg(abs(c))', max_abs_daily_change='max(abs(c))', cv_daily_changes=cv('abs(c)'))} FROM d GROUP BY gauge_id""",
    "sig_seasonal_variability": f"""WITH ts AS ({FLOW}), m AS (SELECT gauge_id, month(date) AS m, avg(q) AS v, stddev_samp(q) AS s FROM ts GROUP BY 1, 2) SELECT gauge_id, {num(seasonal_cv=cv('v'), seasonal_range='max(v) - min(v)', max_monthly_mean='max(v)', min_monthly_mean='min(v)', seasonal_ratio=positive('max(v)', 'min(v)'), avg_within_month_cv='avg(s / nullif(v, 0))')} FROM m GROUP BY gauge_id""",
    "sig_interannual_variability": f"""WITH ts AS ({FLOW}), y AS (SELECT gauge_id, year(date) AS y, avg(q) AS v, max(q) AS h, min(q) AS l FROM ts GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY y) AS i FROM y)
      SELECT gauge_id, {num(interannual_cv=f"CASE WHEN count(*) >= 2 THEN {cv('v')} END", max_annual_ratio='CASE WHEN count(*) >= 2 THEN max(v) / nullif(min(v), 0) END', annual_max_cv=f"CASE WHEN count(*) >= 2 THEN {cv('h')} END", annual_min_cv=f"CASE WHEN count(*) >= 2 THEN {cv('l')} END", annual_trend='CASE WHEN count(*) >= 3 THEN regr_slope(v, i) END')} FROM z GROUP BY gauge_id""",
    "sig_stability_index": f"""WITH ts AS ({FLOW}), {_DIFF}, l AS (SELECT *, lag(q) OVER (PARTITION BY gauge_id ORDER BY date) AS l1 FROM d),
      a AS (SELECT gauge_id, least({cv('q')} / 2, 1.0) AS c1, greatest(0.0, coalesce(covar_pop(q, l1) / nullif(stddev_pop(q) FILTER (l1 IS NOT NULL) * stddev_pop(l1), 0), 0)) AS c2, coalesce(least(({positive('sum(abs(c))', 'sum(q) FILTER (c IS NOT NULL)')}) / 0.5, 1.0), 0.5) AS c3 FROM l GROUP BY 1)
      SELECT gauge_id, {num(stability_index='greatest(0, least(1, 1 - (c1 * 0.4 + (1 - c2) * 0.3 + c3 * 0.3)))', cv_component='c1', autocorr_component='c2', flashiness_component='c3')} FROM a""",
    "sig_magnitude_indices": f"""WITH ts AS ({FLOW}), m AS (SELECT gauge_id, month(date) AS m, avg(q) AS v FROM ts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY m) AS i FROM m),
      w AS (SELECT gauge_id, {", ".join(f"max(v) FILTER (i = {i + 1}) AS ma{i + 3:02d}" for i in range(12))} FROM r GROUP BY 1), o AS (SELECT gauge_id, avg(q) AS ma01, {_q(.5)} AS ma02, stddev_pop(q) AS ma15, {positive('stddev_pop(q)', 'avg(q)')} AS ma16 FROM ts GROUP BY 1)
      SELECT gauge_id, {num(ma01='ma01', ma02='ma02', ma15='ma15', ma16='ma16', **{f'ma{i + 3:02d}': f'w.ma{i + 3:02d}' for i in range(12)})} FROM o JOIN w USING (gauge_id)""",
    "sig_rate_indices": f"""WITH ts AS ({FLOW}), {_DIFF}, e AS (SELECT *, c - lag(c) OVER (PARTITION BY gauge_id ORDER BY date) AS dd FROM d)
      SELECT gauge_id, {num(ra01='coalesce(avg(c) FILTER (c > 0), 0)', ra02='coalesce(quantile_cont(c, 0.5) FILTER (c > 0), 0)', ra03='coalesce(avg(-c) FILTER (c < 0), 0)', ra04='coalesce(quantile_cont(-c, 0.5) FILTER (c < 0), 0)', ra05='count(*) FILTER (dd IS NULL OR dd <> 0)')} FROM e WHERE c IS NOT NULL GROUP BY gauge_id""",
    "sig_period_metrics": f"{_period_table()} SELECT gauge_id, period, {num(**{c: c for c in PERIOD_COLUMNS})} FROM pt",
    "sig_period_aggregate": f"""{_period_table()} SELECT gauge_id, {num(**{c: f'CASE WHEN count(*) >= 3 AND count({c}) >= 3 THEN avg({c}) END' for c in PERIOD_COLUMNS})},
      CASE WHEN count(*) >= 3 THEN count(*) END AS n_valid_periods, {num(mean_discharge_std='CASE WHEN count(*) >= 3 THEN stddev_pop(mean_discharge) END', mean_discharge_cv='CASE WHEN count(*) >= 3 AND avg(mean_discharge) > 0 THEN stddev_pop(mean_discharge) / avg(mean_discharge) END')} FROM pt GROUP BY gauge_id""",
    "sig_runoff_ratio": f"""WITH q AS (SELECT gauge_id, {HYDRO_YEAR} AS y, sum(q) AS q FROM ({FLAG_FLOW}) GROUP BY 1, 2), p AS (SELECT gauge_id, {HYDRO_YEAR} AS y, sum(p) AS p FROM ({RAIN}) GROUP BY 1, 2)
      SELECT gauge_id, {num(runoff_ratio='CASE WHEN count(*) FILTER (p > 0) >= 3 THEN avg(q / p) FILTER (p > 0) END')} FROM q JOIN p USING (gauge_id, y) GROUP BY gauge_id""",
}
ORACLE_SQL["sig_frequency_duration_indices"] = f"""
  WITH ts AS ({FLOW}), st AS (SELECT gauge_id, 3 * {_q(.5)} AS th, 0.1 * avg(q) AS tl FROM ts GROUP BY 1),
  m AS (SELECT gauge_id, date, k, CASE WHEN k = 'h' THEN q > th ELSE q < tl END AS hit, lead(date) OVER (PARTITION BY gauge_id, k ORDER BY date) AS after FROM ts JOIN st USING (gauge_id), (VALUES ('h'), ('l')) v(k)),
  n AS (SELECT *, lag(hit) OVER (PARTITION BY gauge_id, k ORDER BY date) AS was FROM m),
  r AS (SELECT *, sum(CASE WHEN hit AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY gauge_id, k ORDER BY date) AS run FROM n),
  f AS (SELECT gauge_id, k, count(*) FILTER (hit) * 100.0 / count(*) AS f1, count(*) FILTER (hit AND NOT was) AS f2 FROM n GROUP BY 1, 2),
  e AS (SELECT gauge_id, k, avg(d) AS d1, max(d) AS d2 FROM (SELECT gauge_id, k, run, date_diff('day', min(date), coalesce(max(after), max(date))) + 1 AS d FROM r WHERE hit GROUP BY 1, 2, 3) GROUP BY 1, 2),
  w AS (SELECT * FROM f LEFT JOIN e USING (gauge_id, k))
  SELECT gauge_id, {num(**{f'f{k}01': f"max(f1) FILTER (k = '{k}')" for k in 'hl'}, **{f'f{k}02': f"max(f2) FILTER (k = '{k}')" for k in 'hl'}, **{f'd{k}01': f"coalesce(max(d1) FILTER (k = '{k}'), 0)" for k in 'hl'}, **{f'd{k}02': f"coalesce(max(d2) FILTER (k = '{k}'), 0)" for k in 'hl'})}
  FROM w GROUP BY gauge_id"""
