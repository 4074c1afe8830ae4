"""Spatial, cluster, model and ingestion queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.expr import rounded
from freshet.operators import clusters as c
from freshet.operators import features, models
from freshet.operators import spatial as g
from freshet.plans.panels import FLAG_FLOW, flag_flow, flow, num, rain, read
from freshet.streaming.ingest import daily_means


def _points(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))


def _rings(spark, d):
    n = F.col("n_nationkey").cast("double")
    corner = lambda a, b: F.struct((n * 5 - 60 + a).alias("lon"), (n / 2 + 40 + b).alias("lat"))
    return read(spark, d, "nation").select(F.col("n_name").alias("gauge_id"), F.array(corner(0, 0), corner(1.3, 0.1), corner(1.1, 0.9), corner(0.2, 0.7)).alias("ring"))


def _areas(spark, d):
    rows = _rings(spark, d)
    area = g.polygon_area("ring")
    return rounded(rows.select("gauge_id", area.alias("area"), g.buffer_degrees(area).alias("buffer"), g.utm_zone(F.col("ring")[0]["lon"]).alias("zone"), g.within_longitude("ring", 0.0).alias("west")))


def _hexed(spark, d):
    q, r = g.hexagon("x", "y", 500.0)
    return _points(spark, d).select("s_suppkey", "s_nationkey", "x", q.alias("q"), r.alias("r"))


def _grid(spark, d):
    rows = read(spark, d, "orders")
    return rows.groupBy(F.to_date("o_orderdate").alias("time"), (F.col("o_custkey") % 3).cast("long").alias("ix"), (F.col("o_custkey") % 2).cast("long").alias("iy")).agg((F.sum("o_totalprice") / 997).alias("value"))


def _weights(spark, d):
    cells = spark.range(3).select(F.col("id").alias("ix")).crossJoin(F.broadcast(spark.range(2).select(F.col("id").alias("iy"))))
    n = F.col("n_nationkey")
    rows = read(spark, d, "nation").crossJoin(F.broadcast(cells))  # six cells
    return rows.select(F.col("n_name").alias("gauge_id"), "ix", "iy", ((n + F.col("ix") * 2 + F.col("iy") + 1) / 100).alias("w"))


def _areal(summed):
    return lambda s, d: rounded(g.areal_series(_grid(s, d), _weights(s, d), "prcp" if summed else "t2m"))


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _gauges(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("gauge_id"), (F.col("c_nationkey") % 4).alias("geo"), F.col("c_mktsegment").alias("hydro"), "c_nationkey")


def _patterns(spark, d):
    return c.cycles(features.seasonal_cycle(flag_flow(spark, d))).where(F.forall("pattern", lambda v: v.isNotNull()))


def _trials(spark, d):
    rows = read(spark, d, "part").where("p_size > 0")
    return rows.select(
        F.col("p_brand").alias("gauge_id"), F.col("p_partkey").alias("trial"), (F.col("p_size") / 50).alias("KGE"),
        (F.col("p_partkey") % 97 / 97).alias("low_flow"), (F.col("p_retailprice") / 2000).alias("high_flow"),
    )


OBJECTIVES = {"KGE": 0.4, "low_flow": 0.35, "high_flow": 0.25}


def _select(method):
    return lambda s, d: rounded(models.selected(models.pareto_front(_trials(s, d), list(OBJECTIVES), ["gauge_id"]), OBJECTIVES, ["gauge_id"], method))


def _forcing(spark, d):
    """Flow, rain and a made-up temperature of the three flags."""
    rows = flag_flow(spark, d).join(rain(spark, d), ["gauge_id", "date"])
    t = 12 * F.sin(2 * 3.141592653589793 * (F.dayofyear("date") - 110) / 365) + 4
    return rows.select("gauge_id", "date", (F.col("p") / 100).alias("prcp"), features.pet_oudin(t, F.dayofyear("date"), F.lit(55.0)).alias("pet"), t.alias("t_mean"), (F.col("q") / 50).alias("q"))


def _simulated(model, params):
    def run(spark, d):
        sets = flag_flow(spark, d).select("gauge_id").distinct().withColumn("params", F.array(*map(F.lit, params)))
        return rounded(models.simulate(_forcing(spark, d), sets, model))

    return run


def _forest(spark, d):
    rows = features.rolling(_forcing(spark, d), {"prcp": "sum", "t_mean": "mean"}, (1, 2, 4, 8))
    names = [x for x in rows.columns if x.endswith("d") and "_" in x and x != "gauge_id"]
    model = models.forest(rows, names)
    return rounded(models.predicted(model, rows, names).select("gauge_id", "date", "q", "q_sim"))


def _without(spark, d):
    rows = features.rolling(_forcing(spark, d), {"prcp": "sum", "t_mean": "mean"}, (1, 4))
    names = [x for x in rows.columns if x.endswith("d") and "_" in x and x != "gauge_id"]
    return rounded(models.leave_one_basin_out(rows, names, ["A", "N"], trees=20, depth=6))


def _readings(spark, d):
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("gauge_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("level"))


QUERIES = {
    "geo_areas": _areas,
    "geo_hexagons": lambda s, d: rounded(_hexed(s, d)),
    "geo_hex_neighbours": lambda s, d: g.neighbours(_hexed(s, d).select("q", "r").distinct()),
    "geo_hex_values": lambda s, d: rounded(g.hex_values(_hexed(s, d), ["q", "r"], "x")),
    "geo_hex_dominant": lambda s, d: rounded(g.dominant(_hexed(s, d), ["q", "r"], "s_nationkey", 2, 0.33)),
    "geo_contingency": lambda s, d: rounded(g.contingency(_gauges(s, d), "geo", "hydro")),
    "geo_suggested_radius": lambda s, d: rounded(g.suggested_radius(read(s, d, "part"), "p_retailprice")),
    "geo_cell_weights": lambda s, d: rounded(g.cell_weights(_rings(s, d), 0.25)),
    "geo_areal_mean": _areal(False),
    "geo_areal_sum": _areal(True),
    "geo_weighted_attributes": lambda s, d: rounded(g.weighted_attributes(read(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("gauge_id"), "c_acctbal", (F.col("c_custkey") % 5 + 1).alias("w")), "w", {"c_acctbal": 10.0})),
    "geo_merged_regions": lambda s, d: g.merged_regions(_hexed(s, d).groupBy("q", "r").agg(F.mode("s_nationkey", True).alias("label")), 6),
    "clus_centroids": lambda s, d: rounded(c.centroids(_vectors(s, d))),
    "clus_distances": lambda s, d: rounded(c.distances(_vectors(s, d), "vec_id")),
    "clus_silhouettes": lambda s, d: rounded(c.silhouettes(_vectors(s, d), "vec_id")),
    "clus_calinski_harabasz": lambda s, d: rounded(c.calinski_harabasz(_vectors(s, d), "vec_id")),
    "clus_davies_bouldin": lambda s, d: rounded(c.davies_bouldin(_vectors(s, d), "vec_id")),
    "clus_ward": lambda s, d: c.ward(_vectors(s, d), 10, "vec_id"),
    "clus_principal": lambda s, d: rounded(c.principal(_vectors(s, d), 2, "vec_id").select("vec_id", F.get("components", F.lit(0)).alias("first"), F.get("components", F.lit(1)).alias("second"))),
    "clus_kmeans_scan": lambda s, d: rounded(c.kmeans_scan(_vectors(s, d), range(3, 6), "vec_id")),
    "clus_regimes": lambda s, d: rounded(c.regimes(_patterns(s, d))),
    "clus_smoothed_regimes": lambda s, d: rounded(c.regimes(c.unit_patterns(c.smoothed(_patterns(s, d))))),
    "clus_hybrid_classes": lambda s, d: c.hybrid_classes(_gauges(s, d)),
    "clus_consolidated": lambda s, d: c.consolidated(_gauges(s, d).withColumn("combo", F.concat_ws("-", "geo", F.col("c_nationkey").cast("string"))), least=70, most=5).select("gauge_id", "combo", "class"),
    "model_pareto_front": lambda s, d: rounded(models.pareto_front(_trials(s, d), list(OBJECTIVES), ["gauge_id"])),
    "model_select_weighted_sum": _select("weighted_sum"),
    "model_select_topsis": _select("topsis"),
    "model_select_compromise": _select("compromise"),
    "model_baseflow": lambda s, d: rounded(models.baseflow(flow(s, d), 0.925)),
    "model_baseflow_stats": lambda s, d: rounded(models.baseflow_stats(flow(s, d))),
    "model_gr4j": _simulated("gr4j", [350.0, -0.5, 90.0, 1.7]),
    "model_gr4j_snow": _simulated("gr4j", [350.0, -0.5, 90.0, 1.7, 0.5, 4.0, 0.0]),
    "model_hbv": _simulated("hbv", [2.0, 0.1, 250.0, 0.2, 0.15, 0.05, 0.7, 3.0, 1.5, 120.0, 1.0, 0.0, 5.0, 0.7, 0.05, 0.1]),
    "model_calibrate": lambda s, d: rounded(models.best_trials(models.calibrate(_forcing(s, d), sets=40, rounds=8))),
    "model_forest": _forest,
    "model_forest_without_basin": _without,
    "stream_daily_means": lambda s, d: rounded(daily_means(_readings(s, d))),
}

_HEX = """h0 AS (SELECT s_suppkey, s_nationkey, s_acctbal AS x, (s_acctbal * (sqrt(3) / 3) - s_nationkey * 100.0 / 3) / 500 AS a, s_nationkey * 100.0 * (2.0 / 3) / 500 AS b FROM supplier),
  h1 AS (SELECT *, -a - b AS c, floor(a + 0.5) AS ra, floor(b + 0.5) AS rb, floor(-a - b + 0.5) AS rc FROM h0), h2 AS (SELECT *, abs(ra - a) AS da, abs(rb - b) AS db, abs(rc - c) AS dc FROM h1),
  h AS (SELECT s_suppkey, s_nationkey, x, CAST(CASE WHEN da > db AND da > dc THEN -rb - rc ELSE ra END AS BIGINT) AS q, CAST(CASE WHEN da > db AND da > dc THEN rb WHEN db > dc THEN -ra - rc ELSE rb END AS BIGINT) AS r FROM h2)"""
_CORNERS = [(0, 0), (1.3, 0.1), (1.1, 0.9), (0.2, 0.7)]
_RING = " + ".join(
    f"radians({b[0]} - {a[0]}) * (2 + sin(radians(n_nationkey / 2.0 + 40 + {a[1]})) + sin(radians(n_nationkey / 2.0 + 40 + {b[1]})))" for a, b in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]])
)
_GRID = "SELECT CAST(o_orderdate AS DATE) AS time, o_custkey % 3 AS ix, o_custkey % 2 AS iy, sum(o_totalprice) / 997 AS value FROM orders GROUP BY 1, 2, 3"
_W = "SELECT n_name AS gauge_id, ix, iy, (n_nationkey + ix * 2 + iy + 1) / 100.0 AS w FROM nation, range(3) a(ix), range(2) b(iy)"
_LONG = "e AS (SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), cen AS (SELECT label, place, avg(v) AS value, count(*) AS n FROM e GROUP BY 1, 2)"
_DIST = f"{_LONG}, dist AS (SELECT vec_id, e.label, sqrt(sum(pow(v - value, 2))) AS distance FROM e JOIN cen USING (label, place) GROUP BY 1, 2)"
_TRIALS = "t AS (SELECT p_brand AS gauge_id, p_partkey AS trial, p_size / 50 AS KGE, p_partkey % 97 / 97 AS low_flow, p_retailprice / 2000 AS high_flow FROM part WHERE p_size > 0)"
_DOMINATED = "o.KGE >= t.KGE AND o.low_flow >= t.low_flow AND o.high_flow >= t.high_flow AND (o.KGE > t.KGE OR o.low_flow > t.low_flow OR o.high_flow > t.high_flow)"
_FRONT = f"{_TRIALS}, f AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.gauge_id = t.gauge_id AND {_DOMINATED}))"
_OBJ = num(KGE="KGE", low_flow="low_flow", high_flow="high_flow")
_GAUGES = "gs AS (SELECT CAST(c_custkey AS VARCHAR) AS gauge_id, c_nationkey % 4 AS geo, c_mktsegment AS hydro, c_nationkey FROM customer)"


def _chosen(score: str, source: str = "f") -> str:
    return f"SELECT gauge_id, trial, {_OBJ}, {num(selection_score='s')} FROM (SELECT *, {score} AS s FROM {source}) QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY s DESC, trial) = 1"


def _season(name: str) -> str:
    parts = " OR ".join(f"k BETWEEN {a + 1} AND {b + 1}" for a, b in c.SEASONS[name])
    return f"sum(q) FILTER ({parts}) / {sum(b - a + 1 for a, b in c.SEASONS[name])}.0"


ORACLE_SQL = {
    "geo_areas": f"""WITH x AS (SELECT n_name AS gauge_id, n_nationkey AS n, abs({_RING}) * (6378137.0 * 6378137.0 / 2 / 1e6) AS a FROM nation)
      SELECT gauge_id, {num(area='a', buffer='CASE WHEN a < 2000 THEN 0.05 WHEN a < 10000 THEN 0.1 WHEN a < 50000 THEN 0.2 ELSE 0.3 END')}, CAST(floor((n * 5 - 60 + 180) / 6.0) + 1 AS INTEGER) AS zone, n * 5 - 60 + 1.3 <= 0 AS west FROM x""",
    "geo_hexagons": f"WITH {_HEX} SELECT s_suppkey, s_nationkey, {num(x='x')}, q, r FROM h",
    "geo_hex_neighbours": f"WITH {_HEX}, u AS (SELECT DISTINCT q, r FROM h) SELECT a.q, a.r, b.q AS nq, b.r AS nr FROM u a, u b WHERE (b.q - a.q, b.r - a.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))",
    "geo_hex_values": f"WITH {_HEX} SELECT q, r, count(x) AS n, {num(median='quantile_cont(x, 0.5)', mean='avg(x)', min='min(x)', max='max(x)', score='CASE WHEN avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN min(x) ELSE quantile_cont(x, 0.5) END')} FROM h GROUP BY q, r",
    "geo_hex_dominant": f"""WITH {_HEX}, k AS (SELECT q, r, CAST(s_nationkey AS VARCHAR) AS l, count(*) AS n FROM h GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY q, r) AS p, row_number() OVER (PARTITION BY q, r ORDER BY n DESC, l) AS i FROM k),
      a AS (SELECT q, r, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_types, max(l) FILTER (i = 1) AS l, max(p) AS p, -sum(p * ln(p)) AS s FROM p GROUP BY 1, 2) SELECT q, r, n, n_types, CASE WHEN p < 0.33 THEN 'ambiguous' ELSE l END AS dominant, {num(share='p', diversity='s')} FROM a WHERE n >= 2""",
    "geo_contingency": f"""WITH {_GAUGES}, k AS (SELECT coalesce(CAST(geo AS VARCHAR), 'All') AS a, coalesce(hydro, 'All') AS b, count(*) AS n FROM gs GROUP BY CUBE (geo, hydro)) SELECT a, b, n, {num(row_share='n * 100.0 / max(n) OVER (PARTITION BY a)')} FROM k""",
    "geo_suggested_radius": f"SELECT {num(radius='greatest(10, least(200, sqrt(quantile_cont(p_retailprice, 0.5) * 3 / 2.598)))')} FROM part",
    "geo_areal_mean": f"WITH g AS ({_GRID}), w AS ({_W}) SELECT gauge_id, CAST(time AS VARCHAR) AS time, {num(value='sum(value * w) / nullif(sum(w), 0)')} FROM g JOIN w USING (ix, iy) GROUP BY 1, 2",
    "geo_areal_sum": f"WITH g AS ({_GRID}), w AS ({_W}) SELECT gauge_id, CAST(time AS VARCHAR) AS time, {num(value='sum(value * w) * 100')} FROM g JOIN w USING (ix, iy) GROUP BY 1, 2",
    "geo_weighted_attributes": f"SELECT CAST(c_nationkey AS VARCHAR) AS gauge_id, {num(c_acctbal='sum(c_acctbal * (c_custkey % 5 + 1)) / (sum(c_custkey % 5 + 1) * 10)')} FROM customer GROUP BY 1",
    "clus_centroids": f"WITH {_LONG} SELECT label, place, {num(value='value')}, n FROM cen",
    "clus_distances": f"WITH {_DIST} SELECT vec_id, label, {num(distance='distance')} FROM dist",
    "clus_silhouettes": f"""WITH p AS (SELECT a.vec_id, a.label AS l, b.label AS l2, avg(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
      s AS (SELECT vec_id, l AS label, max(d) FILTER (l = l2) AS a, min(d) FILTER (l <> l2) AS b FROM p GROUP BY 1, 2) SELECT vec_id, label, {num(silhouette='CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END')} FROM s""",
    "clus_calinski_harabasz": f"""WITH {_DIST}, al AS (SELECT place, avg(v) AS m FROM e GROUP BY 1), b AS (SELECT sum(n * pow(value - m, 2)) AS b, count(DISTINCT label) AS k FROM cen JOIN al USING (place)), w AS (SELECT sum(pow(distance, 2)) AS w, count(*) AS n FROM dist)
      SELECT n, k, {num(calinski_harabasz='b * (n - k) / nullif(w * (k - 1), 0)')} FROM b, w""",
    "clus_davies_bouldin": f"""WITH {_DIST}, s AS (SELECT label, avg(distance) AS s FROM dist GROUP BY 1), d AS (SELECT a.label AS l, b.label AS l2, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM cen a JOIN cen b USING (place) WHERE a.label <> b.label GROUP BY 1, 2),
      w AS (SELECT l, max((x.s + y.s) / nullif(d, 0)) AS w FROM d JOIN s x ON x.label = l JOIN s y ON y.label = l2 GROUP BY 1) SELECT {num(davies_bouldin='avg(w)')} FROM w""",
    "clus_regimes": f"""WITH m AS (SELECT gauge_id, month(date) AS mo, day(date) AS da, quantile_cont(q, 0.5) AS q FROM ({FLAG_FLOW}) GROUP BY 1, 2, 3), k AS (SELECT gauge_id, dayofyear(make_date(2020, mo, da)) AS k, q FROM m),
      s AS (SELECT gauge_id, CAST(arg_max(k, (q, -k)) AS INTEGER) AS day, {", ".join(f"{_season(n)} AS {n}" for n in c.SEASONS)}, stddev_pop(q) / nullif(avg(q), 0) AS cv FROM k GROUP BY 1 HAVING count(*) = 366),
      r AS (SELECT *, winter + spring + summer + autumn AS t FROM s), x AS (SELECT gauge_id, day, {", ".join(f"CASE WHEN t > 0 THEN {n} / t ELSE 0 END AS {n}_ratio" for n in c.SEASONS)}, cv FROM r)
      SELECT gauge_id, day AS peak_day, {num(**{f'{n}_ratio': f'{n}_ratio' for n in c.SEASONS}, cv='cv')}, CASE WHEN day BETWEEN 60 AND 151 THEN CASE WHEN spring_ratio > 0.4 THEN '{c.REGIMES['spring_flood']}' ELSE '{c.REGIMES['spring_summer']}' END
      WHEN day BETWEEN 152 AND 243 THEN CASE WHEN summer_ratio > 0.35 THEN '{c.REGIMES['summer_flood']}' ELSE '{c.REGIMES['summer_autumn']}' END WHEN day BETWEEN 244 AND 334 THEN '{c.REGIMES['autumn_winter']}' ELSE '{c.REGIMES['winter_baseflow']}' END
      || CASE WHEN cv < 0.3 THEN ' {c.REGIMES['low_variability']}' WHEN cv > 0.7 THEN ' {c.REGIMES['high_variability']}' ELSE '' END AS regime FROM x""",
    "clus_hybrid_classes": f"""WITH {_GAUGES}, a AS (SELECT *, geo || '-' || hydro AS combo, count(*) OVER (PARTITION BY geo, hydro) AS n FROM gs), b AS (SELECT *, CASE WHEN n >= 30 THEN combo ELSE geo || '-mixed' END AS h FROM a), m AS (SELECT *, count(*) OVER (PARTITION BY h) AS m FROM b),
      o AS (SELECT geo, arg_max(combo, (n, combo)) AS own FROM a WHERE n >= 30 GROUP BY 1) SELECT gauge_id, m.geo, hydro, c_nationkey, combo, CASE WHEN n < 30 AND m < 5 THEN coalesce(own, h) ELSE h END AS hybrid FROM m LEFT JOIN o ON m.geo = o.geo""",
    "clus_consolidated": f"""WITH {_GAUGES}, a AS (SELECT gauge_id, geo || '-' || c_nationkey AS combo, CAST(geo AS VARCHAR) AS geo FROM gs), k AS (SELECT combo, any_value(geo) AS geo, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 70 QUALIFY row_number() OVER (ORDER BY n DESC, combo) <= 5),
      f AS (SELECT geo, arg_min(combo, (-n, combo)) AS c FROM k GROUP BY 1) SELECT gauge_id, a.combo, coalesce(k.combo, f.c, 'Other-' || a.geo) AS class FROM a LEFT JOIN k USING (combo) LEFT JOIN f ON a.geo = f.geo""",
    "model_pareto_front": f"WITH {_FRONT} SELECT gauge_id, trial, {_OBJ} FROM f",
    "model_select_weighted_sum": f"WITH {_FRONT} {_chosen('0.4 * KGE + 0.35 * low_flow + 0.25 * high_flow')}",
    "model_select_topsis": f"WITH {_FRONT}, v AS (SELECT *, " + ", ".join(f"{o} / nullif(sqrt(sum({o} * {o}) OVER (PARTITION BY gauge_id)), 0) * {x} AS v_{o}" for o, x in OBJECTIVES.items()) + " FROM f), z AS (SELECT *, "
      + ", ".join(f"{fn}(v_{o}) OVER (PARTITION BY gauge_id) AS {n}_{o}" for o in OBJECTIVES for n, fn in (("hi", "max"), ("lo", "min"))) + " FROM v), y AS (SELECT *, "
      + ", ".join("sqrt(" + " + ".join(f"pow(v_{o} - {n}_{o}, 2)" for o in OBJECTIVES) + f") AS d_{n}" for n in ("hi", "lo")) + " FROM z) " + _chosen("coalesce(d_lo / nullif(d_hi + d_lo, 0), 0)", "y"),
    "model_select_compromise": f"WITH {_FRONT}, z AS (SELECT *, " + ", ".join(f"({o} - min({o}) OVER (PARTITION BY gauge_id)) / (max({o}) OVER (PARTITION BY gauge_id) - min({o}) OVER (PARTITION BY gauge_id) + 1e-10) AS n_{o}" for o in OBJECTIVES) + " FROM f) "
      + _chosen("-sqrt(" + " + ".join(f"{x} * pow(1 - n_{o}, 2)" for o, x in OBJECTIVES.items()) + ")", "z"),
    "stream_daily_means": f"SELECT CAST(user_id AS VARCHAR) AS gauge_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {num(level='avg(value)')}, count(value) AS n FROM events GROUP BY 1, 2",
}
