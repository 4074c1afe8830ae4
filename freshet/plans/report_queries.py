"""Queries of summaries, bins, rankings and filters, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.expr import rounded
from freshet.operators import reports as r
from freshet.plans.panels import FLOW, PAIRS, flow, num, pairs, read


def _scores(spark, d):
    """Scores of gauges: nation of the customer, model of the segment."""
    rows = read(spark, d, "customer")
    return rows.select(
        F.col("c_custkey").cast("string").alias("gauge_id"), F.col("c_mktsegment").alias("model"), (F.col("c_nationkey") % 3).alias("source"),
        (F.col("c_acctbal") / 10000).alias("NSE"), (F.col("c_acctbal") / 7000 - 0.2).alias("KGE"), ((F.col("c_custkey") % 997 + 1) * 13.5).alias("area"),
    )


def _gappy(spark, d):
    """Flow with every value above 40 of some gauges missing."""
    q = F.when((F.col("q") <= 40) | (F.col("gauge_id").cast("int") % 3 != 0), F.col("q"))
    return flow(spark, d).select("gauge_id", "date", q.alias("q"))


def _rings(spark, d):
    n = F.col("n_nationkey").cast("double")
    corner = lambda a, b: F.struct((n * 5 - 60 + a).alias("lon"), (n / 2 + 40 + b).alias("lat"))
    return read(spark, d, "nation").select(F.col("n_name").alias("district"), F.array(corner(0, 0), corner(3.3, 0.1), corner(3.1, 1.9), corner(0.2, 1.7)).alias("ring"))


def _stations(spark, d):
    n = F.col("c_nationkey").cast("double")
    return read(spark, d, "customer").select("c_custkey", (n * 5 - 60 + F.col("c_custkey") % 41 / 10).alias("lon"), (n / 2 + 40 + F.col("c_custkey") % 23 / 11).alias("lat"))


def _extents(spark, d):
    n = F.col("n_nationkey").cast("double")
    bounds = [n * 1.37 - 20, n * 1.37 - 19.93 + n / 10, n * 0.77 + 40.012, n * 0.77 + 40.05 + n / 20]
    return read(spark, d, "nation").select("n_name", *(x.alias(c) for c, x in zip(("west", "east", "south", "north"), r.snapped_extent(bounds, 0.05))))


def _tables(spark, d):
    rows = _scores(spark, d)
    return {"all_gauges": rows, "high": rows.where("KGE > 0.1"), "odd": rows.where("cast(gauge_id as int) % 2 = 1").withColumn("NSE", F.col("NSE") * 2)}


def _detected(spark, d):
    return read(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("gauge_id"), (F.col("p_size") % 11 / 10).alias("precision"), (F.col("p_size") % 7 / 6).alias("recall"), F.col("p_retailprice").alias("rmse")
    )


def _parts(spark, d):
    rows = read(spark, d, "supplier")
    one = rows.select(F.col("s_nationkey").cast("string").alias("gauge_id"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("A"), F.col("s_nationkey").cast("string"))).alias("name"), F.col("s_acctbal").alias("height"))
    two = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("gauge_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 1000.0).alias("height"))
    return [one, two]


def _deltas(spark, d):
    x = F.col("c_acctbal")
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("gauge_id"), (x / 100).alias("a"), F.when(x > 0, x / 50).alias("b"), (x % 7).alias("c"), (x % 11 - 5).alias("d"))


QUERIES = {
    "rep_mean_temperature": lambda s, d: rounded(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", r.mean_temperature("l_discount", "l_tax").alias("t"))),
    "rep_units": lambda s, d: rounded(r.converted(read(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("t"), F.col("p_size").cast("double").alias("p")), {"t": "kelvin", "p": "tenth"})),
    "rep_plausible_gauges": lambda s, d: rounded(r.plausible(flow(s, d), most=150.0)),
    "rep_label_order": lambda s, d: read(s, d, "part").select("p_brand").distinct().select("p_brand", *(x.alias(n) for n, x in zip(("letters", "number"), r.label_order("p_brand")))),
    "rep_merged": lambda s, d: rounded(r.merged([_scores(s, d).select("gauge_id", "NSE"), _scores(s, d).where("KGE > 0").select("gauge_id", "KGE"), _scores(s, d).where("area > 100").select("gauge_id", "area")])),
    "rep_period_override": lambda s, d: rounded(r.overridden(pairs(s, d), pairs(s, d).select("gauge_id", "date", (F.col("sim") * 2).alias("obs")), "obs", "1995-01-01", "1996-06-30")),
    "rep_described": lambda s, d: rounded(r.described(_scores(s, d), ["NSE", "KGE"], ["model", "source"])),
    "rep_histogram": lambda s, d: rounded(r.histogram(_scores(s, d), "NSE", [-0.1, 0.0, 0.25, 0.5, 0.75, 1.0])),
    "rep_histogram_lowest": lambda s, d: rounded(r.histogram(read(s, d, "part"), "p_size", [1, 10, 20, 30, 50], lowest=True)),
    "rep_score_bins": lambda s, d: rounded(r.score_bins(_scores(s, d), "NSE", ("model",))),
    "rep_coverage": lambda s, d: rounded(r.coverage(read(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")))),
    "rep_area_trend": lambda s, d: rounded(r.area_trend(_scores(s, d), "area", "NSE", ("model",))),
    "rep_largest": lambda s, d: rounded(r.extremes(_scores(s, d), "NSE", 5, "gauge_id")),
    "rep_smallest_by_model": lambda s, d: rounded(r.extremes(_scores(s, d), "KGE", 3, "gauge_id", False, ("model",))),
    "rep_worst_100": lambda s, d: rounded(r.worst(_deltas(s, d), ["a", "b", "c", "d"])),
    "rep_reindexed": lambda s, d: rounded(r.reindexed(_scores(s, d).where("KGE > 0.5").groupBy("model").agg(F.avg("NSE").alias("NSE")).withColumnRenamed("model", "gauge_id"), read(s, d, "customer").select(F.col("c_mktsegment").alias("gauge_id")).union(read(s, d, "nation").select("n_name")), fill={"NSE": -1.0})),
    "rep_snapped_extent": lambda s, d: rounded(_extents(s, d)),
    "rep_within_extent": lambda s, d: rounded(r.within(_stations(s, d), (-30.0, 10.5, 43.0, 47.5))),
    "rep_points_in_rings": lambda s, d: rounded(r.points_in_rings(_stations(s, d), _rings(s, d), "district")),
    "rep_forecast_append": lambda s, d: rounded(r.forecast_appended(flow(s, d).where("date < '1993-01-01'").withColumn("forecast_horizon", F.lit(None).cast("int")), flow(s, d).where("date >= '1998-01-01'"))),
    "rep_stitched": lambda s, d: rounded(r.stitched(_parts(s, d))),
    "rep_legacy_years": lambda s, d: rounded(r.legacy_years(flow(s, d)).groupBy("gauge_id", "year").agg(F.sum("q").alias("q"), F.count("*").alias("n"))),
    "rep_within_budget": lambda s, d: rounded(r.within_budget(_gappy(s, d).withColumn("year", F.year("date")), "q", 0.2, ("gauge_id", "year"))),
    "rep_missing_classes": lambda s, d: rounded(r.missing_classes(_gappy(s, d))),
    "rep_monthly_deltas": lambda s, d: rounded(r.monthly_deltas(pairs(s, d).withColumn("district", F.col("gauge_id").cast("int") % 4), "obs", "sim", "district")),
    "rep_area_check": lambda s, d: rounded(r.area_check(read(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("known"), (F.col("p_retailprice") * (0.7 + F.col("p_size") / 100)).alias("computed")), "known", "computed")),
    "rep_joined_medians": lambda s, d: rounded(r.joined_medians(_tables(s, d), "NSE")),
    "rep_detection_medians": lambda s, d: rounded(r.detection_medians(_detected(s, d), read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("gauge_id")), True)),
    "rep_model_ranking": lambda s, d: rounded(r.model_ranking(pairs(s, d).select("gauge_id", "obs", (F.col("sim") * 0.9).alias("m1"), (F.col("obs") + 3).alias("m2"), F.when(F.col("obs") < 30, F.col("obs")).alias("m3")), "obs", ["m1", "m2", "m3"])),
    "rep_river_rank": lambda s, d: read(s, d, "orders").select("o_orderkey", r.river_rank("o_totalprice").alias("rank")),
}

_S = "s AS (SELECT CAST(c_custkey AS VARCHAR) AS gauge_id, c_mktsegment AS model, c_nationkey % 3 AS source, c_acctbal / 10000 AS NSE, c_acctbal / 7000 - 0.2 AS KGE, (c_custkey % 997 + 1) * 13.5 AS area FROM customer)"
_G = f"g AS (SELECT gauge_id, date, CASE WHEN q <= 40 OR CAST(gauge_id AS INTEGER) % 3 <> 0 THEN q END AS q FROM ({FLOW}))"
_SCORE = num(NSE="NSE", KGE="KGE", area="area")
_ST = "st AS (SELECT c_custkey, c_nationkey * 5 - 60 + c_custkey % 41 / 10 AS lon, c_nationkey / 2 + 40 + c_custkey % 23 / 11 AS lat FROM customer)"


def _bins(source: str, value: str, edges: list, lowest: bool = False) -> str:
    values = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    first = f"OR (bin = 0 AND {value} = low)" if lowest else ""
    return f"""SELECT CAST(bin AS INTEGER) AS bin, {num(low='low', high='high')}, count({value}) AS n, {num(share=f"count({value}) / (SELECT count({value}) FROM {source})::DOUBLE")}
      FROM (VALUES {values}) b(bin, low, high) LEFT JOIN {source} ON ({value} > low AND {value} <= high) {first} GROUP BY bin, low, high"""


def _snap(x: str, up: bool) -> str:
    return f"{'ceil' if up else 'floor'}(({x}) * 10.0) / 10.0"


def _extent(low: str, high: str) -> tuple[str, str]:
    a, b = _snap(low, False), _snap(high, True)
    narrow = f"round(abs({a} - {b}), 3) <= 0.1"
    return f"round(CASE WHEN {narrow} THEN {_snap(f'{a} - 0.05', False)} ELSE {a} END, 2)", f"round(CASE WHEN {narrow} THEN {_snap(f'{b} + 0.05', True)} ELSE {b} END, 2)"


_W, _E = _extent("n_nationkey * 1.37::DOUBLE - 20", "n_nationkey * 1.37::DOUBLE - 19.93 + n_nationkey / 10::DOUBLE")
_SO, _N = _extent("n_nationkey * 0.77::DOUBLE + 40.012", "n_nationkey * 0.77::DOUBLE + 40.05 + n_nationkey / 20::DOUBLE")

ORACLE_SQL = {
    "rep_mean_temperature": f"SELECT l_orderkey, l_linenumber, {num(t='(l_discount + l_tax) / 2')} FROM lineitem",
    "rep_units": f"SELECT p_partkey, {num(t='p_retailprice - 273.15', p='p_size * 0.1')} FROM part",
    "rep_plausible_gauges": f"SELECT gauge_id, CAST(date AS VARCHAR) AS date, {num(q='q')} FROM ({FLOW}) QUALIFY max(q) OVER (PARTITION BY gauge_id) < 150",
    "rep_label_order": "SELECT DISTINCT p_brand, regexp_extract(p_brand, '^[A-Za-z]*') AS letters, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS number FROM part",
    "rep_merged": f"WITH {_S} SELECT gauge_id, {_SCORE} FROM s WHERE KGE > 0 AND area > 100",
    "rep_period_override": f"""SELECT gauge_id, CAST(date AS VARCHAR) AS date, {num(sim='sim')},
      round(CAST(CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN sim * 2 ELSE obs END AS DOUBLE), 6) + 0.0 AS obs FROM ({PAIRS})""",
    "rep_described": f"WITH {_S}, u AS (SELECT model, source, 'NSE' AS metric, NSE AS v FROM s UNION ALL SELECT model, source, 'KGE', KGE FROM s) SELECT model, source, metric, count(v) AS n, {num(median='quantile_cont(v, 0.5)', mean='avg(v)')} FROM u GROUP BY 1, 2, 3",
    "rep_histogram": f"WITH {_S} {_bins('s', 'NSE', [-0.1, 0.0, 0.25, 0.5, 0.75, 1.0])}",
    "rep_histogram_lowest": _bins("part", "p_size", [1, 10, 20, 30, 50], True),
    "rep_score_bins": f"""WITH {_S}, l AS (SELECT model, CASE WHEN NSE <= 0 THEN 'Negative (worse than mean)' WHEN NSE <= 0.5 THEN 'Poor' WHEN NSE <= 0.7 THEN 'Acceptable' WHEN NSE <= 0.8 THEN 'Good' ELSE 'Excellent' END AS label FROM s)
      SELECT model, label, count(*) AS n, {num(percent='count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY model)')} FROM l GROUP BY 1, 2""",
    "rep_coverage": f"""WITH k AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) SELECT {num(total_hexes='count(*)', total_watersheds='sum(n)', mean_count='avg(n)', median_count='quantile_cont(n, 0.5)',
      p10_count='quantile_cont(n::DOUBLE, 0.1)', p90_count='quantile_cont(n::DOUBLE, 0.9)', min_count='min(n)', max_count='max(n)')} FROM k""",
    "rep_area_trend": f"WITH {_S} SELECT model, {num(slope='regr_slope(NSE, log10(area))', intercept='regr_intercept(NSE, log10(area))', r='corr(area, NSE)', r_log='corr(log10(area), NSE)')} FROM s GROUP BY 1",
    "rep_largest": f"WITH {_S} SELECT gauge_id, model, source, {_SCORE} FROM s QUALIFY row_number() OVER (ORDER BY NSE DESC, gauge_id) <= 5",
    "rep_smallest_by_model": f"WITH {_S} SELECT gauge_id, model, source, {_SCORE} FROM s QUALIFY row_number() OVER (PARTITION BY model ORDER BY KGE, gauge_id) <= 3",
    "rep_worst_100": f"""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS gauge_id, CAST(c_acctbal AS DOUBLE) AS v FROM customer),
      m AS (SELECT gauge_id, (v / 100 + CASE WHEN v > 0 THEN v / 50 ELSE 0 END + v % 7 + v % 11 - 5) / CASE WHEN v > 0 THEN 4 ELSE 3 END AS d FROM x) SELECT gauge_id, {num(mean_delta='d')} FROM m QUALIFY row_number() OVER (ORDER BY d, gauge_id) <= 100""",
    "rep_reindexed": f"WITH {_S}, k AS (SELECT c_mktsegment AS gauge_id FROM customer UNION SELECT n_name FROM nation) SELECT gauge_id, {num(NSE='coalesce((SELECT avg(NSE) FROM s WHERE model = gauge_id_ AND KGE > 0.5), -1)')} FROM (SELECT gauge_id, gauge_id AS gauge_id_ FROM k)",
    "rep_snapped_extent": f"SELECT n_name, {num(west=_W, east=_E, south=_SO, north=_N)} FROM nation",
    "rep_within_extent": f"WITH {_ST} SELECT c_custkey, {num(lon='lon', lat='lat')} FROM st WHERE lon BETWEEN -30 AND 10.5 AND lat BETWEEN 43 AND 47.5",
    "rep_points_in_rings": f"""WITH {_ST}, c AS (SELECT n_name AS district, i, n_nationkey * 5 - 60 + dx AS x, n_nationkey / 2 + 40 + dy AS y FROM nation, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 3.3, 0.1), (2, 3.1, 1.9), (3, 0.2, 1.7)) v(i, dx, dy)),
      e AS (SELECT a.district, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bay FROM c a JOIN c b ON a.district = b.district AND b.i = (a.i + 1) % 4)
      SELECT c_custkey, {num(lon='any_value(lon)', lat='any_value(lat)')}, district FROM st, e GROUP BY c_custkey, district HAVING sum(CASE WHEN (ay > lat) <> (bay > lat) AND lon < (bx - ax) * (lat - ay) / (bay - ay) + ax THEN 1 ELSE 0 END) % 2 = 1""",
    "rep_forecast_append": f"""SELECT gauge_id, CAST(date AS VARCHAR) AS date, {num(q='q')}, NULL::INTEGER AS forecast_horizon FROM ({FLOW}) WHERE date < DATE '1993-01-01' UNION ALL
      SELECT gauge_id, CAST(date AS VARCHAR), {num(q='q')}, CAST(row_number() OVER (PARTITION BY gauge_id ORDER BY date) - 1 AS INTEGER) FROM ({FLOW}) WHERE date >= DATE '1998-01-01'""",
    "rep_stitched": f"""WITH u AS (SELECT CAST(s_nationkey AS VARCHAR) AS gauge_id, CASE WHEN s_nationkey % 2 = 0 THEN 'A' || s_nationkey END AS name, s_acctbal AS height, 0 AS i FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, n_nationkey * 1000.0, 1 FROM nation)
      SELECT gauge_id, arg_min(name, i) FILTER (name IS NOT NULL) AS name, {num(height='max(height)')} FROM u GROUP BY 1""",
    "rep_legacy_years": f"""WITH f AS ({FLOW}), y AS (SELECT *, year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS year FROM f UNION ALL SELECT *, year(date) FROM f WHERE month(date) = 10 AND day(date) = 1)
      SELECT gauge_id, CAST(year AS INTEGER) AS year, {num(q='sum(q)')}, count(*) AS n FROM y GROUP BY 1, 2""",
    "rep_within_budget": f"WITH {_G} SELECT gauge_id, CAST(date AS VARCHAR) AS date, {num(q='q')}, CAST(year(date) AS INTEGER) AS year FROM g QUALIFY avg(CASE WHEN q IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY gauge_id, year(date)) <= 0.2",
    "rep_missing_classes": f"WITH {_G}, m AS (SELECT gauge_id, avg(CASE WHEN q IS NULL THEN 1.0 ELSE 0.0 END) AS x FROM g GROUP BY 1) SELECT gauge_id, {num(missing='x')}, CASE WHEN x = 0 THEN 'full' WHEN x <= 0.25 THEN 'partial' WHEN x < 1 THEN 'sparse' ELSE 'empty' END AS status FROM m",
    "rep_monthly_deltas": f"""WITH p AS ({PAIRS}), o AS (SELECT CAST(gauge_id AS INTEGER) % 4 AS district, gauge_id, CAST(month(date) AS INTEGER) AS month, quantile_cont(sim - obs, 0.5) AS d FROM p GROUP BY 1, 2, 3)
      SELECT district, month, {num(delta='quantile_cont(d, 0.5)')}, count(d) AS gauges FROM o GROUP BY 1, 2""",
    "rep_area_check": f"WITH a AS (SELECT p_partkey, p_retailprice AS known, p_retailprice * (0.7 + p_size / 100.0) AS computed FROM part) SELECT p_partkey, {num(known='known', computed='computed', area_difference='(known - computed) / known * 100')}, abs((known - computed) / known * 100) < 15 AS area_matches FROM a",
    "rep_joined_medians": f"WITH {_S} SELECT count(*) AS gauges, {num(all_gauges='quantile_cont(NSE, 0.5)', high='quantile_cont(NSE, 0.5)', odd='quantile_cont(NSE * 2, 0.5)')} FROM s WHERE KGE > 0.1 AND CAST(gauge_id AS INTEGER) % 2 = 1",
    "rep_detection_medians": f"SELECT {num(median_recall='quantile_cont(p_size % 7 / 6, 0.5)', median_precision='quantile_cont(p_size % 11 / 10, 0.5)', median_rmse='quantile_cont(p_retailprice, 0.5)')} FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) AND p_size % 7 <> 0 AND p_size % 11 <> 0",
    "rep_model_ranking": f"""WITH p AS ({PAIRS}), u AS (SELECT gauge_id, obs, 'm1' AS model, sim * 0.9 AS m FROM p UNION ALL SELECT gauge_id, obs, 'm2', obs + 3 FROM p UNION ALL SELECT gauge_id, obs, 'm3', CASE WHEN obs < 30 THEN obs END FROM p),
      a AS (SELECT gauge_id, model, avg(CASE WHEN m IS NULL THEN 1.0 ELSE 0.0 END) AS s, corr(obs, m) AS r, abs(avg(CASE WHEN m IS NOT NULL THEN obs - m END) / avg(obs) * 100) AS error FROM u GROUP BY 1, 2 HAVING s <= 0.1)
      SELECT gauge_id, model, {num(r='r', error='error')}, CAST(row_number() OVER (PARTITION BY gauge_id ORDER BY error, r, model) AS INTEGER) AS place FROM a""",
    "rep_river_rank": "SELECT o_orderkey, CAST(floor(log10(o_totalprice)) AS INTEGER) AS rank FROM orders",
}
