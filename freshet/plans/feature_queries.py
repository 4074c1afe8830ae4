"""Feature, join and reshaping queries and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.expr import rounded
from freshet.operators import features as f
from freshet.plans.panels import FLAG_FLOW, FLOW, HYDRO_YEAR, flag_flow, flow, num, read


def _rolling(spark, d):
    return rounded(f.rolling(flow(spark, d).withColumn("t", F.col("q") / 2), {"q": "sum", "t": "mean"}, (1, 2, 4, 8)).drop("t"))


def _rolling_full(spark, d):
    return rounded(f.rolling(flag_flow(spark, d), {"q": "mean"}, (2, 4, 8, 16, 32, 64, 128, 256), True))


def _calendar(spark, d):
    rows = flow(spark, d)
    sin, cos = f.cyclic_day("date")
    sin2, cos2 = f.cyclic_day("date", 365.25)
    from freshet.functions.expr import hydro_day, hydro_year, season

    return rounded(rows.select(
        "gauge_id", "date", sin.alias("doy_sin"), cos.alias("doy_cos"), sin2.alias("doy_sin_mean_year"), cos2.alias("doy_cos_mean_year"),
        hydro_year("date").alias("hydro_year"), season("date").alias("season"), hydro_day("date").alias("hydro_day"),
    ))


def _pet(spark, d):
    rows = flow(spark, d).withColumn("temp", F.col("q") / 20 - 10).withColumn("lat", F.col("gauge_id").cast("double") * 3 + 5)
    return rounded(rows.select("gauge_id", "date", f.pet_oudin("temp", F.dayofyear("date"), "lat").alias("pet")))


def _scalars(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_size") * F.col("p_size") * 100.0).alias("area"), "p_retailprice", "p_size")
    text = F.when(F.col("p_size") % 7 == 0, "прсх").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5?")))
    return rounded(rows.select("p_partkey", f.size_class("area").alias("size_class"), f.mm_per_day("p_retailprice", "area").alias("depth"), f.cleaned_number(text).alias("number")))


def _min_max(spark, d):
    return rounded(f.min_max(read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_acctbal"], ("s_nationkey",)))


def _winsorised(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return rounded(f.winsorised(rows, {"p_retailprice": (0.01, 0.99), "p_size": (0.0, 0.99)}, ("p_size",)))


def _classes(spark, d):
    return rounded(f.quantile_classes(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"))


def _two(spark, d):
    rows = flag_flow(spark, d)
    part = lambda g: rows.where(F.col("gauge_id") == g).select("date", "q")
    return part("A"), part("N")


def _dataset(spark, d):
    orders = read(spark, d, "orders")
    price = lambda p: F.sum(F.when(F.col("o_orderpriority").startswith(p), F.col("o_totalprice")))
    wide = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(price("1").alias("prcp_e5l"), price("2").alias("prcp_gpcp"))
    return rounded(f.with_dataset(wide, ["e5l", "gpcp"]))


def _vote(spark, d):
    points = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"), (F.col("s_nationkey") % 3).alias("label"))
    return f.nearest_vote(points.where("id % 2 = 0"), points.where("id % 2 = 1"))


def _gaps(spark, d):
    return flag_flow(spark, d).withColumn("q", F.when(F.dayofmonth("date") % 3 != 0, F.col("q")))


def _argmax(spark, d):
    items = read(spark, d, "lineitem")
    wide = items.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"), (F.sum("l_extendedprice") / 1000).alias("price"), (F.sum("l_tax") * 500).alias("tax"))
    return rounded(f.argmax_column(wide, ["quantity", "price", "tax"]).select("l_returnflag", "l_linestatus", "l_linenumber", "best"))


def _pivot(spark, d):
    rows = flag_flow(spark, d).groupBy(F.year("date").alias("year")).pivot("gauge_id", ["A", "N", "R"]).agg(F.avg("q"))
    return rounded(rows)


def _uncorrelated(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(0.0).alias("zero_cl_x"))
    return spark.createDataFrame([(x,) for x in f.uncorrelated(rows, rows.columns)], "name string")


QUERIES = {
    "feat_rolling": _rolling,
    "feat_rolling_full": _rolling_full,
    "feat_calendar": _calendar,
    "feat_pet": _pet,
    "feat_scalars": _scalars,
    "feat_min_max": _min_max,
    "feat_winsorised": _winsorised,
    "feat_quantile_classes": _classes,
    "feat_uncorrelated": _uncorrelated,
    "feat_upsert_new_wins": lambda s, d: rounded(f.upsert(*_two(s, d), ["date"])),
    "feat_upsert_old_wins": lambda s, d: rounded(f.upsert(*_two(s, d), ["date"], "old")),
    "feat_overwritten": lambda s, d: rounded(f.overwritten(*_two(s, d), ["date"], ["q"])),
    "feat_with_dataset": _dataset,
    "feat_leave_one_out": lambda s, d: f.leave_one_out(read(s, d, "nation").select(F.col("n_name").alias("gauge_id"))),
    "feat_nearest_cell": lambda s, d: rounded(f.nearest_cell(read(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("lon"), (F.col("s_nationkey") * 1.3).alias("lat")), 0.25)),
    "feat_nearest_vote": _vote,
    "feat_z_scores": lambda s, d: rounded(f.z_scores(read(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_acctbal"], ("s_nationkey",))),
    "feat_argmax_column": _argmax,
    "feat_seasonal_cycle": lambda s, d: rounded(f.seasonal_cycle(flag_flow(s, d))),
    "feat_resampled": lambda s, d: rounded(f.resampled(flow(s, d), 10, "q", "sum")),
    "feat_densified": lambda s, d: rounded(f.densified(flow(s, d))),
    "feat_interpolated": lambda s, d: rounded(f.interpolated(_gaps(s, d), "q")),
    "feat_completeness": lambda s, d: rounded(f.completeness(_gaps(s, d))),
    "feat_split_basins": lambda s, d: f.split_basins(read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("gauge_id"))),
    "feat_pivot_years": _pivot,
    "join_semi": lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "join_anti": lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "set_intersect": lambda s, d: read(s, d, "supplier").select("s_nationkey").intersect(read(s, d, "customer").select("c_nationkey")),
    "set_except": lambda s, d: read(s, d, "customer").select("c_custkey").exceptAll(read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()),
    "agg_string_list": lambda s, d: read(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ", ").alias("names")),
}

_WIN = "PARTITION BY gauge_id ORDER BY date ROWS {} PRECEDING"
_DECL = "(0.409 * sin(2 * pi() * doy / 365 - 1.39))"
_SUNSET = f"acos(greatest(-1, least(1, -tan(lat) * tan({_DECL}))))"
_RA = f"24 * 60 / pi() * 0.082 * (1 + 0.033 * cos(2 * pi() * doy / 365)) * ({_SUNSET} * sin(lat) * sin({_DECL}) + cos(lat) * cos({_DECL}) * sin({_SUNSET}))"
_A = f"SELECT date, q FROM ({FLAG_FLOW}) WHERE gauge_id = 'A'"
_N = f"SELECT date, q FROM ({FLAG_FLOW}) WHERE gauge_id = 'N'"
_GAPS = f"SELECT gauge_id, date, CASE WHEN day(date) % 3 <> 0 THEN q END AS q FROM ({FLAG_FLOW})"
_DAY = "CAST(date AS VARCHAR) AS date"

ORACLE_SQL = {
    "feat_rolling": f"""WITH ts AS ({FLOW}) SELECT gauge_id, {_DAY}, {num(q='q', **{f'q_sum_{w}d': f"sum(q) OVER ({_WIN.format(w - 1)})" for w in (1, 2, 4, 8)}, **{f't_mean_{w}d': f"avg(q / 2) OVER ({_WIN.format(w - 1)})" for w in (1, 2, 4, 8)})} FROM ts""",
    "feat_rolling_full": f"""WITH ts AS ({FLAG_FLOW}) SELECT gauge_id, {_DAY}, {num(q='q', **{f'q_mean_{w}d': f"CASE WHEN count(*) OVER ({_WIN.format(w - 1)}) = {w} THEN avg(q) OVER ({_WIN.format(w - 1)}) END" for w in (2, 4, 8, 16, 32, 64, 128, 256)})} FROM ts""",
    "feat_calendar": f"""WITH ts AS ({FLOW}) SELECT gauge_id, {_DAY}, {num(doy_sin='sin(2 * pi() * dayofyear(date) / 366)', doy_cos='cos(2 * pi() * dayofyear(date) / 366)', doy_sin_mean_year='sin(2 * pi() * dayofyear(date) / 365.25)', doy_cos_mean_year='cos(2 * pi() * dayofyear(date) / 365.25)')},
      {HYDRO_YEAR} AS hydro_year, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) < 6 THEN 'spring' WHEN month(date) < 9 THEN 'summer' ELSE 'autumn' END AS season,
      CAST(CASE WHEN month(date) >= 10 THEN dayofyear(date) - 273 ELSE dayofyear(date) + 92 END AS INTEGER) AS hydro_day FROM ts""",
    "feat_pet": f"""WITH ts AS ({FLOW}), x AS (SELECT *, q / 20 - 10 AS t, dayofyear(date) AS doy, radians(CAST(gauge_id AS DOUBLE) * 3 + 5) AS lat FROM ts)
      SELECT gauge_id, {_DAY}, {num(pet=f'greatest(0, {_RA} / 2.45 * (t + 5) / 100)')} FROM x""",
    "feat_scalars": f"""WITH x AS (SELECT p_partkey, p_size * p_size * 100.0 AS a, p_retailprice AS r, p_size FROM part) SELECT p_partkey,
      CASE {" ".join(f"WHEN a {'<' if i == 0 else '<='} {b} THEN '{n}'" for i, (b, n) in enumerate(f.SIZES))} ELSE '{f.LARGEST}' END AS size_class,
      {num(depth='r * 86400000 / nullif(a * 1e6, 0)', number='CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size + 0.5 END')} FROM x""",
    "feat_min_max": f"""WITH x AS (SELECT *, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi FROM supplier WINDOW w AS (PARTITION BY s_nationkey)) SELECT s_suppkey, s_nationkey, {num(s_acctbal='(s_acctbal - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END')} FROM x""",
    "feat_winsorised": f"""WITH x AS (SELECT p_partkey, p_retailprice AS a, ln(1 + p_size) AS b FROM part), k AS (SELECT quantile_cont(a, 0.01) AS a1, quantile_cont(a, 0.99) AS a2, quantile_cont(b, 0.0) AS b1, quantile_cont(b, 0.99) AS b2 FROM x)
      SELECT p_partkey, {num(p_retailprice='greatest(a1, least(a2, a))', p_size='greatest(b1, least(b2, b))')} FROM x, k""",
    "feat_quantile_classes": f"""WITH k AS (SELECT quantile_cont(c_acctbal, 0.33) AS a, quantile_cont(c_acctbal, 0.67) AS b FROM customer) SELECT c_custkey, {num(c_acctbal='c_acctbal')}, CASE WHEN c_acctbal <= a THEN 'Low' WHEN c_acctbal <= b THEN 'Moderate' ELSE 'High' END AS class FROM customer, k""",
    "feat_upsert_new_wins": f"WITH a AS ({_A}), n AS ({_N}) SELECT CAST(coalesce(a.date, n.date) AS VARCHAR) AS date, {num(q='coalesce(n.q, a.q)')} FROM a FULL JOIN n ON a.date = n.date",
    "feat_upsert_old_wins": f"WITH a AS ({_A}), n AS ({_N}) SELECT CAST(coalesce(a.date, n.date) AS VARCHAR) AS date, {num(q='coalesce(a.q, n.q)')} FROM a FULL JOIN n ON a.date = n.date",
    "feat_overwritten": f"WITH a AS ({_A}), n AS ({_N}) SELECT CAST(coalesce(a.date, n.date) AS VARCHAR) AS date, {num(q='CASE WHEN n.date IS NOT NULL THEN n.q ELSE a.q END')} FROM a FULL JOIN n ON a.date = n.date",
    "feat_with_dataset": f"""WITH w AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS a, sum(o_totalprice) FILTER (o_orderpriority LIKE '2%') AS b FROM orders GROUP BY 1)
      SELECT {_DAY}, 'e5l' AS dataset, {num(prcp='a')} FROM w UNION ALL SELECT {_DAY}, 'gpcp', {num(prcp='b')} FROM w""",
    "feat_leave_one_out": "SELECT a.n_name AS fold, b.n_name AS gauge_id FROM nation a, nation b WHERE a.n_name <> b.n_name",
    "feat_nearest_cell": f"SELECT s_suppkey, {num(lon='s_acctbal / 100', lat='s_nationkey * 1.3::DOUBLE')}, CAST(floor(s_acctbal / 100 / 0.25 + 0.5) AS BIGINT) AS cell_x, CAST(floor(s_nationkey * 1.3::DOUBLE / 0.25 + 0.5) AS BIGINT) AS cell_y FROM supplier",
    "feat_nearest_vote": """WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 100.0 AS y, s_nationkey % 3 AS label FROM supplier), d AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS k
      FROM p a, p b WHERE a.id % 2 = 1 AND b.id % 2 = 0), v AS (SELECT id, label, count(*) AS n FROM d WHERE k <= 5 GROUP BY 1, 2) SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""",
    "feat_z_scores": f"SELECT s_suppkey, s_nationkey, {num(s_acctbal='(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey)) / nullif(stddev_samp(s_acctbal) OVER (PARTITION BY s_nationkey), 0)')} FROM supplier",
    "feat_argmax_column": """WITH x AS (SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q, sum(l_extendedprice) / 1000 AS p, sum(l_tax) * 500 AS t FROM lineitem GROUP BY 1, 2, 3)
      SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN q >= p AND q >= t THEN 'quantity' WHEN p >= t THEN 'price' ELSE 'tax' END AS best FROM x""",
    "feat_seasonal_cycle": f"SELECT gauge_id, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, {num(q='quantile_cont(q, 0.5)')} FROM ({FLAG_FLOW}) GROUP BY 1, 2, 3",
    "feat_resampled": f"WITH ts AS ({FLOW}), s AS (SELECT gauge_id, q, min(date) OVER (PARTITION BY gauge_id) AS a, date FROM ts) SELECT gauge_id, CAST(CAST(a + CAST(floor(date_diff('day', a, date) / 10) * 10 AS INTEGER) AS DATE) AS VARCHAR) AS date, {num(q='sum(q)')} FROM s GROUP BY 1, 2",
    "feat_densified": f"WITH ts AS ({FLOW}), s AS (SELECT gauge_id, min(date) AS a, max(date) AS b FROM ts GROUP BY 1), d AS (SELECT gauge_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s) SELECT gauge_id, CAST(date AS VARCHAR) AS date, {num(q='q')} FROM d LEFT JOIN ts USING (gauge_id, date)",
    "feat_interpolated": f"""WITH g AS ({_GAPS}), k AS (SELECT *, last_value(CASE WHEN q IS NOT NULL THEN date END IGNORE NULLS) OVER b AS d0, last_value(q IGNORE NULLS) OVER b AS q0, first_value(CASE WHEN q IS NOT NULL THEN date END IGNORE NULLS) OVER a AS d1, first_value(q IGNORE NULLS) OVER a AS q1 FROM g
      WINDOW b AS (PARTITION BY gauge_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY gauge_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT gauge_id, {_DAY}, {num(q="coalesce(q, q0 + date_diff('day', d0, date) / nullif(CAST(date_diff('day', d0, d1) AS DOUBLE), 0) * (q1 - q0))")} FROM k""",
    "feat_completeness": f"SELECT gauge_id, {num(valid_share='count(q) / CAST(count(*) AS DOUBLE)')}, CASE WHEN count(q) = count(*) THEN 'full' WHEN count(q) > 0 THEN 'partial' ELSE 'empty' END AS class FROM ({_GAPS}) GROUP BY gauge_id",
    "feat_pivot_years": f"SELECT CAST(year(date) AS INTEGER) AS year, {num(**{g: f'avg(q) FILTER (gauge_id = {chr(39)}{g}{chr(39)})' for g in 'ANR'})} FROM ({FLAG_FLOW}) GROUP BY 1",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "join_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "set_intersect": "SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "set_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "agg_string_list": "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1",
}
