"""Queries over daily series, panels and events, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from brindle.functions import dates as T, numbers as M
from brindle.operators import aggregate as A, joins as J, ml, stats as E, trees as TR, var as V, windows as W
from brindle.sources import files as S, paging as G, polling as PO
from brindle.streaming import streams as R, threads as TH

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add

#: Operators on rows that are typed in: tests run them, they are no queries.
EXAMPLES: dict = {}
EXAMPLES_SQL: dict[str, str] = {}


def example(sql: str | None = None):
    def add(f):
        EXAMPLES[f.__name__] = f
        if sql:
            EXAMPLES_SQL[f.__name__] = sql
        return f

    return add



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    """Rounded half-even to six places plus 0.0, which makes -0.0 a 0.0."""
    return (F.bround(c, 6) + F.lit(0.0)).alias(name)


def s6(expr: str) -> str:
    return f"round_even({expr}, 6) + 0.0"


def daily(spark, sf) -> DataFrame:
    """date, value, n of the events by day, rounded so that later sums see the same numbers everywhere."""
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.bround(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


DAILY = "daily AS (SELECT CAST(ts AS DATE) AS date, round_even(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1)"


@query(f"WITH {DAILY} SELECT * FROM daily")
def daily_mean(spark, sf):
    return daily(spark, sf)


@query("SELECT event_type, count(value) AS n, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def daily_summary(spark, sf):
    return A.summary(table(spark, sf, "events"), "value", ["event_type"]).withColumns({"mean": F.bround("mean", 6), "std": F.bround("std", 6)})


@query(f"WITH {DAILY} (SELECT 'worst' AS side, date, value FROM daily ORDER BY value, date LIMIT 3) UNION ALL (SELECT 'best' AS side, date, value FROM daily ORDER BY value DESC, date LIMIT 3)")
def best_worst_days(spark, sf):
    """O3: three smallest and three largest, ties by date."""
    d = daily(spark, sf).select("date", "value")
    worst, best = d.orderBy("value", "date").limit(3), d.orderBy(F.desc("value"), "date").limit(3)
    return worst.select(F.lit("worst").alias("side"), "*").unionByName(best.select(F.lit("best").alias("side"), "*"))


@query("""SELECT CAST(ts AS DATE) AS date, event_type, round_even(sum(value * (coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), 0) + 1)) / sum(coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), 0) + 1), 6) AS weighted_sentiment FROM events GROUP BY ALL""")
def weighted_daily_sentiment(spark, sf):
    """A8 with Y4: the weight out of JSON."""
    df = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    out = A.weighted_mean(df, ["date", "event_type"], F.col("value"), S.json_number(F.col("props"), "$.k") + 1)
    return out.withColumn("weighted_sentiment", F.bround("weighted_sentiment", 6))


@query("""WITH heavy AS (SELECT DISTINCT user_id FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS c FROM events GROUP BY ALL) WHERE c > 6)
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM heavy)""")
def heavy_users_anti(spark, sf):
    return J.without_heavy_authors(table(spark, sf, "events"), "user_id", F.to_date("ts"), 6).select("event_id", "user_id")


@query(f"WITH {DAILY} SELECT date, {s6('value / nullif(lag(value) OVER (ORDER BY date), 0) - 1')} AS ret, {s6('ln(abs(value) + 1) - ln(lag(abs(value) + 1) OVER (ORDER BY date))')} AS log_ret FROM daily")
def daily_return(spark, sf):
    w = W.over("date")
    return daily(spark, sf).select("date", r6(W.simple_return(F.col("value"), w), "ret"), r6(W.log_return(F.abs("value") + 1, w), "log_ret"))


@query(f"WITH {DAILY} SELECT date, value, lag(value, 1) OVER (ORDER BY date) AS value_lag1, lag(value, 2) OVER (ORDER BY date) AS value_lag2, {s6('value - lag(value) OVER (ORDER BY date)')} AS d_value FROM daily")
def lags(spark, sf):
    out = W.first_difference(W.lags(daily(spark, sf).select("date", "value"), ["value"], "date"), ["value"], "date")
    return out.select("date", "value", "value_lag1", "value_lag2", r6(F.col("d_value"), "d_value"))


@query(f"""WITH {DAILY} SELECT date, CASE WHEN count(value) OVER w5 = 5 THEN {s6('stddev_samp(value) OVER w5')} END AS sd5, CASE WHEN count(value) OVER f5 = 5 THEN {s6('stddev_samp(value) OVER f5')} END AS vol5,
CASE WHEN count(value) OVER w4 >= 2 THEN {s6('sum(value) OVER w4')} END AS ttm FROM daily WINDOW w5 AS (ORDER BY date ROWS 4 PRECEDING), f5 AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), w4 AS (ORDER BY date ROWS 3 PRECEDING)""")
def rolling(spark, sf):
    """W5, W7, W8."""
    return daily(spark, sf).select("date", r6(W.rolling_sd("value", "date"), "sd5"), r6(W.forward_sd("value", "date"), "vol5"), r6(W.trailing_sum("value", "date"), "ttm"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS filled FROM events""")
def ffill(spark, sf):
    ev = table(spark, sf, "events").withColumn("filled", F.when(F.col("event_type") == "purchase", F.col("value")))
    return J.carried(ev, "filled", "ts", ["event_id"], ["user_id"]).select("event_id", "user_id", "filled")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, e.user_id, p.value AS last_purchase FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_backward(spark, sf):
    ev = table(spark, sf, "events")
    left = ev.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = ev.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return J.asof_backward(left, right, "ts", ["user_id"], ["last_purchase"]).drop("ts")


ORDERS_DAY = "od AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)"
MONTHLY = "mo AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, count(*) AS month_n FROM orders GROUP BY 1)"


@query(f"""WITH {ORDERS_DAY}, {MONTHLY}, wk AS (SELECT * FROM od WHERE isodow(date) <= 5), j AS (SELECT wk.date, n, month_n FROM wk LEFT JOIN mo USING (date))
SELECT date, n, last_value(month_n IGNORE NULLS) OVER (ORDER BY date) AS month_n FROM j""")
def exact_then_ffill(spark, sf):
    """Month ends on a weekend are lost, as the fill follows an exact match."""
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    days = o.groupBy("date").agg(F.count("*").alias("n")).filter(F.weekday("date") < 5)
    months = o.groupBy(F.last_day("date").alias("date")).agg(F.count("*").alias("month_n"))
    return J.exact_then_ffill(days, months, "date", ["month_n"])


@query(f"""WITH {ORDERS_DAY}, {MONTHLY}, wk AS (SELECT * FROM od WHERE isodow(date) <= 5) SELECT wk.date, wk.n, mo.month_n FROM wk ASOF LEFT JOIN mo ON wk.date >= mo.date""")
def asof_month_end(spark, sf):
    """J5 on the same tables: month ends on a weekend count."""
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    days = o.groupBy("date").agg(F.count("*").alias("n")).filter(F.weekday("date") < 5)
    months = o.groupBy(F.last_day("date").alias("date")).agg(F.count("*").alias("month_n"))
    return J.asof_backward(days, months, "date", [], ["month_n"])


@query("""WITH cal AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-01-26', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5 AND CAST(d AS DATE) <> DATE '2024-01-15'),
l AS (SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM events)
SELECT event_id, (SELECT min(day) FROM cal WHERE CASE WHEN et::TIME >= TIME '16:00:00' THEN day > et::DATE ELSE day >= et::DATE END) AS trading_date FROM l""")
def trading_day_map(spark, sf):
    """J11 with a weekday calendar that has a holiday and an end."""
    cal = T.days(spark, "2024-01-01", 26).filter((F.weekday("day") < 5) & (F.col("day") != F.lit("2024-01-15").cast("date")))
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.trading_days(ev, "ts", cal).select("event_id", "trading_date")


@query("""WITH m AS (SELECT strftime(CAST(d AS DATE), '%Y-%m') AS month FROM generate_series(DATE '1994-06-01', DATE '2002-12-01', INTERVAL 1 MONTH) t(d)), p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT month FROM m ANTI JOIN p USING (month)""")
def month_gaps(spark, sf):
    """T4, J10, U3."""
    spine = T.months(spark, "1994-06-01", "2002-12-01").select(F.date_format("month", "yyyy-MM").alias("month"))
    return J.spine_gaps(spine, table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")), "month")


@query("""WITH m AS (SELECT strftime(CAST(d AS DATE), '%Y-%m') AS month FROM generate_series(DATE '1994-06-01', DATE '2002-12-01', INTERVAL 1 MONTH) t(d)), p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, 1 AS one FROM orders)
SELECT count(*) AS expected, count(one) AS present, CAST(round(100.0 * count(one) / count(*)) AS BIGINT) AS pct FROM m LEFT JOIN p USING (month)""")
def folder_completeness(spark, sf):
    """S23."""
    spine = T.months(spark, "1994-06-01", "2002-12-01").select(F.date_format("month", "yyyy-MM").alias("month"))
    return J.completeness(spine, table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")), "month")


PANEL = """q AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue, count(*) AS shares, count(*) FILTER (WHERE o_orderstatus = 'F') AS debt, count(*) FILTER (WHERE o_orderstatus = 'Z') AS equity FROM orders GROUP BY 1)"""


def half_even(cents: str, by: str, places: int) -> str:
    """SQL of a number of cents over a whole number, to so many places, ties to the even digit: in whole numbers, as DuckDB divides decimals as doubles."""
    n, d = f"(({cents}) * {10 ** (places - 2)}::HUGEINT)", f"nullif(CAST({by} AS HUGEINT), 0)"
    return f"CAST({n} // {d} + CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / {10 ** places}"


@query(f"""WITH {PANEL}, c AS (SELECT *, CAST(revenue * 100 AS HUGEINT) AS cents FROM q), t AS (SELECT *, CASE WHEN count(cents) OVER w >= 2 THEN CAST(sum(cents) OVER w AS HUGEINT) END AS ttm FROM c WINDOW w AS (ORDER BY date ROWS 3 PRECEDING))
SELECT date, {half_even('cents * shares * 100', 'ttm', 6)} AS p_s, {half_even('ttm', 'shares', 4)} AS eps, debt / nullif(CAST(equity AS DOUBLE), 0) AS debt_equity, CAST(cents * shares + (debt - equity) * 100 AS DOUBLE) / 100 AS ev FROM t""")
def panel_ratios(spark, sf):
    """W5, M3, M4 in decimals; a zero denominator gives null."""
    q = table(spark, sf, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"), F.count("*").alias("shares"), F.count_if(F.col("o_orderstatus") == "F").alias("debt"), F.count_if(F.col("o_orderstatus") == "Z").alias("equity")
    )
    q = q.withColumn("ttm", W.trailing_sum("revenue", "date").cast("decimal(20,2)"))
    shares, cap = F.col("shares").cast("decimal(8,0)"), F.col("revenue").cast("decimal(18,2)") * F.col("shares").cast("decimal(8,0)")
    return q.select("date", F.bround(M.ratio(cap, F.col("ttm")), 6).cast("double").alias("p_s"), F.bround(M.ratio(F.col("ttm"), shares), 4).cast("double").alias("eps"),
                    M.ratio(F.col("debt").cast("double"), F.col("equity").cast("double")).alias("debt_equity"), M.enterprise_value(cap, F.col("debt"), F.col("equity")).cast("double").alias("ev"))


@query(f"""WITH {DAILY}, s AS (SELECT date, value, row_number() OVER (ORDER BY date) AS t FROM daily), e AS (SELECT date AS event_day, t FROM s WHERE day(date) IN (10, 20))
SELECT e.event_day, CAST(s.t - e.t AS INTEGER) AS "offset", s.date, s.value FROM e JOIN s ON s.t BETWEEN e.t - 1 AND e.t + 3""")
def event_windows(spark, sf):
    """Rows one day before to three after each event."""
    d = daily(spark, sf).select("date", "value")
    events = d.filter(F.dayofmonth("date").isin(10, 20)).select(F.col("date").alias("event_day"))
    return J.event_windows(d, events, "date", -1, 3).select("event_day", F.col("offset").cast("int").alias("offset"), "date", "value")


@query(f"""WITH each AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS r FROM events GROUP BY ALL), market AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS m FROM events GROUP BY 1),
s AS (SELECT event_type, date, r, m, row_number() OVER (PARTITION BY event_type ORDER BY date) AS t FROM each JOIN market USING (date)), e AS (SELECT event_type, date AS event_day, t AS mid FROM s WHERE day(date) IN (15, 20)),
f AS (SELECT event_type, event_day, regr_slope(r, m) AS slope, regr_intercept(r, m) AS intercept FROM e JOIN s USING (event_type) WHERE t BETWEEN mid - 10 AND mid - 1 GROUP BY ALL)
SELECT event_type, event_day, {s6('sum(r - intercept - slope * m)')} AS car FROM e JOIN f USING (event_type, event_day) JOIN s USING (event_type) WHERE t BETWEEN mid - 1 AND mid + 1 GROUP BY ALL""")
def event_window_car(spark, sf):
    """Abnormal returns by event type against the mean of all."""
    ev = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    each, market = ev.groupBy("event_type", "date").agg(F.avg("value").alias("r")), ev.groupBy("date").agg(F.avg("value").alias("m"))
    events = each.filter(F.dayofmonth("date").isin(15, 20)).select("event_type", F.col("date").alias("event_day"))
    return E.abnormal_returns(each, market, events, "event_type", "date", "r", "m").withColumn("car", r6(F.col("car"), "car"))


@query(f"""WITH {DAILY}, p AS (SELECT value AS y, lag(value) OVER (ORDER BY date) AS x FROM daily) SELECT {s6('regr_slope(y, x)')} AS slope, {s6('regr_intercept(y, x)')} AS intercept, {s6('regr_r2(y, x)')} AS r2 FROM p""")
def ols_univariate(spark, sf):
    d = W.lags(daily(spark, sf), ["value"], "date", (1,))
    return d.agg(r6(F.regr_slope("value", "value_lag1"), "slope"), r6(F.regr_intercept("value", "value_lag1"), "intercept"), r6(F.regr_r2("value", "value_lag1"), "r2"))


@query(f"""WITH {DAILY}, e AS (SELECT date, value - avg(value) OVER () AS e FROM daily), d AS (SELECT e, e - lag(e) OVER (ORDER BY date) AS d FROM e) SELECT {s6('sum(d * d) / sum(e * e)')} AS durbin_watson FROM d""")
def durbin_watson(spark, sf):
    d = daily(spark, sf).withColumn("e", F.col("value") - F.avg("value").over(Window.partitionBy()))
    return E.durbin_watson(d, "e", "date").select(r6(F.col("durbin_watson"), "durbin_watson"))


@query(f"""WITH m AS (SELECT count(value) AS n, avg(value) AS a FROM events), c AS (SELECT n, sum((value - a) ** 2) / n AS m2, sum((value - a) ** 3) / n AS m3, sum((value - a) ** 4) / n AS m4 FROM events, m GROUP BY n)
SELECT n, {s6('m3 / m2 ** 1.5')} AS skewness, {s6('m4 / m2 ** 2 - 3')} AS kurtosis, round_even(n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 3) AS jarque_bera FROM c""")
def jarque_bera(spark, sf):
    out = E.jarque_bera(table(spark, sf, "events"), "value")
    return out.select("n", r6(F.col("skewness"), "skewness"), r6(F.col("kurtosis"), "kurtosis"), F.bround("jarque_bera", 3).alias("jarque_bera"))


@query(f"""WITH {DAILY}, d AS (SELECT date, value - avg(value) OVER () AS d FROM daily), l AS (SELECT d, """ + ", ".join(f"d * lag(d, {k}) OVER (ORDER BY date) AS p{k}" for k in range(1, 6)) + """ FROM d)
""" + " UNION ALL ".join(f"SELECT {k} AS lag, {s6(f'sum(p{k}) / sum(d * d)')} AS acf FROM l" for k in range(1, 6)))
def acf(spark, sf):
    return W.autocorrelation(daily(spark, sf), "value", "date", 5).select("lag", r6(F.col("acf"), "acf"))


@query(f"""WITH {DAILY}, f AS (SELECT date, value AS y, CAST(n AS DOUBLE) AS x, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS t, count(*) OVER w AS n, sum(n) OVER w AS sx, sum(value) OVER w AS sy, sum(CAST(n AS DOUBLE) * n) OVER w AS sxx, sum(n * value) OVER w AS sxy
FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS b FROM f)
SELECT date, y AS value, round_even((sy - b * sx) / n + b * x, 5) + 0.0 AS forecast FROM s WHERE r > floor(0.8 * t)""")
def expanding_forecast(spark, sf):
    """Each of the last fifth of days forecast from the days before it."""
    d = daily(spark, sf).withColumn("n", F.col("n").cast("double")).withColumnRenamed("n", "x")
    return W.expanding_forecast(d, "value", "x", "date").withColumn("forecast", F.bround("forecast", 5) + 0.0)


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1""")
def histogram(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 20)


@query("SELECT event_type, round_even(quantile_cont(value, 0.25), 6) AS q1, round_even(quantile_cont(value, 0.5), 6) AS median, round_even(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def quartiles(spark, sf):
    return A.quartiles(table(spark, sf, "events"), "event_type", "value").select("event_type", *[F.bround(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query("SELECT event_type, round_even(avg(value), 2) AS mean_score, count(*) AS n, round_even(avg(user_id), 2) AS mean_other FROM events GROUP BY 1")
def keyword_stats(spark, sf):
    return A.by_keyword(table(spark, sf, "events"), "event_type", "value", "user_id")


@query("SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(*) AS n FROM events")
def date_span(spark, sf):
    return A.span(table(spark, sf, "events").withColumn("d", F.to_date("ts")), "d")


@query("SELECT user_id, event_type, CAST(sum(value) > 0 AS BOOLEAN) AS positive FROM events GROUP BY ALL HAVING abs(sum(value)) > 2")
def abs_threshold(spark, sf):
    """P16."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("s")).filter(F.abs("s") > 2).select("user_id", "event_type", (F.col("s") > 0).alias("positive"))


def _model(spark, sf) -> DataFrame:
    """A daily panel: y, three regressors, in date order."""
    ev = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    out = ev.groupBy("date").agg(F.avg("value").alias("y"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("x1"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("x2"),
                                 F.stddev_samp("value").alias("x3"))
    return out


X = ["x1", "x2", "x3"]


def _model_sql() -> str:
    """The panel m with, for each term, what the other terms leave of it (r_), the residual e and the leverage h."""
    ctes = [
        "m AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS y, avg(value) FILTER (WHERE event_type = 'purchase') AS x1, avg(value) FILTER (WHERE event_type = 'click') AS x2, "
        "stddev_samp(value) AS x3, 1.0::DOUBLE AS one FROM events GROUP BY 1 HAVING y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)"
    ]
    terms, at, kept = ["one", *X], "m", "date, y, x1, x2, x3, one"
    for last in terms:
        order = [*(t for t in terms if t != last), last]
        for k, c in enumerate(order):
            rest = " - ".join([c, *(f"o{i} * (sum({c} * o{i}) OVER () / sum(o{i} * o{i}) OVER ())" for i in range(k))])
            ctes.append(f"{last}_{k} AS (SELECT *, {rest} AS o{k} FROM {at})")
            at = f"{last}_{k}"
        kept += f", r_{last}"
        more = ""
        if last == terms[-1]:
            fit = " + ".join(f"o{i} * (sum(y * o{i}) OVER () / sum(o{i} * o{i}) OVER ())" for i in range(4))
            more = f", {fit} AS fitted, " + " + ".join(f"o{i} * o{i} / sum(o{i} * o{i}) OVER ()" for i in range(4)) + " AS h, count(*) OVER () AS n, o0 AS q0, o1 AS q1, o2 AS q2, o3 AS q3"
        ctes.append(f"{last}_r AS (SELECT * EXCLUDE (o0, o1, o2, o3), o3 AS r_{last}{more} FROM {at})")
        at = f"{last}_r"
    ctes.append(f"f AS (SELECT *, y - fitted AS e FROM {at})")
    return ", ".join(ctes)


MODEL = _model_sql()
TERMS = {"(Intercept)": "r_one", "x1": "r_x1", "x2": "r_x2", "x3": "r_x3"}


def _terms_sql(variances: dict[str, str]) -> str:
    """The coefficient table, of the variance of each kind as SQL over f with r; p values by Simpson's rule on the t density in the angle."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS term, '{kind}' AS se_type, sum(y * {r}) / sum({r} * {r}) AS b, sqrt({v.replace('RR', f'sum({r} * {r})').replace('R', r)}) AS se, count(*) - 4 AS df FROM f" for kind, v in variances.items() for name, r in TERMS.items()
    )
    return (
        f"t AS ({rows}), g AS (SELECT *, b / se AS t, atan(abs(b / se) / sqrt(df)) / 2000 AS w FROM t), "
        "p AS (SELECT term, se_type, 1 - 2 * exp(lgamma((any_value(df) + 1) / 2.0) - lgamma(any_value(df) / 2.0)) / sqrt(pi()) * any_value(w) / 3 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * w), df - 1)) AS p_value "
        "FROM g, range(0, 2001) r(i) GROUP BY ALL) "
        f"SELECT term, {s6('b')} AS estimate, {s6('se')} AS std_error, {s6('t')} AS statistic, {s6('p_value')} AS p_value, {s6('b - 1.96 * se')} AS low, {s6('b + 1.96 * se')} AS high, se_type FROM g JOIN p USING (term, se_type)"
    )


def _rounded(df: DataFrame, *same: str) -> DataFrame:
    """Every double but those named to six places."""
    return df.select(*[r6(F.col(c), c) if t == "double" and c not in same else F.col(c) for c, t in df.dtypes])


OLS_VARIANCE = "sum(e * e) / (count(*) - 4) / RR"
HC_VARIANCES = {
    "HC1": "sum(R * R * e * e) * count(*) / (count(*) - 4) / (RR * RR)", "HC3": "sum(R * R * e * e / ((1 - h) * (1 - h))) / (RR * RR)",
    "HC4": "sum(R * R * e * e / pow(1 - h, least(4.0, h * n / 4))) / (RR * RR)",
}


@query(f"WITH {MODEL}, {_terms_sql({'OLS': OLS_VARIANCE})}")
def ols_multi(spark, sf):
    """E1, E2, E5, E18; a repeated regressor is dropped."""
    d = _model(spark, sf).withColumn("again", F.col("x1") * 2)
    return _rounded(E.coefficient_table(spark, E.ols(d, "y", [*X, "again"])))


@query(f"WITH {MODEL}, {_terms_sql(HC_VARIANCES)}")
def hc_se(spark, sf):
    """E3."""
    d = _model(spark, sf)
    fit = E.ols(d, "y", X)
    out = [E.coefficient_table(spark, fit, E.robust_covariance(d, fit, k), k) for k in ("HC1", "HC3", "HC4")]
    return _rounded(out[0].unionByName(out[1]).unionByName(out[2]))


NW_COLUMNS = ", ".join(f"lag({r} * e, {k}) OVER (ORDER BY date) AS {r}_{k}" for r in TERMS.values() for k in range(1, 8))
NW_VARIANCE = "(sum(R * R * e * e)" + "".join(f" + CASE WHEN {k} <= any_value(lags) THEN 2 * (1 - {k} / (any_value(lags) + 1.0)) * coalesce(sum(R * e * R_{k}), 0) ELSE 0 END" for k in range(1, 8)) + ") * count(*) / (count(*) - 4) / (RR * RR)"


@query(f"WITH {MODEL.replace('f AS (', 'f0 AS (')}, f AS (SELECT *, greatest(1, CAST(floor(0.75 * pow(n, 1.0 / 3)) AS INTEGER)) AS lags, {NW_COLUMNS} FROM f0), {_terms_sql({'NW': NW_VARIANCE})}")
def newey_west(spark, sf):
    """E4."""
    d = _model(spark, sf)
    fit = E.ols(d, "y", X)
    return _rounded(E.coefficient_table(spark, fit, E.newey_west(d, fit, "date"), "NW"))


@query()
def diagnostics(spark, sf):
    """E6-E11, E16, E17 of one model."""
    d = _model(spark, sf)
    fit = E.ols(d, "y", X)
    res = fit.residuals(d)
    out = [(f"vif_{k}", v, None) for k, v in E.vif(d, X).items()]
    out += [("breusch_pagan", *E.breusch_pagan(d, fit)), ("score_test", *E.score_test(d, fit)), ("breusch_godfrey_1", *E.breusch_godfrey(d, fit, "date", 1)), ("breusch_godfrey_4", *E.breusch_godfrey(d, fit, "date", 4))]
    out += [("adf", *E.adf(d, "y", "date")), ("ljung_box", *E.ljung_box(res, "e", "date", 5)), ("arch_lm", *E.arch_lm(res, "e", "date", 3)), ("granger_x1_y", *E.granger(d, "x1", "y", "date")), ("granger_y_x1", *E.granger(d, "y", "x1", "date"))]
    return spark.createDataFrame([(a, float(b), c if c is None else float(c)) for a, b, c in out], "test string, statistic double, p_value double")


def _chain(name: str, source: str, columns: list[str]) -> str:
    """CTEs name_0, name_1, ... that add to a table what earlier columns leave of each column: g0, g1, ..."""
    return ", ".join(
        f"{name}_{k} AS (SELECT *, " + " - ".join([c, *(f"g{i} * (sum({c} * g{i}) OVER () / sum(g{i} * g{i}) OVER ())" for i in range(k))]) + f" AS g{k} FROM {name + '_' + str(k - 1) if k else source})"
        for k, c in enumerate(columns)
    )


def _part(target: str, g: str) -> str:
    """The sum of squares of the target that a column explains."""
    return f"sum({target} * {g}) * sum({target} * {g}) / sum({g} * {g})"


def _granger_sql(name: str, cause: str, effect: str) -> tuple[str, str]:
    lagged = f"{name}_l AS (SELECT * FROM (SELECT one, {effect} AS t, lag({effect}) OVER (ORDER BY date) AS own, lag({cause}) OVER (ORDER BY date) AS other FROM m) WHERE own IS NOT NULL AND other IS NOT NULL)"
    full = f"sum(t * t) - {_part('t', 'g0')} - {_part('t', 'g1')} - {_part('t', 'g2')}"
    return f"{lagged}, {_chain(name, f'{name}_l', ['one', 'own', 'other'])}", f"SELECT '{name}', {_part('t', 'g2')} / (({full}) / (count(*) - 3)), 1, count(*) - 3 FROM {name}_2"


#: w and p (test, statistic, p_value) of t (test, statistic, d1, d2): F, or chi-squared where d2 is null; the densities by Simpson's rule.
P_VALUES = """w AS (SELECT *, CASE WHEN d2 IS NULL THEN sqrt(statistic) ELSE asin(sqrt(d1 * statistic / (d1 * statistic + d2))) END / 2000 AS w,
CASE WHEN d2 IS NULL THEN 2 / (pow(2, d1 / 2.0) * gamma(d1 / 2.0)) ELSE 2 * exp(lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0)) END AS front FROM t),
p AS (SELECT test, any_value(statistic) AS statistic, 1 - any_value(front) * any_value(w) / 3 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
* CASE WHEN d2 IS NULL THEN pow(i * w, d1 - 1) * exp(-i * w * i * w / 2) ELSE pow(sin(i * w), d1 - 1) * pow(cos(i * w), d2 - 1) END) AS p_value FROM w, range(0, 2001) r(i) GROUP BY test)"""
GRANGER = [_granger_sql("granger_x1_y", "x1", "y"), _granger_sql("granger_y_x1", "y", "x1")]
LAGS = ", ".join(f"coalesce(lag(e, {k}) OVER (ORDER BY date), 0) AS e{k}, lag(e * e, {k}) OVER (ORDER BY date) AS s{k}" for k in range(1, 5))
BASIS = ["q0", "q1", "q2", "q3"]
TESTS_SQL = f"""WITH {MODEL}, l AS (SELECT *, e * e AS s, {LAGS} FROM f), a AS (SELECT * FROM l WHERE s3 IS NOT NULL), {_chain('bg', 'l', [*BASIS, 'e1', 'e2', 'e3', 'e4'])}, {_chain('arch', 'a', ['one', 's1', 's2', 's3'])}, {GRANGER[0][0]}, {GRANGER[1][0]},
d AS (SELECT date, e - avg(e) OVER () AS d FROM f), c AS (SELECT *, {", ".join(f"d * lag(d, {k}) OVER (ORDER BY date) AS p{k}" for k in range(1, 6))} FROM d),
t(test, statistic, d1, d2) AS (SELECT 'breusch_pagan', count(*) * ({" + ".join(_part('s', q) for q in BASIS[1:])}) / (sum(s * s) - {_part('s', 'q0')}), 3, NULL FROM l
UNION ALL SELECT 'score_test', count(*) * covar_pop(u, fitted) * covar_pop(u, fitted) / var_pop(fitted) / 2, 1, NULL FROM (SELECT s / avg(s) OVER () AS u, fitted FROM l)
UNION ALL SELECT 'breusch_godfrey_1', count(*) * {_part('e', 'g4')} / sum(e * e), 1, NULL FROM bg_4
UNION ALL SELECT 'breusch_godfrey_4', count(*) * ({" + ".join(_part('e', f'g{k}') for k in range(4, 8))}) / sum(e * e), 4, NULL FROM bg_7
UNION ALL SELECT 'ljung_box', count(*) * (count(*) + 2) * ({" + ".join(f"pow(sum(p{k}) / sum(d * d), 2) / (count(*) - {k})" for k in range(1, 6))}), 5, NULL FROM c
UNION ALL SELECT 'arch_lm', count(*) * ({" + ".join(_part('s', f'g{k}') for k in range(1, 4))}) / (sum(s * s) - {_part('s', 'g0')}), 3, NULL FROM arch_3
UNION ALL {GRANGER[0][1]} UNION ALL {GRANGER[1][1]}),
{P_VALUES}
SELECT test, {s6('statistic')} AS statistic, {s6('p_value')} AS p_value FROM p"""


@query(TESTS_SQL)
def diagnostic_tests(spark, sf):
    """E7, E9, E16 and E17 of one model: statistics and p values (in the SQL by Simpson's rule on the densities)."""
    d = _model(spark, sf)
    fit = E.ols(d, "y", X)
    res = fit.residuals(d)
    out = [("breusch_pagan", *E.breusch_pagan(d, fit)), ("score_test", *E.score_test(d, fit)), ("breusch_godfrey_1", *E.breusch_godfrey(d, fit, "date", 1)), ("breusch_godfrey_4", *E.breusch_godfrey(d, fit, "date", 4))]
    out += [("ljung_box", *E.ljung_box(res, "e", "date", 5)), ("arch_lm", *E.arch_lm(res, "e", "date", 3)), ("granger_x1_y", *E.granger(d, "x1", "y", "date")), ("granger_y_x1", *E.granger(d, "y", "x1", "date"))]
    return _rounded(spark.createDataFrame([(a, float(b), float(c)) for a, b, c in out], "test string, statistic double, p_value double"))


VIF_SQL = " UNION ALL ".join(f"SELECT '{x}' AS term, {s6(f'sum(({x} - a{i}) * ({x} - a{i})) / sum(r_{x} * r_{x})')} AS vif FROM f, a" for i, x in enumerate(X))


@query(f"WITH {MODEL}, a AS (SELECT avg(x1) AS a0, avg(x2) AS a1, avg(x3) AS a2 FROM f) {VIF_SQL}")
def variance_inflation(spark, sf):
    """E6."""
    return spark.createDataFrame(list(E.vif(_model(spark, sf), X).items()), "term string, vif double").select("term", r6(F.col("vif"), "vif"))


@query(f"""WITH {MODEL}, s AS (SELECT *, sum(e * e) OVER () AS rss FROM f), i AS (SELECT *, e / sqrt(rss / (n - 4) * (1 - h)) AS rstandard, e / sqrt((rss - e * e / (1 - h)) / (n - 5) * (1 - h)) * sqrt(h / (1 - h)) AS dffits FROM s),
c AS (SELECT *, rstandard * rstandard * h / (1 - h) / 4 AS cooks FROM i)
SELECT date, {s6('fitted')} AS fitted, {s6('e')} AS e, {s6('h')} AS h, {s6('rstandard')} AS rstandard, {s6('sqrt(abs(rstandard))')} AS root_abs, {s6('cooks')} AS cooks, {s6('dffits')} AS dffits, cooks > 4.0 / n OR abs(dffits) > 2 * sqrt(4.0 / n) AS influential FROM c""")
def influence(spark, sf):
    """E13, E14."""
    d = _model(spark, sf)
    return _rounded(E.influence(d, E.ols(d, "y", X)).select("date", "fitted", "e", "h", "rstandard", "root_abs", "cooks", "dffits", "influential"))


@query(f"""WITH {MODEL}, p AS (SELECT i / 10.0::DOUBLE AS power FROM range(-20, 21) r(i)), s AS (SELECT CASE WHEN min(y) <= 0 THEN 1 - min(y) ELSE 0 END AS shift FROM f),
z AS (SELECT power, n, q0, q1, q2, q3, ln(y + shift) AS l, CASE WHEN abs(power) < 1e-6 THEN ln(y + shift) ELSE (pow(y + shift, power) - 1) / power END AS z FROM f, p, s),
g AS (SELECT power, any_value(n) AS n, sum(l) AS l, sum(z * z) - {" - ".join(f"sum(z * q{k}) * sum(z * q{k}) / sum(q{k} * q{k})" for k in range(4))} AS rss FROM z GROUP BY power)
SELECT power + 0.0 AS power, round_even(-n / 2 * ln(rss / n) + (power - 1) * l, 4) + 0.0 AS log_likelihood FROM g""")
def boxcox(spark, sf):
    """The profile over the grid."""
    _, _, profile = E.box_cox_power(_model(spark, sf), "y", X)
    return spark.createDataFrame(profile, "power double, log_likelihood double").select((F.col("power") + 0.0).alias("power"), (F.bround("log_likelihood", 4) + 0.0).alias("log_likelihood"))


@query()
def arima_errors(spark, sf):
    """E15 by exact maximum likelihood, for each event type's daily means on their numbers of events; one series a group."""
    ev = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("n"))
    return E.arima_errors_ml(ev, "y", ["n"], "date", 2, by="event_type")


@query()
def garch(spark, sf):
    """E22 with Student's t errors for each event type's daily means."""
    ev = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("r"))
    return E.garch(ev, "event_type", "date", "r")


@query()
def tree_regression(spark, sf):
    """E19, E20."""
    return ml.fit_and_score(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round_even(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def stream_daily(spark, sf):
    """The stream in complete mode, to its end."""
    out = R.daily_counts(R.events_stream(spark, sf))
    rows = R.stream_result(spark, out, out.schema, "complete")
    return rows.withColumn("mean_value", F.bround("mean_value", 6))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf):
    """R2: ids seen for the first time."""
    out = R.first_seen(R.events_stream(spark, sf), "user_id").select("user_id")
    return R.stream_result(spark, out, out.schema, "append")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    """Session windows with a gap of six hours, in batch."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@example("""WITH d AS (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(x)), q AS (SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) t(ord, query)),
t AS (SELECT unnest(range(1, 5)) AS turn) SELECT day, query, CAST(turn AS INTEGER) AS turn FROM d, q, t WHERE (turn - 1) % 3 + 1 = ord""")
def daily_rounds(spark, sf):
    """Four pulls a day deal out three queries in turn."""
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord int, query string")
    return G.daily_rounds(T.days(spark, "2024-01-01", 30), q).select("day", "query", F.col("turn").cast("int").alias("turn"))


@query("SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200")
def keyset_paging(spark, sf):
    """Two pages of a hundred for each key, newest first."""
    ev = table(spark, sf, "events").select("event_type", "event_id", "ts").withColumn("at", F.struct("ts", "event_id"))
    return G.keyset_pages(ev, "at", ["event_type"], 100, 2).drop("at")


DATES = ["2024-03-05", "2024-03-05T10:11:12Z", "2024-03-05T10:11:12.123Z", "3/5/2024", "45356", "20240305", "Mar 5, 2024", "garbage", "5.3.2024"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, DATE '2024-03-05')" if t != "garbage" else f"({i}, NULL)" for i, t in enumerate(DATES)) + ") t(id, d)")
def date_parsing(spark, sf):
    """Formats in order, then spreadsheet serials."""
    return spark.createDataFrame(list(enumerate(DATES)), "id int, s string").select("id", T.parse_date(F.col("s")).alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def date_orders(spark, sf):
    """T6 on all orders, whose dates are written in five ways or not at all."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    ways = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(d, "M/d/yyyy"), F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"), F.date_format(d, "yyyyMMdd")]
    text = F.lit("none")
    for i, way in enumerate(ways):
        text = F.when(k == i, way).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", T.parse_date(text).alias("d"))


@query("""SELECT l_orderkey, l_linenumber, 1700000000 - CAST(l_quantity AS BIGINT) * CASE l_linenumber % 5 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 WHEN 3 THEN 1 END AS epoch FROM lineitem WHERE l_linenumber % 5 < 4
UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_linenumber % 5 = 4""")
def shorthand_lines(spark, sf):
    """T3 on all order lines: quantities as days, hours, minutes, seconds or plain numbers."""
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("d", "h", "m", "s", "")]), (F.col("l_linenumber") % 5 + 1).cast("int")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.ago_seconds(text, 1_700_000_000).alias("epoch"))


@query("""SELECT event_type, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS std, min(value) AS min, round_even(quantile_cont(value, 0.25), 6) AS q1, round_even(quantile_cont(value, 0.5), 6) AS median,
round_even(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max, count(value) AS n FROM events GROUP BY 1""")
def describe_events(spark, sf):
    """The eight figures of a description, for each kind of event."""
    ev = table(spark, sf, "events")
    out = A.summary(ev, "value", ["event_type"]).join(A.quartiles(ev, "event_type", "value"), "event_type")
    return out.select("event_type", *[F.bround(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.bround(c, 6).alias(c) for c in ("q1", "median", "q3")], "max", "n")


@query(f"WITH {MODEL}, {_terms_sql({'HC3': HC_VARIANCES['HC3']})} ORDER BY p_value, term".replace("SELECT term, round_even", "SELECT * FROM (SELECT term, round_even", 1).replace(" ORDER BY", ") WHERE p_value < 0.9 ORDER BY"))
def significant_terms(spark, sf):
    """Terms below a p value, smallest first."""
    d = _model(spark, sf)
    fit = E.ols(d, "y", X)
    out = _rounded(E.coefficient_table(spark, fit, E.robust_covariance(d, fit, "HC3"), "HC3"))
    return out.filter("p_value < 0.9").orderBy("p_value", "term")


AGO = ["30d", "12h", "5m", "10s", "1700000000", "soon"]


@query("SELECT * FROM (VALUES (0, 1697408000), (1, 1699956800), (2, 1699999700), (3, 1699999990), (4, 1700000000), (5, NULL)) t(id, epoch)")
def shorthand_times(spark, sf):
    """T3 with a fixed now."""
    return spark.createDataFrame(list(enumerate(AGO)), "id int, s string").select("id", T.ago_seconds(F.col("s"), 1_700_000_000).cast("int").alias("epoch"))


@example("""SELECT CAST(d AS DATE) AS month, CAST(epoch(d) AS BIGINT) AS start, CAST(epoch(d + INTERVAL 1 MONTH) AS BIGINT) AS stop FROM generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH) t(d)""")
def month_bounds(spark, sf):
    """T4, T5."""
    a, b = T.month_bounds(F.col("month"))
    return T.months(spark, "2023-11-01", "2024-03-01").select("month", a.alias("start"), b.alias("stop"))


@query("SELECT p_partkey, CASE WHEN abs(0.5) < 1e-6 THEN ln(p_retailprice) ELSE round_even((p_retailprice ** 0.5 - 1) / 0.5, 6) END AS bc, round_even(ln(1 + p_retailprice), 6) AS lp FROM part")
def transforms(spark, sf):
    """M1, M5."""
    return table(spark, sf, "part").select("p_partkey", F.bround(M.box_cox(F.col("p_retailprice"), 0.5), 6).alias("bc"), F.bround(F.log1p("p_retailprice"), 6).alias("lp"))


@query("SELECT n_name, r_name, count(*) AS n, round_even(avg(c_acctbal), 6) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_join(spark, sf):
    """Small dimensions, which Spark broadcasts by their size."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.bround(F.avg("c_acctbal"), 6).alias("mean_balance"))


def _systems(spark, sf) -> DataFrame:
    """emotion, date, x, y: each event type's daily mean beside the change of the mean of all."""
    d = daily(spark, sf).withColumn("y", F.bround(F.col("value") - F.lag("value").over(Window.orderBy("date")), 6)).select("date", "y")
    x = table(spark, sf, "events").groupBy(F.col("event_type").alias("emotion"), F.to_date("ts").alias("date")).agg(F.bround(F.avg("value"), 6).alias("x"))
    return x.join(d, "date")


VAR_LAGS = 3


def _by_emotion(name: str, columns: list[str]) -> str:
    """As _chain, within each emotion."""
    over = "OVER (PARTITION BY emotion)"
    return ", ".join(
        f"{name}_{k} AS (SELECT *, " + " - ".join([c, *(f"g{i} * (sum({c} * g{i}) {over} / sum(g{i} * g{i}) {over})" for i in range(k))]) + f" AS g{k} FROM {name + '_' + str(k - 1) if k else 'l'})"
        for k, c in enumerate(columns)
    )


def _left(s: str, t: str, parts: int) -> str:
    """The sum of products of two columns that the first parts leave."""
    return " - ".join([f"sum({s} * {t})", *(f"sum({s} * g{i}) * sum({t} * g{i}) / sum(g{i} * g{i})" for i in range(parts))])


VAR_SQL = f"""{DAILY}, r AS (SELECT date, round_even(value - lag(value) OVER (ORDER BY date), 6) AS y FROM daily),
s AS (SELECT event_type AS emotion, CAST(ts AS DATE) AS date, round_even(avg(value), 6) AS x FROM events GROUP BY ALL),
z AS (SELECT emotion, 1.0::DOUBLE AS one, {", ".join(f"lag(x, {k}) OVER v AS a{k}, lag(y, {k}) OVER v AS b{k}" for k in range(VAR_LAGS + 1))} FROM s JOIN r USING (date) WINDOW v AS (PARTITION BY emotion ORDER BY date)),
l AS (SELECT * FROM z WHERE {" AND ".join(f"a{k} IS NOT NULL AND b{k} IS NOT NULL" for k in range(VAR_LAGS + 1))}),
{_by_emotion("both", ["one", *(f"{c}{k}" for k in range(1, VAR_LAGS + 1) for c in "ab")])}, {_by_emotion("a", ["one", *(f"a{k}" for k in range(1, VAR_LAGS + 1))])}, {_by_emotion("b", ["one", *(f"b{k}" for k in range(1, VAR_LAGS + 1))])},
o AS ({" UNION ALL ".join(f"SELECT emotion, {k} AS lag, count(*) AS n, {_left('a0', 'a0', 2 * k + 1)} AS aa, {_left('b0', 'b0', 2 * k + 1)} AS bb, {_left('a0', 'b0', 2 * k + 1)} AS ab FROM both_{2 * VAR_LAGS} GROUP BY emotion" for k in range(1, VAR_LAGS + 1))}),
c AS (SELECT *, ln((aa * bb - ab * ab) / (n * n)) + 4.0 * (2 * lag + 1) / n AS aic, ln((aa * bb - ab * ab) / (n * n)) + 4 * ln(ln(n)) * (2 * lag + 1) / n AS hq,
ln((aa * bb - ab * ab) / (n * n)) + 2 * ln(n) * (2 * lag + 1) / n AS bic, pow((n + 2.0 * lag + 1) / (n - 2 * lag - 1), 2) * (aa * bb - ab * ab) / (n * n) AS fpe FROM o)"""


@query(f"WITH {VAR_SQL} SELECT emotion, lag, n, {s6('aic')} AS aic, {s6('hq')} AS hq, {s6('bic')} AS bic, {s6('fpe')} AS fpe FROM c")
def var_order(spark, sf):
    """Criteria of the orders of a two-variable autoregression for every emotion."""
    return _rounded(V.lag_criteria(_systems(spark, sf), ["x", "y"], "date", ["emotion"], VAR_LAGS))


@query(f"""WITH {VAR_SQL}, k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY aic, lag) = 1),
own AS ({" UNION ALL ".join(f"SELECT emotion, '{'y' if t == 'a' else 'x'}' AS cause, {k} AS lag, {_left(f'{t}0', f'{t}0', k + 1)} AS rss FROM {t}_{VAR_LAGS} GROUP BY emotion" for t in "ab" for k in range(1, VAR_LAGS + 1))}),
e AS (SELECT emotion, cause, lag, n, ((rss - CASE cause WHEN 'x' THEN bb ELSE aa END) / lag) / (CASE cause WHEN 'x' THEN bb ELSE aa END / (n - 2 * lag - 1)) AS f, lag AS d1, 2 * (n - 2 * lag - 1) AS d2, n * ab * ab / (aa * bb + ab * ab) AS instant FROM k JOIN own USING (emotion, lag)),
t(test, statistic, d1, d2) AS (SELECT emotion || '>' || cause, f, d1, d2 FROM e UNION ALL SELECT emotion || '=' || cause, instant, 1, NULL FROM e),
{P_VALUES},
j AS (SELECT e.*, f.p_value, i.p_value AS instant_p FROM e JOIN p AS f ON f.test = emotion || '>' || cause JOIN p AS i ON i.test = emotion || '=' || cause),
b AS (SELECT *, p_value * count(*) OVER (PARTITION BY cause) / count(*) OVER (PARTITION BY cause ORDER BY p_value) AS least FROM j)
SELECT emotion, cause, lag, n, {s6('f')} AS f, d1, d2, {s6('p_value')} AS p_value, {s6('instant')} AS instant, {s6('instant_p')} AS instant_p, {s6('min(least) OVER (PARTITION BY cause ORDER BY p_value DESC)')} AS p_adjusted FROM b""")
def var_causality(spark, sf):
    """Whether emotion and return cause each other in an autoregression of the order that Akaike's criterion chooses, p values adjusted over all emotions."""
    return _rounded(V.causality(_systems(spark, sf), ["x", "y"], "date", ["emotion"], VAR_LAGS))


def _replies(spark, sf) -> DataFrame:
    """id, parent of the turns: each answers the one before it."""
    at = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    return table(spark, sf, "conversations").select(at(F.col("turn")).alias("id"), at(F.col("turn") - 1).alias("parent"))


REPLIES_SQL = """RECURSIVE i AS (SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn - 1) AS parent FROM conversations),
t AS (SELECT id, parent, id AS root, 0 AS depth, CAST(NULL AS VARCHAR) AS top FROM i WHERE parent NOT IN (SELECT id FROM i)
UNION ALL SELECT i.id, i.parent, t.root, t.depth + 1, coalesce(t.top, i.id) FROM i JOIN t ON i.parent = t.id)"""


@query(f"WITH {REPLIES_SQL} SELECT t.*, (SELECT count(*) FROM i WHERE i.parent = t.id) AS n_replies FROM t")
def reply_tree(spark, sf):
    """Depth, root and top level of every turn, each an answer to the one before."""
    return TR.reply_tree(_replies(spark, sf))


@query(f"WITH {REPLIES_SQL} SELECT root, count(*) AS n, count(*) FILTER (depth = 1) AS n_top, max(depth) AS depth FROM t GROUP BY root")
def reply_threads(spark, sf):
    """Size, top level and depth of every thread."""
    return TR.threads(TR.reply_tree(_replies(spark, sf)))


@query("SELECT event_type AS key, count(*) AS n, count(DISTINCT event_id) AS n_ids, min(epoch_us(ts)) / 1e6 AS first, max(epoch_us(ts)) / 1e6 AS last FROM events GROUP BY 1")
def stream_polled(spark, sf):
    """A service polled as a stream until nothing new is there, one partition an event type."""
    PO.register(spark)
    path = f"{sf}/events.parquet"
    keys = sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect())
    here = "brindle.sources.polling"
    stream = spark.readStream.format("polled").options(fetch=f"{here}:fetch_events", newest=f"{here}:newest_event", keys=",".join(keys), page="5000", service=path).load()
    rows = R.stream_result(spark, stream, stream.schema, "append")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("""WITH o AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR))),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS k FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM s)
SELECT CAST(user_id AS VARCHAR) AS submission, CAST(event_id AS VARCHAR) AS comment, epoch_us(ts) AS at_us, n, n = 1 AS is_first FROM n""")
def stream_new_comments(spark, sf):
    """Events as comments on users, looked at again; state ends after six hours without any."""
    out = TH.new_comments(R.events_stream(spark, sf), "user_id", "event_id", "ts", "6 hours")
    rows = R.stream_result(spark, out, out.schema, "append")
    return rows.select("submission", "comment", F.unix_micros("ts").alias("at_us"), "n", "is_first")
