"""Queries: calendars, means, counts, scalars, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.functions import scalars, stats
from isohyet.operators import aggregate, qa_prcp, qa_temp
from isohyet.operators.calendar import densify, window_table
from isohyet.plans.analog import DENSE, NAT, OBS, national, observations, read
from isohyet.plans.registry import query
from isohyet.tables import table


def dense(spark, d):
    return densify(national(spark, d))


@query("monthly_means", f"WITH {OBS}, m AS (SELECT station_id, CAST(year(obs_date) AS INT) AS year, CAST(month(obs_date) AS INT) AS month, avg(value) AS mean, count(value) AS n, max(day(last_day(obs_date))) AS days FROM obs GROUP BY 1,2,3) SELECT station_id, year, month, CASE WHEN days-n <= 25 THEN round(mean,6) END AS mean, CAST(days-n AS INT) AS n_miss FROM m")
def monthly_means(spark, d):
    return aggregate.monthly_means(observations(spark, d), max_miss=25).withColumn("mean", F.round("mean", 6))


_MONTHLY = "m AS (SELECT station_id, CAST(year(obs_date) AS INT) AS year, CAST(month(obs_date) AS INT) AS month, avg(value) AS mean FROM obs GROUP BY 1,2,3)"


@query("monthly_normals", f"WITH {OBS}, {_MONTHLY} SELECT station_id, month, round(avg(mean),6) AS norm, count(mean) AS n_years FROM m WHERE year BETWEEN 1996 AND 2000 GROUP BY 1,2")
def monthly_normals(spark, d):
    return aggregate.monthly_normals(observations(spark, d), 1996, 2000, max_miss=None).withColumn("norm", F.round("norm", 6))


@query("annual_means", f"WITH {OBS}, {_MONTHLY} SELECT station_id, year, CASE WHEN 12-count(mean) <= 6 THEN round(avg(mean),6) END AS mean, count(mean) AS n_months FROM m GROUP BY 1,2")
def annual_means(spark, d):
    return aggregate.annual_means(aggregate.monthly_means(observations(spark, d), None), 6).withColumn("mean", F.round("mean", 6))


@query("eight_day_means", f"WITH {OBS} SELECT station_id, CAST(year(obs_date) AS INT) AS year, CAST((dayofyear(obs_date)-1)//8 AS INT) AS bin, round(avg(value),6) AS mean FROM obs GROUP BY 1,2,3")
def eight_day(spark, d):
    return aggregate.eight_day_means(observations(spark, d)).withColumn("mean", F.round("mean", 6))


@query("obs_daily_densify", f"WITH {NAT}, {DENSE} SELECT station_id, obs_date, tmin, tmax FROM dense")
def obs_daily_densify(spark, d):
    return dense(spark, d)


_COUNTS = "cnt AS (SELECT s.station_id, CAST(m.m AS INT) AS month, count(o.value) AS cnt FROM (SELECT DISTINCT station_id FROM obs) s CROSS JOIN (SELECT unnest(generate_series(1,12)) AS m) m LEFT JOIN obs o ON o.station_id=s.station_id AND month(o.obs_date)=m.m AND o.obs_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1,2)"


@query("obs_counts", f"WITH {OBS}, {_COUNTS} SELECT station_id, month, cnt FROM cnt")
def obs_counts(spark, d):
    return aggregate.observation_counts(observations(spark, d), "1996-01-01", "1999-12-31")


@query("obs_counts_por", f"WITH {OBS}, {_COUNTS}, dm AS (SELECT unnest([31,28,31,30,31,30,31,31,30,31,30,31]) AS dd, unnest([1,2,3,4,5,6,7,8,9,10,11,12]) AS mm) SELECT station_id, count_if(cnt >= dd*CAST(0.5 AS DOUBLE))=12 AS ok FROM cnt JOIN dm ON mm=month GROUP BY 1")
def obs_counts_por(spark, d):
    return aggregate.period_of_record(aggregate.observation_counts(observations(spark, d), "1996-01-01", "1999-12-31"), 0.5)


@query("annual_sums", f"WITH {OBS} SELECT station_id, CAST(year(obs_date) AS INT) AS year, sum(value) AS total FROM obs GROUP BY 1,2 HAVING count(value) >= 60")
def annual_sums(spark, d):
    return aggregate.annual_sums(observations(spark, d), 60)


@query("period_bounds", f"WITH {OBS} SELECT station_id, min(obs_date) AS first, max(obs_date) AS last FROM obs GROUP BY 1")
def period_bounds(spark, d):
    return aggregate.period_bounds(observations(spark, d))


@query("flag_summary", f"WITH {OBS} SELECT station_id, round(100.0*count_if(value > 15)/count(value),6) AS pct_flagged FROM obs GROUP BY 1")
def flag_summary(spark, d):
    o = observations(spark, d).withColumn("qflag", F.when(F.col("value") > 15, "X").otherwise(""))
    return aggregate.flag_summary(o).withColumn("pct_flagged", F.round("pct_flagged", 6))


@query("biweight_stats", f"""WITH {OBS}, m AS (SELECT station_id, median(value) AS m FROM obs GROUP BY 1), a AS (SELECT o.station_id, median(abs(value-m)) AS mad FROM obs o JOIN m USING (station_id) GROUP BY 1),
 u AS (SELECT o.station_id, value AS x, m, mad, CASE WHEN mad=0 THEN NULL ELSE least(1.0, abs((value-m)/(7.5*mad))) END AS u FROM obs o JOIN m USING (station_id) JOIN a USING (station_id))
 SELECT station_id, count(*) AS n, round(CASE WHEN min(mad)=0 THEN avg(x) ELSE min(m)+sum((x-m)*(1-u*u)*(1-u*u))/sum((1-u*u)*(1-u*u)) END,6) AS bi_mean,
 round(CASE WHEN min(mad)=0 THEN stddev_samp(x) ELSE sqrt(count(*)*sum((x-m)*(x-m)*power(1-u*u,4)))/abs(sum((1-u*u)*(1-5*u*u))) END,6) AS bi_std FROM u GROUP BY 1""")
def biweight_stats(spark, d):
    return stats.biweight(observations(spark, d), ["station_id"]).withColumns({c: F.round(c, 6) for c in ("bi_mean", "bi_std")})


@query("seasonal_percentiles", f"WITH {OBS}, w AS (SELECT station_id, month(obs_date) AS month, value FROM obs WHERE value > 0) SELECT station_id, CAST(month AS INT) AS month, round(quantile_cont(value,0.3),6) AS p30, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.7),6) AS p70, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95 FROM w GROUP BY 1,2 HAVING count(*) >= 20")
def seasonal_percentiles(spark, d):
    o = observations(spark, d).withColumn("month", F.month("obs_date"))
    return qa_prcp.wet_percentiles(o, ["station_id", "month"]).select("station_id", "month", *[F.round(p, 6).alias(p) for p in ("p30", "p50", "p70", "p90", "p95")])


@query("scalar_functions", """SELECT s_suppkey AS station_id, CAST(sign(x)*floor(abs(x)) AS INT) AS deg, CAST(floor((abs(x)-floor(abs(x)))*60) AS INT) AS mins, CASE WHEN x*2>180 THEN x*2-360 ELSE x*2 END AS wrapped,
 round((s_acctbal-32)*CAST(0.3048 AS DOUBLE),6) AS metres, CAST(round_even(round_even(s_acctbal/40,2)*100,0) AS SMALLINT) AS packed FROM (SELECT *, CAST((s_suppkey*37)%1000 AS DOUBLE)/8 AS x FROM supplier)""")
def scalar_functions(spark, d):
    s = read(spark, d, "supplier").withColumn("x", (F.col("s_suppkey") * 37 % 1000).cast("double") / 8)
    dms = scalars.decimal_to_dms(F.col("x"))
    return s.select(F.col("s_suppkey").alias("station_id"), dms["degrees"].alias("deg"), dms["minutes"].alias("mins"), scalars.wrap_lon(F.col("x") * 2).alias("wrapped"), F.round(scalars.feet_to_m(F.col("s_acctbal") - 32), 6).alias("metres"), scalars.pack(F.col("s_acctbal") / 40).alias("packed"))


@query("date_keys", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS obs_date, CAST(strftime(o_orderdate,'%Y%m%d') AS INT) AS ymd, CAST(month(o_orderdate)*100+day(o_orderdate) AS INT) AS md, last_day(CAST(o_orderdate AS DATE)) AS month_end, dayofyear(make_date(year(o_orderdate),12,31))=366 AS leap FROM orders")
def date_keys(spark, d):
    c = F.col("obs_date")
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("obs_date")).distinct()
    return o.select("obs_date", scalars.ymd(c).alias("ymd"), scalars.md(c).alias("md"), scalars.month_bounds(F.year(c), F.month(c))["last"].alias("month_end"), scalars.is_leap(F.year(c)).alias("leap"))


@query("station_codes", "SELECT s_suppkey AS station_id, CASE s_suppkey%3 WHEN 0 THEN 'SNT'||lpad(CAST(s_suppkey AS VARCHAR),8,'0') WHEN 1 THEN 'WRC'||lpad(CAST(s_suppkey AS VARCHAR),8,'0') ELSE 'US'||lpad(CAST(s_suppkey AS VARCHAR),9,'0') END AS code FROM supplier")
def station_codes(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("NRCS_"), k)).when(k % 3 == 1, F.concat(F.lit("RAWS_"), k)).otherwise(F.concat(F.lit("GHCND_US"), F.lpad(k.cast("string"), 9, "0")))
    return read(spark, d, "supplier").select(k.alias("station_id"), scalars.station_code(name).alias("code"))


def _flags(df):
    return df.where("flag_tmin <> '' or flag_tmax <> ''").select("station_id", "obs_date", "flag_tmin", "flag_tmax")


def _flag_sql(masks: str, flag: str, m0: str = "m0", m1: str = "m1") -> str:
    return f"WITH {NAT}, {DENSE}, {masks} SELECT station_id, obs_date, CASE WHEN coalesce({m0},false) THEN '{flag}' ELSE '' END AS flag_tmin, CASE WHEN coalesce({m1},false) THEN '{flag}' ELSE '' END AS flag_tmax FROM k WHERE coalesce({m0},false) OR coalesce({m1},false)"


@query("qa_naught", _flag_sql("k AS (SELECT *, tmin=0 AND tmax=0 AS m0, tmin=0 AND tmax=0 AS m1 FROM dense)", "N"))
def qa_naught(spark, d):
    return _flags(qa_temp.naught(qa_temp.prepare(dense(spark, d))))


@query("qa_impossible", _flag_sql("k AS (SELECT *, tmin < -20 OR tmin > 20 AS m0, tmax < -20 OR tmax > 20 AS m1 FROM dense)", "X"))
def qa_impossible(spark, d):
    return _flags(qa_temp.impossible(qa_temp.prepare(dense(spark, d)), -20, 20))


@query("qa_dup_within_month", _flag_sql("k AS (SELECT *, count_if(tmin=tmax) OVER w >= 10 AS m0, count_if(tmin=tmax) OVER w >= 10 AS m1 FROM dense WINDOW w AS (PARTITION BY station_id, year(obs_date), month(obs_date)))", "D"))
def qa_dup_within_month(spark, d):
    return _flags(qa_temp.dup_within_month(qa_temp.prepare(dense(spark, d))))


# for duplicates of periods: a series that repeats by construction (value from month and day)
_REP = "rep AS (SELECT station_id, obs_date, CAST((day(obs_date)*7 + (month(obs_date)%4)*(station_id%3)) %11 AS DOUBLE) AS tmin, CAST(day(obs_date)+month(obs_date)*(station_id%2)+year(obs_date)*(station_id%5) AS DOUBLE) AS tmax FROM dense)"


def _repeating(spark, d):
    day, month, year, s = F.day("obs_date"), F.month("obs_date"), F.year("obs_date"), F.col("station_id")
    return qa_temp.prepare(dense(spark, d).select("station_id", "obs_date", ((day * 7 + (month % 4) * (s % 3)) % 11).cast("double").alias("tmin"), (day + month * (s % 2) + year * (s % 5)).cast("double").alias("tmax")))


def _dup_sql(period: str, on: str) -> str:
    part = ", ".join(period.split(","))
    pairs = lambda e: f"{e}p AS (SELECT a.station_id, {', '.join(f'a.{p} AS {p}_a, b.{p} AS {p}_b' for p in period.split(','))} FROM {e}s a JOIN {e}s b ON a.station_id=b.station_id AND {on} AND a.v[1:least(len(a.v),len(b.v))]=b.v[1:least(len(a.v),len(b.v))]), {e}h AS (SELECT station_id, {', '.join(f'{p}_a AS {p}' for p in period.split(','))} FROM {e}p UNION SELECT station_id, {', '.join(f'{p}_b' for p in period.split(','))} FROM {e}p)"
    lists = lambda e: f"{e}s AS (SELECT station_id, {part}, list({e} ORDER BY obs_date) AS v FROM r GROUP BY ALL)"
    has = lambda e: f"EXISTS (SELECT 1 FROM {e}h h WHERE h.station_id=r.station_id AND {' AND '.join(f'h.{p}=r.{p}' for p in period.split(','))})"
    return f"WITH {NAT}, {DENSE}, {_REP}, r AS (SELECT *, year(obs_date) AS y, month(obs_date) AS m FROM rep), {lists('tmin')}, {lists('tmax')}, {pairs('tmin')}, {pairs('tmax')}, k AS (SELECT *, {has('tmin')} AS m0, {has('tmax')} AS m1 FROM r) SELECT station_id, obs_date, CASE WHEN m0 THEN 'D' ELSE '' END AS flag_tmin, CASE WHEN m1 THEN 'D' ELSE '' END AS flag_tmax FROM k WHERE m0 OR m1"


@query("qa_dup_year", _dup_sql("y", "a.y < b.y"))
def qa_dup_year(spark, d):
    return _flags(qa_temp.dup_year(_repeating(spark, d)))


@query("qa_dup_year_month", _dup_sql("y,m", "a.y = b.y AND a.m < b.m AND a.m <> 11"))
def qa_dup_year_month(spark, d):
    return _flags(qa_temp.dup_year_month(_repeating(spark, d)))


@query("qa_dup_month", _dup_sql("y,m", "a.y < b.y AND a.m = b.m"))
def qa_dup_month(spark, d):
    return _flags(qa_temp.dup_month(_repeating(spark, d)))


def _streak_sql(e: str) -> str:
    return f"{e}n AS (SELECT station_id, obs_date, {e} AS v, CASE WHEN {e} = lag({e}) OVER w THEN 0 ELSE 1 END AS new FROM dense WHERE {e} IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY obs_date)), {e}r AS (SELECT *, sum(new) OVER (PARTITION BY station_id ORDER BY obs_date) AS run FROM {e}n), {e}k AS (SELECT station_id, obs_date, count(*) OVER (PARTITION BY station_id, run) >= 3 AND run < max(run) OVER (PARTITION BY station_id) AS hit FROM {e}r)"


@query("qa_streak", _flag_sql(f"{_streak_sql('tmin')}, {_streak_sql('tmax')}, k AS (SELECT dense.*, a.hit AS m0, b.hit AS m1 FROM dense LEFT JOIN tmink a USING (station_id, obs_date) LEFT JOIN tmaxk b USING (station_id, obs_date))", "K"))
def qa_streak(spark, d):
    return _flags(qa_temp.streak(qa_temp.prepare(dense(spark, d)), 3))


def _gap_sql(e: str) -> str:
    return (
        f"{e}m AS (SELECT station_id, month(obs_date) AS m, {e} AS v, median({e}) OVER (PARTITION BY station_id, month(obs_date)) AS med FROM dense WHERE {e} IS NOT NULL), "
        f"{e}t AS (SELECT station_id, m, min(v) AS top FROM (SELECT station_id, m, v, v - lag(v) OVER (PARTITION BY station_id, m ORDER BY v) AS j FROM {e}m WHERE v >= med) WHERE j >= 2 GROUP BY 1,2), "
        f"{e}b AS (SELECT station_id, m, max(v) AS bot FROM (SELECT station_id, m, v, lag(v) OVER (PARTITION BY station_id, m ORDER BY v DESC) - v AS j FROM {e}m WHERE v <= med) WHERE j >= 2 GROUP BY 1,2)"
    )


@query("qa_gap", _flag_sql(f"{_gap_sql('tmin')}, {_gap_sql('tmax')}, k AS (SELECT d.station_id, d.obs_date, coalesce(d.tmin >= nt.top,false) OR coalesce(d.tmin <= nb.bot,false) AS m0, coalesce(d.tmax >= xt.top,false) OR coalesce(d.tmax <= xb.bot,false) AS m1 FROM dense d LEFT JOIN tmint nt ON nt.station_id=d.station_id AND nt.m=month(d.obs_date) LEFT JOIN tminb nb ON nb.station_id=d.station_id AND nb.m=month(d.obs_date) LEFT JOIN tmaxt xt ON xt.station_id=d.station_id AND xt.m=month(d.obs_date) LEFT JOIN tmaxb xb ON xb.station_id=d.station_id AND xb.m=month(d.obs_date))", "G"))
def qa_gap(spark, d):
    return _flags(qa_temp.gap(qa_temp.prepare(dense(spark, d)), 2.0))


@query("qa_internal", _flag_sql("k AS (SELECT station_id, obs_date, tmax-3 < tmin AS m0, tmax-3 < tmin AS m1 FROM dense)", "I"))
def qa_internal(spark, d):
    return _flags(qa_temp.internal_inconsistency(qa_temp.prepare(dense(spark, d)).withColumn("tmax", F.col("tmax") - 3)))


@query("qa_spike", _flag_sql("k AS (SELECT station_id, obs_date, abs(tmin-lag(tmin) OVER w)>=25 AND abs(tmin-lead(tmin) OVER w)>=25 AS m0, abs(tmax-lag(tmax) OVER w)>=25 AND abs(tmax-lead(tmax) OVER w)>=25 AS m1 FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY obs_date))", "T"))
def qa_spike(spark, d):
    return _flags(qa_temp.spike_dip(qa_temp.prepare(dense(spark, d))))


@query("qa_lagrange", _flag_sql("h AS (SELECT *, coalesce(tmax >= max(tmin) OVER w + 40,false) AS hi, coalesce(tmin <= min(tmax) OVER w - 40,false) AS lo FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY obs_date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), k AS (SELECT station_id, obs_date, tmin IS NOT NULL AND (lo OR max(hi) OVER w) AS m0, tmax IS NOT NULL AND (hi OR max(lo) OVER w) AS m1 FROM h WINDOW w AS (PARTITION BY station_id ORDER BY obs_date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))", "R"))
def qa_lagrange(spark, d):
    return _flags(qa_temp.lagged_range(qa_temp.prepare(dense(spark, d))))


@query("qa_mega", _flag_sql("k AS (SELECT station_id, obs_date, tmin > max(tmax-30) OVER w AS m0, tmax-30 < min(tmin) OVER w AS m1 FROM dense WINDOW w AS (PARTITION BY station_id, month(obs_date)))", "M"))
def qa_mega(spark, d):
    return _flags(qa_temp.mega_inconsistency(qa_temp.prepare(dense(spark, d)).withColumn("tmax", F.col("tmax") - 30)))


def norm_sql(e: str, least: int = 40, source: str = "dense") -> str:
    return (
        f"{e}v AS (SELECT station_id, leap, yday, {e} AS x FROM {source} JOIN win ON win.md=month(obs_date)*100+day(obs_date) WHERE {e} IS NOT NULL), "
        f"{e}c AS (SELECT station_id, leap, yday, count(*) AS n, median(x) AS m FROM {e}v GROUP BY 1,2,3 HAVING count(*) >= {least}), "
        f"{e}a AS (SELECT v.station_id, v.leap, v.yday, median(abs(x-m)) AS mad FROM {e}v v JOIN {e}c USING (station_id, leap, yday) GROUP BY 1,2,3), "
        f"{e}u AS (SELECT v.*, m, mad, n, CASE WHEN mad=0 THEN NULL ELSE least(1.0,abs((x-m)/(7.5*mad))) END AS u FROM {e}v v JOIN {e}c USING (station_id, leap, yday) JOIN {e}a USING (station_id, leap, yday)), "
        f"{e}n AS (SELECT station_id, leap, yday, CASE WHEN min(mad)=0 THEN avg(x) ELSE min(m)+sum((x-m)*power(1-u*u,2))/sum(power(1-u*u,2)) END AS mean, CASE WHEN min(mad)=0 THEN stddev_samp(x) ELSE sqrt(count(*)*sum(power(x-m,2)*power(1-u*u,4)))/abs(sum((1-u*u)*(1-5*u*u))) END AS sd FROM {e}u GROUP BY 1,2,3)"
    )


WIN = "win AS (SELECT leap, CAST(dayofyear(base) AS INT) AS yday, month(o)*100+day(o) AS md FROM (SELECT leap, base, CASE WHEN base + CAST(k AS INT) < y0 THEN base + CAST(k AS INT) + n WHEN base + CAST(k AS INT) > y1 THEN base + CAST(k AS INT) - n ELSE base + CAST(k AS INT) END AS o FROM (SELECT leap, CAST(unnest(generate_series(CAST(y0 AS TIMESTAMP), CAST(y1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS base, y0, y1, n FROM (VALUES (false, DATE '2003-01-01', DATE '2003-12-31', 365), (true, DATE '2004-01-01', DATE '2004-12-31', 366)) t(leap,y0,y1,n)) CROSS JOIN (SELECT unnest(generate_series(-7,7)) AS k)))"


@query("qa_clim_outlier", _flag_sql(f"{WIN}, {norm_sql('tmin')}, {norm_sql('tmax')}, k AS (SELECT d.station_id, d.obs_date, abs((d.tmin-a.mean)/nullif(a.sd,0)) >= 1.7 AS m0, abs((d.tmax-b.mean)/nullif(b.sd,0)) >= 1.7 AS m1 FROM dense d LEFT JOIN tminn a ON a.station_id=d.station_id AND a.leap=(dayofyear(make_date(year(d.obs_date),12,31))=366) AND a.yday=dayofyear(d.obs_date) LEFT JOIN tmaxn b ON b.station_id=d.station_id AND b.leap=(dayofyear(make_date(year(d.obs_date),12,31))=366) AND b.yday=dayofyear(d.obs_date))", "O"))
def qa_clim_outlier(spark, d):
    return _flags(qa_temp.climate_outlier(qa_temp.prepare(dense(spark, d)), 1.7, 7, 40))


@query("month_day_windows", f"WITH {NAT}, {WIN} SELECT leap, yday, count(*) AS n, round(avg(tmin),6) AS mean FROM nat JOIN win ON md=month(obs_date)*100+day(obs_date) GROUP BY 1,2")
def month_day_windows(spark, d):
    """Of each day of a year the observations of all years in the fifteen days around."""
    x = national(spark, d).select((F.month("obs_date") * 100 + F.day("obs_date")).alias("md"), "tmin")
    return x.join(F.broadcast(window_table(spark)), "md").groupBy("leap", "yday").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tmin"), 6).alias("mean"))  # 11,000 rows


_CHAIN = """c0 AS (SELECT station_id, obs_date, tmin, tmax, tmin=0 AND tmax=0 AS n FROM dense),
c1 AS (SELECT station_id, obs_date, CASE WHEN NOT coalesce(n,false) THEN tmin END AS tmin, CASE WHEN NOT coalesce(n,false) THEN tmax END AS tmax, CASE WHEN coalesce(n,false) THEN 'N' ELSE '' END AS f0, CASE WHEN coalesce(n,false) THEN 'N' ELSE '' END AS f1 FROM c0),
c2 AS (SELECT station_id, obs_date, CASE WHEN tmin BETWEEN -20 AND 20 THEN tmin END AS tmin, CASE WHEN tmax BETWEEN -20 AND 20 THEN tmax END AS tmax, CASE WHEN f0='' AND (tmin < -20 OR tmin > 20) THEN 'X' ELSE f0 END AS f0, CASE WHEN f1='' AND (tmax < -20 OR tmax > 20) THEN 'X' ELSE f1 END AS f1 FROM c1),
c3 AS (SELECT *, coalesce(abs(tmin-lag(tmin) OVER w)>=25 AND abs(tmin-lead(tmin) OVER w)>=25,false) AS a, coalesce(abs(tmax-lag(tmax) OVER w)>=25 AND abs(tmax-lead(tmax) OVER w)>=25,false) AS b FROM c2 WINDOW w AS (PARTITION BY station_id ORDER BY obs_date))
SELECT station_id, obs_date, CASE WHEN a AND f0='' THEN 'T' ELSE f0 END AS flag_tmin, CASE WHEN b AND f1='' THEN 'T' ELSE f1 END AS flag_tmax FROM c3 WHERE f0<>'' OR f1<>'' OR a OR b"""


@query("qa_chain_flags", f"WITH {NAT}, {DENSE}, {_CHAIN}")
def qa_chain_flags(spark, d):
    return _flags(qa_temp.run_non_spatial(dense(spark, d), (qa_temp.naught, lambda x: qa_temp.impossible(x, -20, 20), qa_temp.spike_dip)))


@query("qa_non_spatial_all")
def qa_non_spatial_all(spark, d):
    """The whole chain with the production thresholds, each rule's result written, so that
    no plan is longer than a rule."""
    return _flags(qa_temp.run_non_spatial(dense(spark, d), cut=lambda x: table(x, "rule")))


@query("qa_flag_merge", f"WITH {NAT}, {DENSE}, p AS (SELECT station_id, obs_date, CASE WHEN tmin>15 THEN 'X' ELSE '' END AS p0, CASE WHEN tmax>20 THEN 'G' ELSE '' END AS p1 FROM dense), n AS (SELECT station_id, obs_date, CASE WHEN tmin>22 THEN 'S' ELSE '' END AS n0, CASE WHEN tmax<-10 THEN 'S' ELSE '' END AS n1 FROM dense) SELECT station_id, obs_date, coalesce(nullif(n0,''),p0) AS flag_tmin, coalesce(nullif(n1,''),p1) AS flag_tmax FROM p JOIN n USING (station_id, obs_date)")
def qa_flag_merge(spark, d):
    x = dense(spark, d)
    flags = lambda a, b: x.select("station_id", "obs_date", F.when(a[0], a[1]).otherwise("").alias("flag_tmin"), F.when(b[0], b[1]).otherwise("").alias("flag_tmax"))
    return qa_temp.merge_flags(flags((F.col("tmin") > 15, "X"), (F.col("tmax") > 20, "G")), flags((F.col("tmin") > 22, "S"), (F.col("tmax") < -10, "S")))


_PRCP = "rain AS (SELECT station_id, obs_date, power(greatest(tmin,0),2)+0.0 AS prcp FROM dense WHERE tmin IS NOT NULL)"


@query("prcp_gap", f"WITH {NAT}, {DENSE}, {_PRCP}, j AS (SELECT station_id, prcp, prcp - lag(prcp) OVER (PARTITION BY station_id ORDER BY prcp) AS j FROM rain WHERE prcp > 0), g AS (SELECT station_id, min(prcp) AS g FROM j WHERE j >= 46 GROUP BY 1) SELECT r.station_id, obs_date, prcp FROM rain r JOIN g USING (station_id) WHERE prcp >= g")
def prcp_gap(spark, d):
    rain = dense(spark, d).where("tmin is not null").select("station_id", "obs_date", F.pow(F.greatest(F.col("tmin"), F.lit(0.0)), 2).alias("prcp"))
    return qa_prcp.gap(qa_prcp.prepare(rain), 46.0).where("qflag = 'G'").select("station_id", "obs_date", F.col("raw").alias("prcp"))
