"""Queries: quality rules for precipitation, on amounts made from the nations' days."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.operators import qa_prcp
from isohyet.plans.analog import DENSE, NAT, national
from isohyet.plans.registry import query
from isohyet.plans.series import WIN, dense

_RAIN = "rain AS (SELECT station_id, obs_date, greatest(tmax,0)+CAST(0 AS DOUBLE) AS prcp, (tmin+tmax)/2 AS tavg FROM nat)"
_TENS = "rain AS (SELECT station_id, obs_date, floor(greatest(tmax,0)/10)*10 AS prcp FROM nat)"
_WIN29 = WIN.replace("generate_series(-7,7)", "generate_series(-14,14)")
_PERCENTILES = "w AS (SELECT station_id, leap, yday, prcp FROM rain JOIN win ON win.md=month(obs_date)*100+day(obs_date) WHERE prcp>0), q AS (SELECT station_id, leap, yday, quantile_cont(prcp,0.3) AS p30, quantile_cont(prcp,0.5) AS p50, quantile_cont(prcp,0.7) AS p70, quantile_cont(prcp,0.9) AS p90, quantile_cont(prcp,0.95) AS p95 FROM w GROUP BY 1,2,3 HAVING count(*)>=20)"
_DAY = "q.station_id=r.station_id AND q.leap=(dayofyear(make_date(year(r.obs_date),12,31))=366) AND q.yday=dayofyear(r.obs_date)"
_PAIRS = "pr AS (SELECT a.station_id, b.station_id AS ngh_id, CAST(abs(a.station_id-b.station_id) AS DOUBLE) AS dist_km FROM (SELECT DISTINCT station_id FROM nat) a JOIN (SELECT DISTINCT station_id FROM nat) b ON a.station_id<>b.station_id)"


def _flagged(hit: str, letter: str, source: str = "rain") -> str:
    """The rows of source with what a rule leaves of them, given its hits as a table."""
    return f"SELECT r.station_id, r.obs_date, CASE WHEN h.station_id IS NULL THEN r.prcp END AS prcp, CASE WHEN h.station_id IS NULL THEN '' ELSE '{letter}' END AS qflag FROM {source} r LEFT JOIN {hit} h ON h.station_id=r.station_id AND h.obs_date=r.obs_date"


def _out(df):
    return df.select("station_id", "obs_date", "prcp", "qflag")


def _rain(spark, d):
    n = national(spark, d)
    return qa_prcp.prepare(n.select("station_id", "obs_date", F.greatest(F.col("tmax"), F.lit(0.0)).alias("prcp"), ((F.col("tmin") + F.col("tmax")) / 2).alias("tavg")))


def _tens(spark, d):
    """Amounts in tens: equal ones are frequent."""
    n = national(spark, d)
    return qa_prcp.prepare(n.select("station_id", "obs_date", (F.floor(F.greatest(F.col("tmax"), F.lit(0.0)) / 10) * 10).cast("double").alias("prcp")))


def _pairs(spark, d):
    """All pairs of the nations with observations: a list of them all beside each."""
    ids = national(spark, d).select("station_id").distinct()
    every = ids.agg(F.collect_set("station_id").alias("all"))  # one row, of as many as there are nations
    pairs = ids.crossJoin(F.broadcast(every)).select("station_id", F.explode("all").alias("ngh_id")).where("station_id <> ngh_id")
    return pairs.withColumn("dist_km", F.abs(F.col("station_id") - F.col("ngh_id")).cast("double"))


@query("prcp_impossible", f"WITH {NAT} SELECT station_id, obs_date, CASE WHEN tmax BETWEEN 0 AND 20 THEN tmax END AS prcp, CASE WHEN tmax BETWEEN 0 AND 20 THEN '' ELSE 'X' END AS qflag FROM nat")
def prcp_impossible(spark, d):
    return _out(qa_prcp.impossible(qa_prcp.prepare(national(spark, d).select("station_id", "obs_date", F.col("tmax").alias("prcp"))), 20.0))


def _same(n: int, period: str, pair: str) -> str:
    """Stage n of the rules for repeated periods: rows r{n} from rows r{n-1}."""
    keys = period.split(",")
    on = " AND ".join(f"s.{k}=r.{k}" for k in keys)
    least = "least(len(a.v),len(b.v))"
    return (
        f"s{n} AS (SELECT station_id, {period}, list(prcp ORDER BY obs_date) AS v FROM r{n - 1} GROUP BY station_id, {period} HAVING count_if(prcp>0)>=3), "
        f"p{n} AS (SELECT a.station_id, {', '.join(f'a.{k} AS {k}1, b.{k} AS {k}2' for k in keys)} FROM s{n} a JOIN s{n} b ON a.station_id=b.station_id AND {pair} AND list_count(a.v[1:{least}])={least} AND a.v[1:{least}]=b.v[1:{least}]), "
        f"h{n} AS (SELECT station_id, {', '.join(f'{k}1 AS {k}' for k in keys)} FROM p{n} UNION SELECT station_id, {', '.join(f'{k}2' for k in keys)} FROM p{n}), "
        f"r{n} AS (SELECT r.station_id, r.obs_date, r.y, r.m, CASE WHEN s.station_id IS NULL THEN r.prcp END AS prcp, r.hit OR s.station_id IS NOT NULL AS hit FROM r{n - 1} r LEFT JOIN h{n} s ON s.station_id=r.station_id AND {on})"
    )


_DUPLICATES = (
    f"WITH {NAT}, {DENSE}, r0 AS (SELECT station_id, obs_date, year(obs_date) AS y, month(obs_date) AS m, CASE WHEN station_id%2=0 THEN CAST(day(obs_date)%3 AS DOUBLE) WHEN tmax IS NOT NULL THEN greatest(tmax,0)+CAST(0 AS DOUBLE) END AS prcp, false AS hit FROM dense), "
    + ", ".join([_same(1, "y", "a.y<b.y"), _same(2, "y,m", "a.y=b.y AND a.m<b.m"), _same(3, "y,m", "a.y<b.y AND a.m=b.m")])
    + " SELECT station_id, obs_date, prcp, CASE WHEN hit THEN 'D' ELSE '' END AS qflag FROM r3"
)


@query("prcp_duplicates", _DUPLICATES)
def prcp_duplicates(spark, d):
    """Every other station repeats itself."""
    again = F.when(F.col("station_id") % 2 == 0, (F.day("obs_date") % 3).cast("double")).when(F.col("tmax").isNotNull(), F.greatest(F.col("tmax"), F.lit(0.0)))
    return _out(qa_prcp.duplicates(qa_prcp.prepare(dense(spark, d).select("station_id", "obs_date", again.alias("prcp")))))


@query("prcp_clim_outlier", f"WITH {NAT}, {_RAIN}, {_WIN29}, {_PERCENTILES}, hit AS (SELECT r.station_id, r.obs_date FROM rain r JOIN q ON {_DAY} WHERE prcp >= p95*CASE WHEN tavg<0 THEN CAST(0.83 AS DOUBLE) ELSE CAST(1.137 AS DOUBLE) END) {_flagged('hit', 'O')}")
def prcp_clim_outlier(spark, d):
    return _out(qa_prcp.climate_outlier(_rain(spark, d), 1.137, 0.83))


@query("prcp_streak", f"WITH {NAT}, {_TENS}, x AS (SELECT *, CASE WHEN prcp = lag(prcp) OVER (PARTITION BY station_id ORDER BY obs_date) THEN 0 ELSE 1 END AS first FROM rain WHERE prcp>0), g AS (SELECT *, sum(first) OVER (PARTITION BY station_id ORDER BY obs_date) AS run FROM x), k AS (SELECT *, count(*) OVER (PARTITION BY station_id, run) AS n, max(run) OVER (PARTITION BY station_id) AS ending FROM g), hit AS (SELECT station_id, obs_date FROM k WHERE n>=4 AND run<ending) {_flagged('hit', 'K')}")
def prcp_streak(spark, d):
    return _out(qa_prcp.streak(_tens(spark, d), 4))


@query("prcp_frequent", f"WITH {NAT}, {_TENS}, {_WIN29}, {_PERCENTILES}, j AS (SELECT r.station_id, r.obs_date, prcp, p30, p50, p70, p90, row_number() OVER (PARTITION BY r.station_id ORDER BY r.obs_date) AS i FROM rain r LEFT JOIN q ON {_DAY} WHERE prcp>0), s AS (SELECT *, unnest(generate_series(greatest(1,i-9), i)) AS w0 FROM j), k AS (SELECT station_id, w0, prcp FROM s GROUP BY 1,2,3 HAVING count_if(prcp>=p30)>=9 OR count_if(prcp>=p50)>=8 OR count_if(prcp>=p70)>=7 OR count_if(prcp>=p90)>=5), hit AS (SELECT DISTINCT s.station_id, s.obs_date FROM s JOIN k ON k.station_id=s.station_id AND k.w0=s.w0 AND k.prcp=s.prcp) {_flagged('hit', 'K')}")
def prcp_frequent(spark, d):
    return _out(qa_prcp.frequent(_tens(spark, d)))


@query("prcp_yearly_outliers", f"WITH {NAT}, {_RAIN}, {_PAIRS}, a AS (SELECT station_id, year(obs_date) AS year, sum(prcp) AS total FROM rain GROUP BY 1,2 HAVING count(prcp)>=60), b AS (SELECT pr.station_id, ngh_id, a.year, a.total, n.total AS nt, avg(a.total) OVER (PARTITION BY pr.station_id, ngh_id) AS m FROM pr JOIN a ON a.station_id=pr.station_id JOIN a n ON n.station_id=ngh_id AND n.year=a.year), c AS (SELECT station_id, ngh_id, regr_slope(total,nt) AS sl, regr_intercept(total,nt) AS ic, 1-sum(abs(nt-total))/nullif(sum(abs(nt-m)+abs(total-m)),0) AS d1 FROM b GROUP BY 1,2), e AS (SELECT station_id, year, total, sum((ic+sl*nt)*d1)/nullif(sum(d1),0) AS est FROM b JOIN c USING (station_id, ngh_id) GROUP BY 1,2,3) SELECT station_id, CAST(year AS INT) AS year, total, round(est,4) AS est FROM e WHERE abs((total-est)/nullif(est,0))*100 >= 12.5")
def prcp_yearly_outliers(spark, d):
    return qa_prcp.yearly_outliers(_rain(spark, d), _pairs(spark, d), 60, 12.5).select("station_id", "year", "total", F.round("est", 4).alias("est"))


@query("prcp_spatial_corrob", f"""WITH {NAT}, {_PAIRS}, rain AS (SELECT station_id, obs_date, greatest(tmax,0)*CAST(4 AS DOUBLE) AS prcp FROM nat),
r AS (SELECT station_id, obs_date, prcp, CASE WHEN prcp>0 THEN CAST(100 AS DOUBLE)*(rank() OVER (PARTITION BY station_id ORDER BY prcp) + count(*) OVER (PARTITION BY station_id ORDER BY prcp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)/(2*count(*) OVER (PARTITION BY station_id)) END AS pct FROM rain),
nb AS (SELECT * FROM (SELECT pr.station_id, r.obs_date AS d, r.prcp AS np, r.pct AS npct, row_number() OVER (PARTITION BY pr.station_id, r.obs_date ORDER BY dist_km, ngh_id) AS k FROM pr JOIN r ON r.station_id=ngh_id) WHERE k<=7),
ok AS (SELECT station_id, d FROM nb GROUP BY 1,2 HAVING count(*)>=3),
x AS (SELECT r.station_id, r.obs_date, r.prcp, count(DISTINCT nb.d) AS days, min(abs(np-r.prcp)) AS gap, min(abs(npct-pct)) AS dp FROM r JOIN nb ON nb.station_id=r.station_id AND nb.d BETWEEN r.obs_date-1 AND r.obs_date+1 JOIN ok ON ok.station_id=nb.station_id AND ok.d=nb.d GROUP BY 1,2,3),
hit AS (SELECT station_id, obs_date FROM x WHERE days=3 AND prcp>0 AND gap >= CASE WHEN dp>0 THEN (CAST(-45.72 AS DOUBLE)*ln(dp)+CAST(269.24 AS DOUBLE))/10 ELSE CAST(26.924 AS DOUBLE) END) {_flagged('hit', 'S')}""")
def prcp_spatial_corrob(spark, d):
    wet = national(spark, d).select("station_id", "obs_date", (F.greatest(F.col("tmax"), F.lit(0.0)) * 4).alias("prcp"))
    return _out(qa_prcp.spatial_corroboration(qa_prcp.prepare(wet), _pairs(spark, d)))
