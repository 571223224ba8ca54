"""Queries: station records, adjustments, upper air, distances and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.functions import scalars
from isohyet.operators import homog
from isohyet.operators import stations as st
from isohyet.plans.analog import DENSE, NAT, OBS, STN, national, observations, read, stations
from isohyet.plans.network import _PT, _points
from isohyet.plans.registry import query
from isohyet.plans.series import dense
from isohyet.sources import text

_SEGMENTS = "seg AS (SELECT station_id, 19940301 AS a, 19951231 AS b, CAST(0.5 AS DOUBLE)*(station_id%3) AS adj FROM stn UNION ALL SELECT station_id, 19960201, 19970430, CAST(-0.25 AS DOUBLE)*(station_id%4) FROM stn)"


def _segments(spark, d):
    s = stations(spark, d).select("station_id")
    first = s.select("station_id", F.lit(19940301).alias("ymd_start"), F.lit(19951231).alias("ymd_end"), (F.lit(0.5) * (F.col("station_id") % 3)).alias("adj"))
    return first.unionByName(s.select("station_id", F.lit(19960201).alias("ymd_start"), F.lit(19970430).alias("ymd_end"), (F.lit(-0.25) * (F.col("station_id") % 4)).alias("adj")))


@query("segment_adjustments", f"WITH {STN}, {OBS}, {_SEGMENTS}, m AS (SELECT DISTINCT station_id, CAST(year(obs_date) AS INT) AS year, CAST(month(obs_date) AS INT) AS month, year(obs_date)*10000+month(obs_date)*100+1 AS k FROM obs) SELECT m.station_id, year, month, CASE WHEN k < 19940301 THEN min(f.adj) ELSE coalesce(min(i.adj), 0) END AS adj FROM m LEFT JOIN seg i ON i.station_id=m.station_id AND k BETWEEN i.a AND i.b LEFT JOIN seg f ON f.station_id=m.station_id AND f.a=19940301 GROUP BY 1,2,3,k")
def segment_adjustments(spark, d):
    o = observations(spark, d).select("station_id", F.year("obs_date").alias("year"), F.month("obs_date").alias("month"))
    return homog.segment_adjustment(o, _segments(spark, d))


@query("adjustment_report", f"WITH {STN}, {_SEGMENTS} SELECT s.station_id, 'tmin' AS elem, strftime(CAST(strptime(CAST(b AS VARCHAR), '%Y%m%d') AS DATE) + INTERVAL 1 MONTH, '%Y%m') AS yearmonth, -adj AS adj, lon, lat FROM seg s JOIN stn ON stn.station_id=s.station_id WHERE adj<>0")
def adjustment_report(spark, d):
    return homog.adjustment_report(_segments(spark, d), stations(spark, d).select("station_id", "lon", "lat"), "tmin")


@query("tobs_station_set", "SELECT DISTINCT CASE WHEN l_linenumber <= 2 THEN l_suppkey ELSE l_suppkey+100000 END AS station_id FROM lineitem")
def tobs_station_set(spark, d):
    x = read(spark, d, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("station_id"))
    low = x.where("l_linenumber <= 2").select("station_id")
    return homog.tobs_stations(low, x.where("l_linenumber > 2").select((F.col("station_id") + 100000).alias("station_id")))


_AIR = "air AS (SELECT ts, CAST(10+user_id%55 AS DOUBLE) AS lat, CAST(220+user_id%90 AS DOUBLE) AS lon, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 500 ELSE 1000 END AS level, value FROM events), box AS (SELECT *, CASE WHEN lon>180 THEN lon-360 ELSE lon END AS x FROM air)"


def _air(spark, d):
    """Levels by event type; cells by user."""
    e = read(spark, d, "events")
    low = e.groupBy().agg(F.min("event_type").alias("low"))  # one row
    return e.join(F.broadcast(low)).select("ts", (10 + F.col("user_id") % 55).cast("double").alias("lat"), (220 + F.col("user_id") % 90).cast("double").alias("lon"), F.when(F.col("event_type") == F.col("low"), 500).otherwise(1000).alias("level"), "value")


@query("upper_air_thickness", f"WITH {_AIR} SELECT CAST(ts AS DATE) AS obs_date, lat, x AS lon, round(max(CASE WHEN level=500 THEN value END)-max(CASE WHEN level=1000 THEN value END),6) AS value FROM box WHERE x BETWEEN -135 AND -55 AND lat BETWEEN 10 AND 60 AND hour(ts)=12 GROUP BY 1,2,3")
def upper_air_thickness(spark, d):
    return text.thickness(_air(spark, d), 500, 1000, 12).withColumn("value", F.round("value", 6))


@query("upper_air_subset", f"WITH {_AIR} SELECT CAST(ts AS DATE)-1 AS obs_date, lat, x AS lon, CAST(level AS INT) AS level, round(value-CAST(273.15 AS DOUBLE),6) AS value FROM box WHERE x BETWEEN -135 AND -55 AND lat BETWEEN 10 AND 60 AND hour(ts)=0 AND level=1000")
def upper_air_subset(spark, d):
    """Hour 24 of a day is hour 0 of the next."""
    return text.reanalysis(_air(spark, d), [1000], 24, scalars.kelvin_to_c).withColumn("value", F.round("value", 6))


_KM = "2*6371.009*asin(least(1.0, sqrt(power(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin((radians(b.lon)-radians(a.lon))/2),2))))"


@query("nearest_cells", f"WITH {STN}, {_PT}, k AS (SELECT a.station_id AS point_id, b.c_custkey AS cell_id, {_KM} AS km FROM stn a, pt b), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, cell_id) AS rank FROM k WHERE km<=2000) SELECT point_id, cell_id, CAST(rank AS INT) AS rank FROM r WHERE rank<=4")
def nearest_cells(spark, d):
    """The four grid cells next to each station."""
    cells = _points(spark, d).select(F.col("point_id").alias("cell_id"), "lon", "lat")
    return text.nearest_cells(stations(spark, d).withColumn("point_id", F.col("station_id")), cells)


_DP = "sin(radians(b.lon)-radians(a.lon))"


@query("distance_angles", f"WITH {STN} SELECT a.station_id, round({_KM},5) AS km, round(degrees(atan2({_DP}*cos(radians(b.lat)), cos(radians(a.lat))*sin(radians(b.lat))-sin(radians(a.lat))*cos(radians(b.lat))*cos(radians(b.lon)-radians(a.lon)))),5) AS angle, round({_KM},2) AS km_cosines FROM stn a, (SELECT CAST(-100.5 AS DOUBLE) AS lon, CAST(40.25 AS DOUBLE) AS lat) b")
def distance_angles(spark, d):
    """From every station to one point, by both formulas."""
    at = F.col("lon"), F.col("lat"), F.lit(-100.5), F.lit(40.25)
    s = stations(spark, d).select("station_id", scalars.distance_angle(*at).alias("a"), scalars.distance_angle_cosines(*at).alias("c"))
    return s.select("station_id", F.round("a.km", 5).alias("km"), F.round("a.angle", 5).alias("angle"), F.round("c.km", 2).alias("km_cosines"))


@query("degrees_parsed", "SELECT p_partkey, round(-(CAST(p_size AS DOUBLE)+(p_partkey%60)/CAST(60 AS DOUBLE)+(p_partkey%50)/CAST(3600 AS DOUBLE)),8) AS degrees FROM part WHERE p_size > 0")
def degrees_parsed(spark, d):
    p = read(spark, d, "part").where("p_size > 0")
    written = F.concat_ws(" ", -F.col("p_size"), F.col("p_partkey") % 60, F.col("p_partkey") % 50)
    return p.select("p_partkey", F.round(scalars.parse_degrees(written), 8).alias("degrees"))


@query("aux_series", f"WITH {NAT}, {DENSE} SELECT d.station_id, d.obs_date, coalesce(d.tmin, 1.5) AS infilled, d.tmin IS NULL AS flag_infilled, d.tmin AS raw, d.tmin+CAST(0.5 AS DOUBLE) AS homog FROM dense d JOIN nation ON n_nationkey=d.station_id WHERE n_regionkey <> 3 AND year(obs_date) BETWEEN 1994 AND 1997")
def aux_series(spark, d):
    """Good stations: the nations outside one region."""
    n = national(spark, d).select("station_id", "obs_date", F.col("tmin").alias("value"))
    serial = dense(spark, d).select("station_id", "obs_date", F.coalesce("tmin", F.lit(1.5)).alias("value"), F.col("tmin").isNull().alias("flag_infilled"))
    good = read(spark, d, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").cast("long").alias("station_id"))
    return st.aux_series(n, n.withColumn("value", F.col("value") + 0.5), serial, good, 1994, 1997)


@query("updated_locations", f"WITH {STN}, c AS (SELECT c_custkey AS station_id, c_acctbal AS q FROM customer) SELECT s.station_id, CASE WHEN q>0 THEN lon+1 ELSE lon END AS longitude, CASE WHEN q>0 THEN lat-1 ELSE lat END AS latitude, CASE WHEN q>0 THEN q ELSE elev END AS elevation FROM stn s LEFT JOIN c ON c.station_id=s.station_id")
def updated_locations(spark, d):
    s = stations(spark, d).select("station_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.col("elev").alias("elevation"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("elevation_qa"))
    qa = s.join(c, "station_id").select("station_id", (F.col("longitude") + 1).alias("longitude_qa"), (F.col("latitude") - 1).alias("latitude_qa"), "elevation_qa")
    return st.update_locations(s, qa)


@query("precise_locations", f"WITH {STN}, c AS (SELECT c_custkey AS station_id, c_acctbal AS ft FROM customer WHERE c_acctbal > 0) SELECT s.station_id, lon AS longitude, coalesce(CASE WHEN ft IS NOT NULL THEN CAST(c_nationkey AS DOUBLE) END, lat) AS latitude, round(coalesce(ft*CAST(0.3048 AS DOUBLE), elev),6) AS elevation FROM stn s LEFT JOIN c ON c.station_id=s.station_id LEFT JOIN customer u ON u.c_custkey=s.station_id")
def precise_locations(spark, d):
    s = stations(spark, d).select("station_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.col("elev").alias("elevation"))
    p = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("station_id"), F.lit(None).cast("double").alias("lon"), F.col("c_nationkey").cast("double").alias("lat"), F.col("c_acctbal").alias("elev_ft"))
    return st.precise_locations(s, p).withColumn("elevation", F.round("elevation", 6))


@query("moved_stations", "SELECT s_suppkey AS station_id FROM supplier LEFT JOIN customer ON c_custkey=s_suppkey WHERE c_custkey IS NULL OR abs(s_acctbal-c_acctbal) > 1000 + CAST(0.1 AS DOUBLE)*abs(c_acctbal)")
def moved_stations(spark, d):
    """Of two accounts, as if they were coordinates; a missing one counts as moved."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("longitude_qa"), F.lit(1.0).alias("latitude_qa"))
    s = read(spark, d, "supplier").join(c, "s_suppkey", "left").withColumns({"longitude": F.col("s_acctbal"), "latitude": F.lit(1.0)})
    return st.moved(s, 0.1, 1000.0).select(F.col("s_suppkey").alias("station_id"))


@query("bad_from_log", "SELECT DISTINCT s_name AS station_id FROM supplier WHERE s_acctbal < 2000")
def bad_from_log(spark, d):
    """An infill log that complains of poor accounts in two ways."""
    s = read(spark, d, "supplier")
    line = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("ERROR: Could not infill "), F.col("s_name"), F.lit("|no neighbours"))).when(F.col("s_acctbal") < 2000, F.concat(F.lit("ERROR|"), F.col("s_name"), F.lit(" had nonoptimal infill. Reasons: mae"))).otherwise(F.concat(F.lit("INFO|"), F.col("s_name")))
    return st.bad_from_log(s.select(line.alias("value")))


@query("bad_station_union", f"WITH {STN} SELECT station_id FROM stn WHERE elev < 0 UNION SELECT station_id FROM stn WHERE climdiv > 20 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity = 1")
def bad_station_union(spark, d):
    s = stations(spark, d)
    return st.union_distinct([s.where("elev < 0").select("station_id"), s.where("climdiv > 20").select("station_id"), read(spark, d, "lineitem").where("l_quantity = 1").select(F.col("l_suppkey").alias("station_id"))])


@query("region_parameters", f"WITH {STN} SELECT climdiv, CAST(station_id%12+1 AS INT) AS month, arg_min(CAST(station_id%50+35 AS INT), station_id) AS optim FROM stn GROUP BY 1,2")
def region_parameters(spark, d):
    s = stations(spark, d).select("station_id", "climdiv", (F.col("station_id") % 12 + 1).cast("int").alias("month"), (F.col("station_id") % 50 + 35).cast("int").alias("optim"))
    return st.region_parameters(s, "optim")
