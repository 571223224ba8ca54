"""Column functions: geography, dates, units, formats, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.009
Z_95 = 1.959964
NAN = float("nan")

#: Quality flags by rule, as the archives write them (fixed values).
QA_FLAGS = {
    "ok": "", "missing": "", "naught": "N", "dup": "D", "impossible": "X", "streak": "K", "gap": "G", "internal": "I",
    "lagrange": "R", "spike": "T", "mega": "M", "spatial_regress": "S", "spatial_corrob": "S", "clim_outlier": "O",
}


def d(x: float) -> Column:
    return F.lit(float(x))


def nan_to_null(c: Column) -> Column:
    """Missing is null inside the engine, never NaN."""
    return F.when(~F.isnan(c), c)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return d(2 * EARTH_RADIUS_KM) * F.asin(F.least(d(1), F.sqrt(a)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial angle from the first point to the second, degrees from north."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))


def distance_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.struct(haversine(lon1, lat1, lon2, lat2).alias("km"), bearing(lon1, lat1, lon2, lat2).alias("angle"))


def distance_angle_cosines(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The same by the law of cosines, its argument held within -1 and 1."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    c = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.struct((d(EARTH_RADIUS_KM) * F.acos(F.greatest(d(-1), F.least(d(1), c)))).alias("km"), bearing(lon1, lat1, lon2, lat2).alias("angle"))


def decimal_to_dms(x: Column) -> Column:
    """Degrees (with the sign), minutes and seconds."""
    a = F.abs(x)
    minutes = (a - F.floor(a)) * 60
    return F.struct((F.signum(x) * F.floor(a)).cast("int").alias("degrees"), F.floor(minutes).cast("int").alias("minutes"), ((minutes - F.floor(minutes)) * 60).alias("seconds"))


def decimal_to_dm(x: Column) -> Column:
    a = F.abs(x)
    return F.struct((F.signum(x) * F.floor(a)).cast("int").alias("degrees"), ((a - F.floor(a)) * 60).alias("minutes"))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column) -> Column:
    """The sign is that of the degrees: of -0 it is lost."""
    part = minutes / 60 + seconds / 3600
    return F.when(degrees < 0, degrees - part).otherwise(degrees + part)


def dm_to_decimal(degrees: Column, minutes: Column) -> Column:
    return dms_to_decimal(degrees, minutes, d(0))


def parse_degrees(text: Column) -> Column:
    """'42 30 15' or 42:30:15 and the like as decimal degrees."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))
    return F.when(F.size(n) > 0, dms_to_decimal(F.get(n, F.lit(0)), F.coalesce(F.get(n, F.lit(1)), d(0)), F.coalesce(F.get(n, F.lit(2)), d(0))))


def ymd(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("int")


def md(date: Column) -> Column:
    return (F.month(date) * 100 + F.day(date)).cast("int")


def ymd_to_date(number: Column) -> Column:
    """Null for numbers that are no date."""
    return F.try_to_date(F.lpad(number.cast("string"), 8, "0"), "yyyyMMdd")


def month_bounds(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366


def mid_date(first: Column, last: Column) -> Column:
    return F.date_add(first, F.floor(F.datediff(last, first) / 2).cast("int"))


def feet_to_m(x: Column) -> Column:
    return x * d(0.3048)


def kelvin_to_c(x: Column) -> Column:
    return x - d(273.15)


def archive_units(element: Column, value: Column) -> Column:
    """Tenths of a degree to degrees, tenths of a mm to cm; -9999 is missing."""
    return F.when(value != -9999, F.when(element == "PRCP", value / d(100)).when(element.isin("TMIN", "TMAX"), value / d(10)))


def wrap_lon(x: Column) -> Column:
    return F.when(x > 180, x - 360).otherwise(x)


def bisquare(distance: Column, bandwidth: Column) -> Column:
    return F.pow(d(1) - F.pow(distance / bandwidth, 2), 2)


def pack(x: Column) -> Column:
    """A short of hundredths; null, and what does not fit, is null. Ties go to even as in
    numpy and SQL, by the product: bround looks at all decimals of x, and 22.295, which is
    22.294999999999998, times 100 is 2229.5."""
    v = F.rint(x * 100)
    return F.when(v.between(-32767, 32767), v.cast("short"))


def unpack(x: Column) -> Column:
    return x.cast("double") / d(100)


def std_error_ci(mean: Column, variance: Column) -> Column:
    se = F.sqrt(F.greatest(variance, d(0)))
    return F.struct(se.alias("se"), (mean - se * d(Z_95)).alias("low"), (mean + se * d(Z_95)).alias("high"))


def station_code(station_id: Column, strict: bool = True) -> Column:
    """Network ids as codes of 11 characters for the homogenisation files; others
    raise an error, or are null if not strict."""
    rest = F.substring_index(station_id, "_", -1)
    code = (
        F.when(station_id.startswith("GHCND_"), rest)
        .when(station_id.startswith("NRCS_"), F.concat(F.lit("SNT"), F.lpad(F.substring(F.replace(rest, F.lit(":"), F.lit("")), 1, 8), 8, "0")))
        .when(station_id.startswith("RAWS_") | station_id.startswith("WRCC_"), F.concat(F.lit("WRC"), F.lpad(rest, 8, "0")))
        .when(station_id.startswith("USH"), station_id)
    )
    ok = F.coalesce(F.length(code) == 11, F.lit(False))
    return F.when(ok, code).otherwise(F.raise_error(F.concat(F.lit("no code of 11 characters: "), station_id)) if strict else F.lit(None))


def flag_letter(rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in QA_FLAGS.items() for x in kv])[rule]


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Within tolerance, or both null."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def bandwidths(low: int, high: int, percent: float) -> list[int]:
    """Numbers of neighbours to try, each about that much above the one before."""
    out = []
    while low <= high:
        out.append(low)
        low += max(1, round(percent * low))
    return out


def size_classes(index: Column, total: Column, classes: int) -> Column:
    """Class of a row by its 0-based place among total, classes as equal as can be,
    the larger ones first."""
    small, more = F.floor(total / classes), total % classes
    edge = (small + 1) * more
    return F.when(index < edge, F.floor(index / (small + 1))).otherwise(more + F.floor((index - edge) / F.greatest(small, F.lit(1)))).cast("int")
