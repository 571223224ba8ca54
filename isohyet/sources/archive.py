"""Station files as a data source of Spark: a partition a file, bounds of dates pushed
into the reader.

    register(spark)
    spark.read.format("station_files").option("kind", "raws").load("/archive/raws/*.txt")

A kind is a function from the lines of a file, the station's id (from the file's name) and
the first and last day wanted (or None) to rows of SCHEMA. Kinds of one's own are given to
register by name."""

from __future__ import annotations

import datetime as dt
import glob
import io
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from isohyet.shipping import ship

SCHEMA = "station_id string, obs_date date, tmin double, tmax double, prcp double, qflag_tmin string, qflag_tmax string, qflag_prcp string"
_ARROW = pa.schema([("station_id", pa.string()), ("obs_date", pa.date32()), *((c, pa.float64()) for c in ("tmin", "tmax", "prcp")), *((f"qflag_{c}", pa.string()) for c in ("tmin", "tmax", "prcp"))])
#: Rows of a batch.
ROWS = 50_000
Row = tuple
Kind = Callable[[Iterable[str], str, dt.date | None, dt.date | None], Iterator[Row]]


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _wanted(day: dt.date, first: dt.date | None, last: dt.date | None) -> bool:
    return (first is None or day >= first) and (last is None or day <= last)


def ghcn(lines: Iterable[str], station: str, first: dt.date | None, last: dt.date | None) -> Iterator[Row]:
    """Lines of a month and element with 31 groups of 8 characters; months outside the
    bounds are not parsed. Tenths of degrees and of mm (to cm)."""
    days: dict[tuple[str, dt.date], list] = {}
    for line in lines:
        element = line[17:21]
        if element not in ("TMIN", "TMAX", "PRCP"):
            continue
        year, month = int(line[11:15]), int(line[15:17])
        if (last is not None and dt.date(year, month, 1) > last) or (first is not None and (year, month) < (first.year, first.month)):
            continue
        at = ("TMIN", "TMAX", "PRCP").index(element)
        for d in range(31):
            try:
                day = dt.date(year, month, d + 1)
            except ValueError:
                break
            if _wanted(day, first, last):
                value = _number(line[21 + 8 * d : 26 + 8 * d].strip())
                row = days.setdefault((line[:11], day), [None, None, None, "", "", ""])
                if value is not None and value != -9999:
                    row[at] = value / 10 if at < 2 else value / 100
                row[3 + at] = line[27 + 8 * d : 28 + 8 * d].strip()
    for (code, day), row in sorted(days.items()):
        yield (f"GHCND_{code}", day, *row)


def snotel(lines: Iterable[str], station: str, first: dt.date | None, last: dt.date | None) -> Iterator[Row]:
    """Two lines, a header, dates a day late, -99.9 missing."""
    at: dict[str, int] = {}
    for line in lines:
        cells = line.rstrip("\n").split(",")
        if "TMAX.D-1 (degC) " in cells:
            if any(cells.count(c) > 1 for c in ("TMIN.D-1 (degC) ", "TMAX.D-1 (degC) ")):
                raise ValueError("a header names an element twice")
            at = {c: i for i, c in enumerate(cells)}
            continue
        try:
            day = dt.date.fromisoformat(cells[1]) - dt.timedelta(1)
        except (IndexError, ValueError):
            continue
        if at and _wanted(day, first, last):
            v = [_number(cells[at[c]].strip()) if at.get(c, len(cells)) < len(cells) else None for c in ("TMIN.D-1 (degC) ", "TMAX.D-1 (degC) ")]
            yield (f"NRCS_{station}", day, *(None if x == -99.9 else x for x in v), None, "", "", "")


def raws(lines: Iterable[str], station: str, first: dt.date | None, last: dt.date | None) -> Iterator[Row]:
    """Lines that begin with a date: columns 9, 10 and 14 are the maximum, the minimum
    and mm of rain (to cm)."""
    for line in lines:
        cells = line.split()
        try:
            day = dt.datetime.strptime(cells[0], "%m/%d/%Y").date()
        except (IndexError, ValueError):
            continue
        if _wanted(day, first, last):
            v = [_number(cells[i]) if i < len(cells) else None for i in (10, 9, 14)]
            yield (f"RAWS_{station}", day, v[0], v[1], None if v[2] is None else v[2] / 10, "", "", "")


KINDS: dict[str, Kind] = {"ghcn": ghcn, "snotel": snotel, "raws": raws}


class StationFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return io.TextIOWrapper(system.open_input_stream(at), encoding="utf-8", errors="replace")
    return open(path, encoding="utf-8", errors="replace")  # noqa: SIM115


class StationReader(DataSourceReader):
    """first and last are the bounds of days that rows are parsed for."""

    def __init__(self, paths: list[str], kind: Kind, first: dt.date | None, last: dt.date | None):
        self.paths, self.kind, self.first, self.last = paths, kind, first, last

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds of obs_date are taken over whole; Spark keeps the other filters."""
        day = dt.timedelta(1)
        for f in filters:
            v = getattr(f, "value", None)
            if isinstance(f, IsNotNull) and f.attribute == ("obs_date",):
                continue  # no row is without a day
            if getattr(f, "attribute", None) != ("obs_date",) or not isinstance(v, dt.date):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._least(v + day if isinstance(f, GreaterThan) else v)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._most(v - day if isinstance(f, LessThan) else v)
            elif isinstance(f, EqualTo):
                self._least(v)
                self._most(v)
            else:
                yield f

    def _least(self, v: dt.date) -> None:
        self.first = v if self.first is None else max(v, self.first)

    def _most(self, v: dt.date) -> None:
        self.last = v if self.last is None else min(v, self.last)

    def partitions(self) -> list[InputPartition]:
        return [StationFile(p) for p in self.paths]

    def read(self, partition: StationFile) -> Iterator[pa.RecordBatch]:
        station = PurePosixPath(partition.path).stem
        with _open(partition.path) as lines:
            rows = []
            for row in self.kind(lines, station, self.first, self.last):
                rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[Row]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class StationFiles(DataSource):
    """Options: path (a pattern of files, or several by commas), kind, first and last
    (days as YYYY-MM-DD). The id of a station is its file's name without ending."""

    @classmethod
    def name(cls) -> str:
        return "station_files"

    def schema(self) -> str:
        return SCHEMA

    kinds = KINDS

    def reader(self, schema) -> DataSourceReader:
        kind = self.options.get("kind", "")
        if kind not in self.kinds:
            raise ValueError(f"kind is one of {', '.join(sorted(self.kinds))}")
        paths = [f for p in self.options["path"].split(",") for f in ([p] if "://" in p else sorted(glob.glob(p)))]
        bound = {c: dt.date.fromisoformat(self.options[c]) if c in self.options else None for c in ("first", "last")}
        return StationReader(paths, self.kinds[kind], bound["first"], bound["last"])


def register(spark: SparkSession, **kinds: Kind) -> None:
    """Make the source known to a session, with kinds beside those of KINDS, and let
    filters be pushed down to it."""

    class Registered(StationFiles):  # goes to the workers as it is, with its kinds
        pass

    Registered.kinds = KINDS | kinds
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Registered)
