"""Stations, reports and interval readings."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.ranges import interval_join, seconds
from gridloom.session import cut

log = logging.getLogger(__name__)


def merge_stations(local: DataFrame, web: DataFrame, order: str | None = None) -> DataFrame:
    """All local stations plus web stations with a new id; among equal web ids the last wins."""
    rest = [c for c in local.columns if c != "station_id"]
    by = F.struct(*([order] if order else []), *rest)
    one = web.groupBy("station_id").agg(F.max_by(F.struct(*rest), by).alias("_s")).select("station_id", "_s.*")
    return local.unionByName(one.join(local.select("station_id"), "station_id", "left_anti"))


def bbox_filter(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    return points.filter(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def _grams(text: str) -> Column:
    """Distinct substrings of the length ``_size``, none where the text is shorter."""
    size = F.col("_size")
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(F.when(F.length(text) >= size, at), lambda i: F.substring(F.col(text), i, size)))


def match_aliases(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of a line and a station one of whose aliases occurs in the line's name.

    ``lines`` is ``(line_id, name, value)``. A substring test is a theta join; here each alias has one key, of its
    substrings as long as the shortest alias that which fewest aliases share, and a name is keyed by its substrings of
    this one length. Pairs that meet at a key are then tested. Empty aliases match nothing.
    """
    named = aliases.filter(F.length("alias") > 0).select("station_id", "alias").distinct()
    size = named.agg(F.min(F.length("alias"))).scalar()
    grams = named.withColumn("_size", size).select("station_id", "alias", F.explode(_grams("alias")).alias("_gram"))
    shared = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keyed = grams.join(shared, "_gram").groupBy("station_id", "alias").agg(F.min(F.struct("_n", "_gram")).alias("_k"))
    keyed = keyed.select("station_id", "alias", F.col("_k._gram").alias("_gram"))
    names = lines.withColumn("_size", size).select("line_id", "name", "value", F.explode(_grams("name")).alias("_gram"))
    hits = names.join(keyed, "_gram").filter(F.contains("name", "alias"))
    return hits.groupBy("station_id", "line_id").agg(F.first("value").alias("value"))


def snap_window(start: str, end: str, hour: int = 8):
    """Window edges as columns: the end moves up and the start down to the report hour."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    at = lambda t: F.date_trunc("day", t) + F.make_dt_interval(hours=F.lit(hour))
    one = F.make_dt_interval(days=F.lit(1))
    return (
        F.when(s < at(s), at(s) - one).otherwise(at(s)),
        F.when(e > at(e), at(e) + one).otherwise(at(e)),
    )


# Shortest and longest report in days.
PERIODS = (1, 10)


def select_reports(reports: DataFrame, start: str, end: str, periods: tuple[int, int] = PERIODS) -> DataFrame:
    """Reports taken when walking back from the end of the window, whose edges snap to the report hour.

    ``reports`` is ``(source, report_date DATE, period INT, matched BOOLEAN)``; other than the ``periods`` (from, to)
    are not asked for. On a day the smallest period counts; a matched report jumps back by its period, an unmatched one
    or a day without any by one day. Walking back over gaps means: take the latest day not after the cursor. Per source
    only one entry per calendar day of the window is left before the walk, whatever the volume, and
    the walk is a fold inside the JVM.
    """
    day = F.col("report_date")
    low, high = (F.to_date(edge) for edge in snap_window(start, end))
    asked = reports.filter(day.between(low, high) & F.col("period").between(*periods))
    first = asked.groupBy("source", "report_date").agg(F.min("period").alias("period"), F.min_by("matched", "period").alias("matched"))
    # The calendar bounds the array: at most one entry per day of the window.
    walk = first.filter("matched").groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct(F.unix_date("report_date").alias("d"), F.col("period").alias("p"))), asc=False).alias("days")
    )
    taken = F.aggregate(
        F.col("days"),
        F.struct(F.unix_date(high).alias("at"), F.array().cast("array<struct<d:int,p:int>>").alias("got")),
        lambda acc, x: F.when(
            x["d"] <= acc["at"],
            F.struct((x["d"] - x["p"]).alias("at"), F.concat(acc["got"], F.array(x)).alias("got")),
        ).otherwise(acc),
        lambda acc: acc["got"],
    )
    return walk.select("source", F.inline(taken)).select(
        "source", F.date_from_unix_date("d").alias("report_date"), F.col("p").alias("period")
    )


def report_intervals(reports: DataFrame, date: str = "report_date") -> DataFrame:
    """Interval ``[report_date - period days, report_date]`` of each report."""
    return reports.withColumns(
        {
            "start_ts": (F.col(date) - F.make_dt_interval(days=F.col("period"))).cast("timestamp_ntz"),
            "end_ts": F.col(date).cast("timestamp_ntz"),
        }
    )


def step_calendar(windows: DataFrame, dt_seconds: int, keys: list[str]) -> DataFrame:
    """Half-open steps of ``dt`` from each window's start; the remainder at the end is dropped."""
    micro = dt_seconds * 1_000_000
    n = F.floor((seconds(F.col("end_ts")) - seconds(F.col("start_ts"))) / micro)
    steps = windows.withColumn("_n", n).filter(F.col("_n") >= 1)
    out = steps.withColumn("step", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    at = lambda k: F.timestamp_micros(seconds(F.col("start_ts")) + k * F.lit(micro)).cast("timestamp_ntz")
    return out.select(*keys, "step", at(F.col("step").cast("long")).alias("s0"), at(F.col("step").cast("long") + 1).alias("s1"))


def active_readings(readings: DataFrame, steps: DataFrame, width_seconds: int = 86400) -> DataFrame:
    """Readings that cover a whole step: ``start <= s0 < end`` and ``start < s1 <= end``.

    The step start must lie in the reading, so the interval join bins the readings and keys each
    step by its start; the second condition is checked on the joined pair.
    """
    joined = interval_join(
        steps.select("step", "s0", "s1"),
        readings,
        seconds(F.col("s0")),
        seconds(F.col("start_ts")),
        seconds(F.col("end_ts")),
        width_seconds * 1_000_000,
    )
    return joined.filter((F.col("start_ts") < F.col("s1")) & (F.col("s1") <= F.col("end_ts")))


def union_sources(*sources: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """All sources below one another; one that cannot be read is logged and left out."""
    good = []
    for i, src in enumerate(sources):
        try:
            df = src() if callable(src) else src
            df.schema
            good.append(df)
        except Exception as exc:  # noqa: BLE001 - any failing source must not stop the others
            log.warning("source %d left out: %s", i, exc)
    if not good:
        raise ValueError("no source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)


def read_sources(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Rows of all sources with their ``source``, and a report ``(source, read, error)`` of each.

    Each source is read in a job of its own into the shared folder, so that one whose files turn out to be broken while
    they are read is left out as a whole and named in the report, and the others stay. Columns that a source lacks are null.
    """
    good, report = [], []
    for name, reader in readers.items():
        try:
            good.append(cut(reader(), "source").withColumn("source", F.lit(name)))
            report.append((name, True, None))
        except Exception as exc:  # noqa: BLE001 - any failing source must not stop the others
            log.warning("source %s left out: %s", name, exc)
            report.append((name, False, str(exc).split("\n")[0][:500]))
    if not good:
        raise ValueError(f"no source could be read: {report}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)
    return rows, spark.createDataFrame(report, "source string, read boolean, error string")


def gate_min_points(points: DataFrame, steps: DataFrame, k: int, value: str = "value") -> DataFrame:
    """Mean and count per step; a step with fewer than ``k`` points gives 0."""
    per = points.groupBy("step").agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_v"))
    out = steps.select("step").join(per, "step", "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return out.select("step", n.alias("n"), F.when(n >= k, F.col("_v")).otherwise(F.lit(0.0)).alias(value))
