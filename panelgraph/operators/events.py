"""Event studies on a daily or periodic table of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OFFSETS = (-60, -30, 0, 30, 60)
EVENTS = "event_key string, event_date date, label string, description string, citation string"


def load_events(path: str) -> list[tuple]:
    """Events of a YAML list, which may stand under the key `events`.

    No events, a repeated or missing key, a missing date or label is a ValueError.
    """
    import datetime

    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or []
    if isinstance(rows, dict):
        rows = rows.get("events") or []
    if not rows:
        raise ValueError("no events")
    if any(not r.get("key") for r in rows) or len({r["key"] for r in rows}) < len(rows):
        raise ValueError("an event key is missing or repeated")
    if bad := [r["key"] for r in rows if not isinstance(r.get("date"), datetime.date) or not r.get("label")]:
        raise ValueError(f"events without a date or label: {bad}")
    return [(r["key"], r["date"], r["label"], r.get("description", ""), r.get("citation", "") or "") for r in rows]


def event_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EVENTS)


def without_citation(events: DataFrame) -> DataFrame:
    return events.where("trim(coalesce(citation, '')) = ''").select("event_key")


def strictly_below(long: DataFrame) -> DataFrame:
    """Adds percentile: the share of the metric's whole history strictly below the value."""
    by = Window.partitionBy("metric")
    below = F.rank().over(by.orderBy(F.col("value").asc_nulls_last())) - 1
    return long.withColumn("percentile", F.when(F.col("value").isNotNull(), below / F.count("*").over(by)))


def nearest(dates: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """wanted (event_key, offset_days, target) with date_used: the closest date within reach days, the earlier on ties.

    An as-of join by day buckets: a wanted day is looked up in its own bucket and both neighbours,
    so it is an equi join whatever the number of dates.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / (reach + 1))
    near = wanted.withColumn("b", F.explode(F.array(*[bucket(F.col("target")) + k for k in (-1, 0, 1)])))
    have = dates.select(F.col("date").alias("cand"), bucket(F.col("date")).alias("b"))
    gap = F.abs(F.datediff("cand", "target"))
    hit = near.join(have, "b").where(gap <= reach).groupBy("event_key", "offset_days").agg(F.min_by("cand", F.struct(gap, "cand")).alias("date_used"))
    return wanted.join(hit, ["event_key", "offset_days"], "left")


def event_study(topology: DataFrame, metrics: list[str], events: DataFrame, offsets: tuple[int, ...] = OFFSETS, reach: int = 3) -> DataFrame:
    """One row an event, metric and offset: value, percentile and the changes across the window."""
    if len(offsets) < 2:
        raise ValueError("an event study needs two offsets")
    grid = events.select("event_key", "event_date", "label", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset_days"))
    grid = grid.withColumn("target", F.date_add("event_date", F.col("offset_days")))
    used = nearest(topology.select("date"), grid, reach)
    long = strictly_below(topology.select("date", *[F.col(m).cast("double") for m in metrics]).unpivot(["date"], metrics, "metric", "value"))
    names = topology.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    rows = used.crossJoin(F.broadcast(names))  # a row a metric
    rows = rows.join(long.withColumnRenamed("date", "date_used"), ["date_used", "metric"], "left")
    at = lambda o: F.max(F.when(F.col("offset_days") == o, F.col("value"))).over(Window.partitionBy("event_key", "metric"))
    change = lambda a, b: 100 * F.try_divide(at(b) - at(a), at(a))
    local = change(offsets[1], offsets[-2]) if len(offsets) >= 4 else F.lit(None).cast("double")
    return rows.select("event_key", "event_date", "label", "metric", "offset_days", "date_used", "value", "percentile", change(offsets[0], offsets[-1]).alias("pct_change_clean"), local.alias("pct_change_local"))


def event_tables(study: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """One row an event and metric, a column an offset."""
    return study.groupBy("event_key", "metric").pivot("offset_days", list(offsets)).agg(F.first("value"))


def post_event_dates(events: DataFrame, days: int = 60) -> DataFrame:
    return events.select("event_key", F.date_add("event_date", days).alias("post_date"))
