"""Bars, the position axis, panels, their checks and log returns.

Everything stays long (one row per date and asset); a wide table is only a final pivot. The
calendar is derived from the distinct dates, which are few, and broadcast only by Catalyst's own
size estimate. No window runs over an unpartitioned fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.errors import PanelError


def bars(lineitem: DataFrame, unit: str, assets: int) -> DataFrame:
    """(date, asset, close, volume, quote_volume, trades): volume-weighted price bars of a trade table."""
    day = F.trunc("l_shipdate", unit) if unit != "day" else F.to_date("l_shipdate")
    rows = lineitem.where("l_quantity > 0").select(day.alias("date"), F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(assets)).cast("string")).alias("asset"), "l_extendedprice", "l_quantity")
    return rows.groupBy("date", "asset").agg(
        F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("quote_volume"),
        F.count("*").alias("trades"),
    )


def between(rows: DataFrame, start: str, end: str) -> DataFrame:
    """The rows of a closed date range; the filter reaches the scan."""
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def calendar(rows: DataFrame) -> DataFrame:
    """(date, pos): the distinct dates numbered from 0; a table of dates, not of facts."""
    return rows.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def panel(bar_rows: DataFrame) -> DataFrame:
    """Bars with pos and asset_ix, the dense axes."""
    assets = bar_rows.select("asset").distinct().withColumn("asset_ix", (F.row_number().over(Window.orderBy("asset")) - 1).cast("int"))
    return bar_rows.join(calendar(bar_rows), "date").join(assets, "asset")


def wide(rows: DataFrame, value: str, assets: list[str]) -> DataFrame:
    """One row a date and a column an asset, in the order given; a missing cell is null."""
    return rows.groupBy("date").pivot("asset", assets).agg(F.first(value))


def violations(panel_rows: DataFrame, unit: str) -> DataFrame:
    """(check, n): how many cells break each invariant; all zero for a sound panel."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit]
    ends = panel_rows.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    full = ends.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("date"))
    gaps = full.join(panel_rows.select("date").distinct(), "date", "left_anti").agg(F.count("*").alias("n"))
    shape = panel_rows.agg(
        (F.count_distinct("date") * F.count_distinct("asset") - F.count("*")).alias("missing_cells"),
        F.count_if(F.col("close").isNull() | F.col("volume").isNull()).alias("null_values"),
        F.count_if(F.col("close") <= 0).alias("prices_not_positive"),
        F.count_if(F.col("volume") == 0).alias("zero_volumes"),
    )
    out = shape.unpivot([], shape.columns, "check", "n")
    return gaps.select(F.lit("calendar_gaps").alias("check"), "n").unionByName(out)


def validated(panel_rows: DataFrame, unit: str) -> DataFrame:
    """panel_rows, or a PanelError that names the first broken invariant."""
    order = ["calendar_gaps", "missing_cells", "null_values", "prices_not_positive", "zero_volumes"]
    found = {r["check"]: r["n"] for r in violations(panel_rows, unit).collect()}
    for check in order:
        if found.get(check):
            raise PanelError(f"{check.replace('_', ' ')}: {found[check]}")
    return panel_rows


def log_returns(panel_rows: DataFrame) -> DataFrame:
    """(pos, date, asset, asset_ix, r, volume): r = ln P(t) - ln P(t-1); the first bar of an asset drops out."""
    w = Window.partitionBy("asset").orderBy("pos")
    r: Column = F.ln("close") - F.lag(F.ln("close")).over(w)
    rows = panel_rows.withColumn("r", r).where("r is not null")
    return rows.select((F.col("pos") - 1).alias("pos"), "date", "asset", "asset_ix", "r", "volume")
