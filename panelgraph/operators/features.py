"""Causal node features, walk-forward folds, segments and the fold standardiser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelgraph.config import FeatureConfig, FoldConfig
from panelgraph.errors import FoldError


def names(config: FeatureConfig) -> list[str]:
    return [f"r_lag{k}" for k in range(config.lags)] + [f"rv_{w}" for w in config.vol_windows] + [f"logvol_z_{config.volume_window}"]


def floored(sd, mean):
    """A scale that is 1 where the spread is nothing but rounding."""
    return F.when(sd <= 1e-12 * F.greatest(F.abs(mean), F.lit(1.0)), 1.0).otherwise(sd)


def node_features(returns: DataFrame, config: FeatureConfig) -> DataFrame:
    """(pos, date, asset, asset_ix, r, features): only rows up to pos are read; incomplete windows are null.

    All features share one exchange and one sort by asset.
    """
    order = Window.partitionBy("asset").orderBy("pos")

    def full(x, w: int):
        return F.when(F.count("*").over(order.rowsBetween(-(w - 1), 0)) == w, x)

    out = {f"r_lag{k}": F.lag("r", k).over(order) for k in range(config.lags)}
    for w in config.vol_windows:
        out[f"rv_{w}"] = full(F.sqrt(F.avg(F.col("r") * F.col("r")).over(order.rowsBetween(-(w - 1), 0))), w)
    w = config.volume_window
    frame = order.rowsBetween(-(w - 1), 0)
    v = F.ln("volume")
    mean, sd = F.avg(v).over(frame), F.stddev_pop(v).over(frame)
    out[f"logvol_z_{w}"] = full((v - mean) / floored(sd, mean), w)
    return returns.select("pos", "date", "asset", "asset_ix", "r", *[x.alias(n) for n, x in out.items()])


def fold_layout(n_obs: int, offset: int, config: FoldConfig) -> list[tuple[int, str, int, int]]:
    """(fold, split, first, last) positions; the last horizon rows have no target and are left out."""
    c = config
    if min(c.train, c.val, c.test, c.step, c.horizon) < 1 or offset < 0 or c.mode not in ("rolling", "expanding"):
        raise FoldError("fold sizes, step and horizon must be positive and the mode rolling or expanding")
    span, out, k = c.train + c.val + c.test, [], 0
    while (start := offset + k * c.step) + span - 1 <= n_obs - 1 - c.horizon:
        first = start if c.mode == "rolling" else offset
        a, b = start + c.train, start + c.train + c.val
        out += [(k, "train", first, a - 1), (k, "val", a, b - 1), (k, "test", b, b + c.test - 1)]
        k += 1
    if not out:
        raise FoldError(f"{n_obs} rows from {offset} on hold no fold of {span} rows")
    return out


def folds(spark: SparkSession, layout: list[tuple[int, str, int, int]]) -> DataFrame:
    return spark.createDataFrame(layout, "fold int, split string, pos_start int, pos_end int")


def fold_positions(fold_rows: DataFrame) -> DataFrame:
    """(fold, split, pos), so that blocks meet rows in an equi join."""
    return fold_rows.select("fold", "split", F.explode(F.sequence("pos_start", "pos_end")).alias("pos"))


def targets(returns: DataFrame, horizon: int) -> DataFrame:
    """(pos, asset, asset_ix, r, target_date, y): the return h rows later beside its origin."""
    order = Window.partitionBy("asset").orderBy("pos")
    return returns.select("pos", "asset", "asset_ix", "r", F.lead("date", horizon).over(order).alias("target_date"), F.lead("r", horizon).over(order).alias("y"))


def lag_history(returns: DataFrame, length: int) -> DataFrame:
    """(pos, asset, history): the last `length` returns, oldest first; null while incomplete."""
    frame = Window.partitionBy("asset").orderBy("pos").rowsBetween(-(length - 1), 0)
    h = F.collect_list("r").over(frame)
    return returns.select("pos", "asset", F.when(F.size(h) == length, h).alias("history"))


def standardiser(features: DataFrame, positions: DataFrame, columns: list[str]) -> DataFrame:
    """(fold, asset, mean_*, sd_*) from training rows only; population spread with a floor of 1."""
    rows = features.join(positions.where("split = 'train'"), "pos")
    stats = [s for c in columns for s in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))]
    out = rows.groupBy("fold", "asset").agg(*stats)
    return out.select("fold", "asset", *[x for c in columns for x in (F.col(f"mean_{c}"), floored(F.col(f"sd_{c}"), F.col(f"mean_{c}")).alias(f"sd_{c}"))])


def standardised(features: DataFrame, positions: DataFrame, columns: list[str]) -> DataFrame:
    """(fold, split, pos, asset, columns) of every fold with its training statistics."""
    stats = standardiser(features, positions, columns)
    rows = features.join(positions, "pos").join(stats, ["fold", "asset"])
    return rows.select("fold", "split", "pos", "asset", *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")).alias(c) for c in columns])


def aligned_graph(returns: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(pos, asset_ix, has_graph): every row of the panel with whether its date has a graph."""
    dates = adjacency.select("pos").distinct().withColumn("has_graph", F.lit(True))
    return returns.select("pos", "asset_ix").join(dates, "pos", "left").withColumn("has_graph", F.coalesce("has_graph", F.lit(False)))


def fold_guard(positions: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """(fold, n_null): feature cells that are null inside a fold; all zero for usable folds."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return positions.join(features, "pos").groupBy("fold").agg(F.sum(nulls).cast("long").alias("n_null"))
