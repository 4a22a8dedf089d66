"""Sign strategies on forecasts, with costs. One plan covers all models and cost levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelgraph.errors import EvaluationError

REFERENCE = "buy-and-hold"


def rectangular_gaps(predictions: DataFrame) -> DataFrame:
    """(model, missing, duplicates): cells that keep a model's dates x assets from being a rectangle."""
    cells = predictions.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("date", "asset").alias("cells"), F.count_distinct("date").alias("d"), F.count_distinct("asset").alias("a"))
    return cells.select("model", (F.col("d") * F.col("a") - F.col("cells")).alias("missing"), (F.col("n") - F.col("cells")).alias("duplicates"))


def checked(predictions: DataFrame) -> DataFrame:
    """The predictions, if no model is named like the reference and each has one row for all its dates x assets."""
    if not predictions.where(F.col("model") == REFERENCE).isEmpty():
        raise EvaluationError(f"a model is named {REFERENCE}, which is the reference's name")
    if broken := [r["model"] for r in rectangular_gaps(predictions).where("missing > 0 or duplicates > 0").limit(20).collect()]:
        raise EvaluationError(f"dates and assets are no rectangle: {broken}")
    return predictions


def positions(predictions: DataFrame) -> DataFrame:
    """(model, date, asset, weight, ret): sign(forecast) / N, with the simple return of the same row; and the reference."""
    n = predictions.agg(F.count_distinct("asset").alias("n_assets"))
    rows = predictions.select("model", "date", "asset", F.signum("y_pred").alias("side"), F.expm1("y_true").alias("ret"))
    first = predictions.groupBy("date", "asset").agg(F.first("y_true").alias("y"))  # the truth is the same for all models
    hold = first.select(F.lit(REFERENCE).alias("model"), "date", "asset", F.lit(1.0).alias("side"), F.expm1("y").alias("ret"))
    return rows.unionByName(hold).crossJoin(F.broadcast(n)).select("model", "date", "asset", (F.col("side") / F.col("n_assets")).alias("weight"), "ret")  # one row


def curves(predictions: DataFrame, costs_bps: tuple[float, ...]) -> DataFrame:
    """(model, cost_bps, date, gross_return, turnover, cost, net_return, equity)."""
    if not costs_bps or len(set(costs_bps)) < len(costs_bps) or min(costs_bps) < 0:
        raise EvaluationError("cost levels must be distinct and not negative")
    spark: SparkSession = predictions.sparkSession
    costs = spark.createDataFrame([(float(c),) for c in costs_bps], "cost_bps double")
    w = Window.partitionBy("model", "asset").orderBy("date")
    moved = positions(predictions).withColumn("moved", F.abs(F.col("weight") - F.lag("weight", 1, 0.0).over(w)))
    daily = moved.groupBy("model", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross_return"), F.sum("moved").alias("turnover"))
    rows = daily.crossJoin(F.broadcast(costs)).withColumn("cost", F.col("turnover") * F.col("cost_bps") * 1e-4).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    path = Window.partitionBy("model", "cost_bps").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("equity", F.product(1 + F.col("net_return")).over(path)).select("model", "cost_bps", "date", "gross_return", "turnover", "cost", "net_return", "equity")


def drawdowns(curve_rows: DataFrame) -> DataFrame:
    """(model, cost_bps, date, drawdown): the fall from the running peak, which starts at 1."""
    path = Window.partitionBy("model", "cost_bps").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(1.0), F.max("equity").over(path))
    return curve_rows.withColumn("drawdown", F.greatest("equity", F.lit(0.0)) / peak - 1).select("model", "cost_bps", "date", "equity", "net_return", "turnover", "drawdown")


def summary(curve_rows: DataFrame, periods: int) -> DataFrame:
    """One row a (model, cost_bps): days, turnover, return, volatility, Sharpe, drawdown, cumulative return."""
    p = float(periods)
    sd = F.stddev_samp("net_return")
    rows = drawdowns(curve_rows).groupBy("model", "cost_bps").agg(
        F.count("*").alias("n_days"), F.avg("turnover").alias("mean_turnover"), F.max_by("equity", "date").alias("last"), sd.alias("sd"), F.avg("net_return").alias("avg"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown")
    )
    return rows.select(
        "model", "cost_bps", "n_days", "mean_turnover",
        F.when(F.col("last") > 0, F.pow("last", F.lit(p) / F.col("n_days")) - 1).alias("annualized_return"),
        (F.col("sd") * F.sqrt(F.lit(p))).alias("annualized_volatility"),
        (F.try_divide("avg", "sd") * F.sqrt(F.lit(p))).alias("sharpe"),
        "max_drawdown", (F.col("last") - 1).alias("cumulative_return"),
    )


#: The four readings of a strategy by its Sharpe ratio at the lowest and the highest cost.
NO_POSITION, SURVIVES, CONSUMED, UNPROFITABLE = "no position taken", "survives the cost", "the cost consumes the edge", "unprofitable either way"


def verdicts(summary_rows: DataFrame) -> DataFrame:
    """(model, verdict): how a strategy's Sharpe ratio at the lowest cost level stands at the highest one; the reference is left out."""
    ends = summary_rows.where(F.col("model") != REFERENCE).groupBy("model").agg(F.min_by("sharpe", "cost_bps").alias("gross"), F.max_by("sharpe", "cost_bps").alias("net"))
    v = F.when(F.col("gross").isNull(), NO_POSITION).when(F.col("net") > 0, SURVIVES).when(F.col("gross") > 0, CONSUMED).otherwise(UNPROFITABLE)
    return ends.select("model", v.alias("verdict"))


def in_order(summary_rows: DataFrame, models: list[str]) -> DataFrame:
    """The summary with cost_ix and model_ix, sorted by them: costs ascending, models as given, the reference last."""
    order = {m: k for k, m in enumerate([*(m for m in models if m != REFERENCE), REFERENCE])}
    ix = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("model")]
    costs = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("cost_bps")) - 1  # a row a model and cost level
    return summary_rows.withColumn("cost_ix", costs).withColumn("model_ix", ix).orderBy("cost_ix", "model_ix")


def best_tradable(summary_rows: DataFrame) -> DataFrame:
    """(cost_bps, model, sharpe) with the highest positive Sharpe ratio, the reference left out."""
    rows = summary_rows.where((F.col("sharpe") > 0) & (F.col("model") != REFERENCE))
    return rows.groupBy("cost_bps").agg(F.max_by("model", "sharpe").alias("model"), F.max("sharpe").alias("sharpe"))
