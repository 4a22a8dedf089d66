"""Accuracy, loss comparison, multiplicity correction and rank association of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.errors import EvaluationError
from panelgraph.functions.tails import t_p
from panelgraph.operators.stats import average_rank


def accuracy(predictions: DataFrame, baseline: str, by: list[str] | None = None) -> DataFrame:
    """One row a (model, *by): rmse, mae, directional accuracy and coverage, skill against the baseline.

    Skill compares within the group. One aggregate and one join of its small result.
    """
    by = by or []
    e = F.col("y_true") - F.col("y_pred")
    taken = (F.col("y_true") != 0) & (F.col("y_pred") != 0)
    rows = predictions.groupBy("model", *by).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(taken, (F.signum("y_true") == F.signum("y_pred")).cast("double"))).alias("directional_accuracy"),
        F.avg(taken.cast("double")).alias("coverage"),
        F.count("*").alias("n_predictions"),
    )
    base = rows.where(F.col("model") == baseline).select(*by, F.col("mse").alias("base"))
    out = rows.join(base, by, "left") if by else rows.crossJoin(F.broadcast(base))  # one row
    return out.select("model", *by, F.sqrt("mse").alias("rmse"), "mae", "directional_accuracy", "coverage", (1 - F.try_divide("mse", "base")).alias("skill_score"), "n_predictions")


def uncovered(predictions: DataFrame, baseline: str) -> DataFrame:
    """Predictions without a baseline prediction for their date and asset."""
    base = predictions.where(F.col("model") == baseline).select("date", "asset").distinct()
    return predictions.join(base, ["date", "asset"], "left_anti")


def checked_accuracy(predictions: DataFrame, baseline: str, by: list[str] | None = None) -> DataFrame:
    if missing := [c for c in by or [] if c not in predictions.columns]:
        raise EvaluationError(f"no such column: {missing}")
    if not uncovered(predictions, baseline).isEmpty():
        raise EvaluationError(f"{baseline} does not cover all predictions")
    rows = accuracy(predictions, baseline, by)
    perfect = rows.where((F.col("model") == baseline) & (F.col("rmse") == 0))
    if predictions.where(F.col("model") == baseline).isEmpty() or not perfect.isEmpty():
        raise EvaluationError(f"{baseline} is missing or has no error to compare with")
    return rows


def by_error(accuracy_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy rows sorted by group and error, with rank, the place in the group; ties by model."""
    rank = F.row_number().over(Window.partitionBy(*by or [F.lit(1)]).orderBy("rmse", "model"))
    return accuracy_rows.withColumn("rank", rank).orderBy(*by or [], "rank")


def daily_losses(predictions: DataFrame) -> DataFrame:
    """(model, date, loss): mean squared error over assets."""
    e = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy("model", "date").agg(F.avg(e * e).alias("loss"))


def diebold_mariano(losses: DataFrame, horizon: int = 1) -> DataFrame:
    """(model_a, model_b, statistic, df, mean_loss_differential) of ordered pairs on common dates.

    Each unordered pair is computed once and mirrored with the sign changed. A pair without variance
    has a null statistic.
    """
    return both_ways(_unordered(losses, horizon), ["statistic", "mean_loss_differential"])


def checked_diebold_mariano(losses: DataFrame, model_a: str, model_b: str, horizon: int = 1) -> DataFrame:
    """The one row of two models; refuses a model against itself, horizons below 1, too few dates and equal losses."""
    if model_a == model_b or horizon < 1:
        raise EvaluationError("two models and a horizon of 1 or more are compared")
    row = diebold_mariano(losses.where(F.col("model").isin(model_a, model_b)), horizon).where((F.col("model_a") == model_a) & (F.col("model_b") == model_b))
    found = row.first()
    if found is None or found["df"] + 1 <= horizon:
        raise EvaluationError(f"{model_a} and {model_b} have too few common dates for horizon {horizon}")
    if found["statistic"] is None:
        raise EvaluationError(f"the loss differential of {model_a} and {model_b} does not vary")
    return row


def both_ways(rows: DataFrame, signed: list[str]) -> DataFrame:
    """Rows of unordered pairs (model_a, model_b) in both directions; `signed` columns change their sign."""
    turned = {"model_a": F.col("model_b"), "model_b": F.col("model_a")} | {c: -F.col(c) for c in signed}
    pair = F.array(F.struct(*rows.columns), F.struct(*[turned.get(c, F.col(c)).alias(c) for c in rows.columns]))
    return rows.select(F.inline(pair))


def _unordered(losses: DataFrame, horizon: int) -> DataFrame:
    """Pairs with model_a < model_b from their daily differences: population variance plus Bartlett-weighted autocovariances up to horizon - 1.

    The losses of one date (a row a model) meet in one aggregate, so they are read once.
    """
    daily = losses.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("model", "loss"))).alias("l"))
    later = lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x["model"].alias("model_a"), y["model"].alias("model_b"), (x["loss"] - y["loss"]).alias("d")))
    d = daily.select("date", F.inline(F.flatten(F.transform("l", later))))
    pair, order = Window.partitionBy("model_a", "model_b"), Window.partitionBy("model_a", "model_b").orderBy("date")
    d = d.withColumn("c", F.col("d") - F.avg("d").over(pair))
    lags = [F.col("c") * F.lag("c", k).over(order) for k in range(1, horizon)]
    d = d.select("model_a", "model_b", "d", "c", *[x.alias(f"c{k}") for k, x in enumerate(lags, 1)])
    var = F.avg(F.col("c") * F.col("c"))
    for k in range(1, horizon):
        var = var + 2 * (1 - k / horizon) * F.sum(f"c{k}") / F.count("*")
    n = F.count("*")
    rows = d.groupBy("model_a", "model_b").agg(n.alias("n"), F.avg("d").alias("mean"), var.alias("v"))
    h = horizon
    factor = F.sqrt((F.col("n") + 1 - 2 * h + F.lit(h * (h - 1)) / F.col("n")) / F.col("n"))
    stat = F.try_divide(F.col("mean"), F.sqrt(F.when(F.col("v") > 1e-30, F.col("v")) / F.col("n"))) * factor
    return rows.select("model_a", "model_b", stat.alias("statistic"), (F.col("n") - 1).alias("df"), F.col("mean").alias("mean_loss_differential"))


def holm(rows: DataFrame, p: str = "p_value", out: str = "p_value_holm") -> DataFrame:
    """Adds step-down adjusted p-values over all rows (one family, a table of tests); null p stays null."""
    family = Window.partitionBy(F.lit(1)).orderBy(F.col(p).asc_nulls_last())
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    scaled = F.col(p) * (m - F.row_number().over(family) + 1)
    return rows.withColumn("scaled_", scaled).withColumn(out, F.least(F.lit(1.0), F.max("scaled_").over(family.rowsBetween(Window.unboundedPreceding, 0)))).drop("scaled_")


def dm_matrix(predictions: DataFrame, horizon: int = 1) -> DataFrame:
    """All ordered pairs with p-values, Holm-adjusted over the unordered ones; identical pairs get p = 1."""
    rows = _unordered(daily_losses(predictions), horizon)
    rows = rows.withColumn("p_value", F.coalesce(t_p(F.col("statistic"), F.col("df")), F.lit(1.0))).withColumn("identical", F.col("statistic").isNull())
    return both_ways(holm(rows), ["statistic", "mean_loss_differential"])


#: Rows that pairwise slopes are taken of at most.
MOST_POINTS = 10_000


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n): the correlation of tie-averaged ranks."""
    one = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("all_", F.lit(1))
    ranked = average_rank(average_rank(one, x, "rx", ["all_"]), y, "ry", ["all_"])
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.agg(rho.alias("rho"), F.count("*").alias("n"))


def rank_association(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, p_value, slope, intercept, n): Spearman with its t approximation and the Theil-Sen line.

    Pairwise slopes are for tables of folds, not of facts: more than MOST_POINTS rows, fewer than three
    or a column without variance are refused.
    """
    n, nx, ny = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*"), F.count_distinct(x), F.count_distinct(y)).first()
    if not 3 <= n <= MOST_POINTS or min(nx, ny) < 2:
        raise EvaluationError(f"{n} points with {nx} and {ny} different values: no rank association")
    pts = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a, b = pts.alias("a"), pts.alias("b")
    slopes = a.join(b, F.col("a.x") < F.col("b.x")).select(((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("s"))
    slope = slopes.agg(F.median("s").alias("slope"))
    mid = pts.agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    r = spearman(rows, x, y).crossJoin(slope).crossJoin(mid)  # single rows
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return r.select("rho", t_p(t, F.col("n") - 2).alias("p_value"), "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "n")
