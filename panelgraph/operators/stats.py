"""Descriptive statistics, autocorrelation and the gates on stylised facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.functions.tails import chi2_p


def descriptive(returns: DataFrame, periods: int) -> DataFrame:
    """Per asset: mean, annualised volatility (sample), skewness and excess kurtosis (population)."""
    return returns.groupBy("asset").agg(
        F.avg("r").alias("mean"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("volatility_annualized"),
        F.skewness("r").alias("skewness"),
        F.kurtosis("r").alias("excess_kurtosis"),
    )


def acf(returns: DataFrame, lags: int, absolute: bool = False) -> DataFrame:
    """(asset, lag, acf) for lags 0..lags: full-sample mean, no small-sample factor.

    All lags come from one sort per asset: a window of lags, not a self join per lag.
    """
    x = F.abs("r") if absolute else F.col("r")
    whole, order = Window.partitionBy("asset"), Window.partitionBy("asset").orderBy("pos")
    rows = returns.select("asset", "pos", (x - F.avg(x).over(whole)).alias("d"))
    products = [F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(lags + 1)]
    rows = rows.select("asset", "d", *[F.lag("d", k).over(order).alias(f"d{k}") for k in range(lags + 1)])
    sums = rows.groupBy("asset").agg(*products)
    out = sums.select("asset", F.posexplode(F.array(*[F.try_divide(F.coalesce(F.col(f"c{k}"), F.lit(0.0)), F.col("c0")) for k in range(lags + 1)])).alias("lag", "acf"))
    return out


def ljung_box(returns: DataFrame, lags: int, absolute: bool = False) -> DataFrame:
    """Per asset: lb_stat = n (n + 2) sum acf_k^2 / (n - k) and its chi-square upper tail."""
    n = returns.groupBy("asset").agg(F.count("r").alias("n"))
    rows = acf(returns, lags, absolute).where("lag > 0").join(n, "asset")
    q = rows.groupBy("asset", "n").agg((F.first("n") * (F.first("n") + 2) * F.sum(F.try_divide(F.col("acf") * F.col("acf"), F.col("n") - F.col("lag")))).alias("lb_stat"))
    return q.select("asset", "lb_stat", chi2_p(F.col("lb_stat"), F.lit(lags)).alias("lb_pvalue"))


def stylised_gate(desc: DataFrame, acf_r: DataFrame, acf_abs: DataFrame, max_acf1: float = 0.1, min_abs_acf1: float = 0.05, exceptions: dict[str, float] | None = None) -> DataFrame:
    """(asset, check, value) of the assets that lack a stylised fact."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in exceptions.items() for x in kv])[F.col("asset")], F.lit(max_acf1)) if exceptions else F.lit(max_acf1)
    parts = (
        desc.where("excess_kurtosis <= 0").select("asset", F.lit("excess_kurtosis").alias("check"), F.col("excess_kurtosis").alias("value")),
        acf_r.where("lag = 1").where(F.abs("acf") >= limit).select("asset", F.lit("acf1").alias("check"), F.col("acf").alias("value")),
        acf_abs.where("lag = 1").where(F.col("acf") <= min_abs_acf1).select("asset", F.lit("abs_acf1").alias("check"), F.col("acf").alias("value")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, sd, cv, min, median, max) of the columns; sample sd, cv = sd / |mean|."""
    long = rows.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "metric", "value")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.median("value").alias("median"), F.max("value").alias("max"))
    return out.withColumn("cv", F.try_divide("sd", F.abs("mean")))


def average_rank(rows: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """Adds ranks in which ties share their mean rank; windows are partitioned by `by`."""
    order, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return rows.withColumn(out, F.rank().over(order) + (F.count("*").over(same) - 1) / 2)
