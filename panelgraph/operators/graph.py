"""Rolling correlations as edge lists and the graphs they induce.

An edge list keeps i < j once per date, so symmetry and the diagonal are structural. The pair join
is an equi join on the position with a residual on the order; the windows need one exchange on the
pair. Correlation is computed from centred moments of each frame, never from differences of
running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(returns: DataFrame) -> DataFrame:
    """(pos, date, i, j, x, y): the two returns of every pair i < j on every date."""
    a = returns.select("pos", "date", F.col("asset_ix").alias("i"), F.col("r").alias("x"))
    b = returns.select("pos", F.col("asset_ix").alias("j"), F.col("r").alias("y"))
    return a.join(b, "pos").where("i < j")


def rolling_correlation(returns: DataFrame, window: int) -> DataFrame:
    """(pos, date, i, j, rho) of full windows, dated by their end; null for a constant series."""
    w = Window.partitionBy("i", "j").orderBy("pos").rowsBetween(-(window - 1), 0)
    rho = F.try_divide(F.covar_pop("x", "y").over(w), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w))
    rows = pairs(returns).select("pos", "date", "i", "j", rho.alias("rho"), F.count("*").over(w).alias("n"))
    return rows.where(F.col("n") == window).drop("n")


def distance(rho: Column) -> Column:
    return F.sqrt(2 * (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))))


def weighted(edges: DataFrame, tau: float) -> DataFrame:
    """Adds d (distance), w (weight in [0, 1]) and w_tau (w where rho > tau, strictly and signed; else 0)."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 2))
    return edges.withColumn("d", distance(F.col("rho"))).withColumn("w", w).withColumn("w_tau", F.when(F.col("rho") > tau, F.col("w")).otherwise(0.0))


def edge_violations(edges: DataFrame) -> DataFrame:
    """(check, n) over rho, w and w_tau; all zero for sound edges."""
    row = edges.agg(
        F.count_if(F.col("rho").isNull()).alias("rho_null"),
        F.count_if(F.abs("rho") > 1 + 1e-6).alias("rho_outside"),
        F.count_if((F.col("w") < 0) | (F.col("w") > 1)).alias("w_outside"),
        F.count_if(F.col("i") >= F.col("j")).alias("not_upper"),
    )
    return row.unpivot([], row.columns, "check", "n")


def mirrored(edges: DataFrame, weight: str) -> DataFrame:
    """(pos, i, j, w) of both directions of every edge."""
    w = F.col(weight).alias("w")
    there, back = F.struct("i", "j", w), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), w)
    return edges.select("pos", F.inline(F.array(there, back)))


def adjacency(edges: DataFrame, weight: str) -> DataFrame:
    """(pos, i, j, a): D^-1/2 (W + I) D^-1/2 of every date, with its diagonal.

    The edges are read and exchanged once, by date; W is symmetric, so the sums over i and over j are
    the two degrees. The self loop of i goes with its first edge and makes its degree at least 1.
    """
    both = mirrored(edges, weight).repartition("pos")
    of_i, of_j = Window.partitionBy("pos", "i"), Window.partitionBy("pos", "j")
    both = both.withColumn("deg_j", 1 + F.sum("w").over(of_j)).withColumn("deg", 1 + F.sum("w").over(of_i)).withColumn("k", F.row_number().over(of_i.orderBy("j")))
    edge = F.struct("j", F.try_divide("w", F.sqrt(F.col("deg") * F.col("deg_j"))).alias("a"))
    loop = F.struct(F.col("i").alias("j"), F.try_divide(F.lit(1.0), F.col("deg")).alias("a"))
    return both.select("pos", "i", F.inline(F.when(F.col("k") == 1, F.array(edge, loop)).otherwise(F.array(edge))))


def degrees(edges: DataFrame, weight: str = "w_tau") -> DataFrame:
    """(pos, i, degree): row sums of the weights."""
    return mirrored(edges, weight).groupBy("pos", "i").agg(F.sum("w").alias("degree"))


def isolated_windows(edges: DataFrame) -> DataFrame:
    """(n): dates on which some node has no edge above the threshold."""
    by = degrees(edges).groupBy("pos").agg(F.bool_or(F.col("degree") == 0).alias("alone"))
    return by.agg(F.count_if("alone").alias("n"))


def edge_topology(edges: DataFrame) -> DataFrame:
    """(pos, date, mean_correlation, graph_density)."""
    return edges.groupBy("pos", "date").agg(F.avg("rho").alias("mean_correlation"), F.avg((F.col("w_tau") != 0).cast("double")).alias("graph_density"))


def densities(edges: DataFrame, taus: dict[str, float]) -> DataFrame:
    """(pos, one density a named threshold), in one pass."""
    return edges.groupBy("pos").agg(*[F.avg((F.col("rho") > F.lit(t)).cast("double")).alias(name) for name, t in taus.items()])


def density_at(edges: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, pos, density) for any thresholds in one pass."""
    shares = [F.struct(F.lit(t).alias("tau"), F.avg((F.col("rho") > t).cast("double")).alias("density")) for t in taus]
    return edges.groupBy("pos").agg(F.array(*shares).alias("s")).select("pos", F.inline("s"))


def density_summary(topology: DataFrame, column: str = "graph_density") -> DataFrame:
    """mean, min, max and population sd of a density."""
    c = F.col(column)
    return topology.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("sd"))


def marchenko_pastur(x: Column, q: float) -> Column:
    """The limiting eigenvalue density of pure noise with ratio q; 0 outside its support."""
    lo, hi = (1 - q**0.5) ** 2, (1 + q**0.5) ** 2
    inside = (x > lo) & (x < hi)
    return F.when(inside, F.sqrt((hi - x) * (x - lo)) / (2 * 3.141592653589793 * q * x)).otherwise(0.0)
