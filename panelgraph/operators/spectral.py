"""Matrix measures of dated graphs: spectra, connectivity, spanning trees, orderings.

The edge list of a date is packed into one array and matrices are built inside Arrow batches, one
decomposition per date; dates are independent, so this scales with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgraph.errors import GraphError
from panelgraph.operators.evaluation import spearman

COLUMNS = "pos int, date date, algebraic_connectivity double, algebraic_connectivity_combinatorial double, mst_length double, spectral_entropy double, market_mode_share double, eigs_outside_mp int, eigenvalues array<double>"


def symmetric(upper: np.ndarray, n: int, diagonal: float) -> np.ndarray:
    """(k, n, n) matrices from packed upper triangles (k, n(n-1)/2)."""
    out = np.zeros((len(upper), n, n))
    i, j = np.triu_indices(n, 1)
    out[:, i, j] = upper
    out[:, j, i] = upper
    out[:, np.arange(n), np.arange(n)] = diagonal
    return out


def laplacian_connectivity(w: np.ndarray, normalised: bool) -> np.ndarray:
    """The second smallest eigenvalue of I - D^-1/2 W D^-1/2, or of D - W."""
    deg = w.sum(axis=2)
    if normalised:
        s = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
        lap = np.eye(w.shape[1]) - s[:, :, None] * w * s[:, None, :]
    else:
        lap = np.zeros_like(w)
        k = np.arange(w.shape[1])
        lap[:, k, k] = deg
        lap = lap - w
    return np.linalg.eigvalsh(lap)[:, 1]


def spanning_length(d: np.ndarray) -> np.ndarray:
    """Mean edge length of the minimum spanning tree; grows one tree per matrix, all matrices at once."""
    k, n, _ = d.shape
    rows, inside, best, total = np.arange(k), np.zeros((k, n), bool), d[:, 0, :].copy(), np.zeros(k)
    inside[:, 0] = True
    for _ in range(n - 1):
        at = np.where(inside, np.inf, best).argmin(axis=1)
        total += best[rows, at]
        inside[rows, at] = True
        best = np.minimum(best, d[rows, at, :])
    return total / (n - 1)


def entropy(eigs: np.ndarray) -> np.ndarray:
    p = np.clip(eigs, 0, None)
    p = p / p.sum(axis=1, keepdims=True)
    return -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)


def spectral_topology(edges: DataFrame, window: int) -> DataFrame:
    """One row a date with the spectral and tree measures and the eigenvalues of its correlations."""
    packed = edges.groupBy("pos", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "rho"))), lambda x: x["rho"]).alias("rho"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            upper = np.stack(b["rho"].to_numpy())
            n = int((1 + (1 + 8 * upper.shape[1]) ** 0.5) / 2)
            corr = symmetric(upper, n, 1.0)
            dist = np.sqrt(2 * (1 - np.clip(corr, -1, 1)))
            w = np.clip(1 - dist / 2, 0, 1) * (1 - np.eye(n))
            eigs = np.linalg.eigvalsh(corr)
            edge = (1 + (n / window) ** 0.5) ** 2
            yield pd.DataFrame({
                "pos": b["pos"], "date": b["date"],
                "algebraic_connectivity": laplacian_connectivity(w, True),
                "algebraic_connectivity_combinatorial": laplacian_connectivity(w, False),
                "mst_length": spanning_length(dist), "spectral_entropy": entropy(eigs),
                "market_mode_share": eigs[:, -1] / eigs.sum(axis=1), "eigs_outside_mp": (eigs > edge).sum(axis=1).astype("int32"),
                "eigenvalues": list(eigs),
            })

    return packed.mapInPandas(run, COLUMNS)


def regime_spectra(spectral: DataFrame, topology: DataFrame, width: float = 0.1) -> DataFrame:
    """(regime, bin, n): histogram of eigenvalues on the calmest and the most correlated tenth of dates."""
    cuts = topology.agg(F.percentile("mean_correlation", F.lit(0.1)).alias("lo"), F.percentile("mean_correlation", F.lit(0.9)).alias("hi"))
    rows = topology.select("pos", "mean_correlation").crossJoin(F.broadcast(cuts))  # one row
    rows = rows.withColumn("regime", F.when(F.col("mean_correlation") <= F.col("lo"), "low").when(F.col("mean_correlation") >= F.col("hi"), "high")).where("regime is not null")
    eigs = spectral.select("pos", F.explode("eigenvalues").alias("e")).join(rows, "pos")
    return eigs.groupBy("regime", F.floor(F.col("e") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def hierarchical_order(mean_corr: np.ndarray) -> list[int]:
    """Leaf order of average linkage on the distances of a mean correlation matrix."""
    n = len(mean_corr)
    d = np.sqrt(2 * (1 - np.clip(mean_corr, -1, 1)))
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        keys = list(groups)
        a, b = min(((x, y) for k, x in enumerate(keys) for y in keys[k + 1 :]), key=lambda p: (d[np.ix_(groups[p[0]], groups[p[1]])].mean(), p))
        groups[n] = groups.pop(a) + groups.pop(b)
        n += 1
    return next(iter(groups.values()))


def asset_order(edges: DataFrame) -> DataFrame:
    """(rank, asset_ix) of the time-mean correlations; only the N x N mean reaches the driver."""
    mean = edges.groupBy("i", "j").agg(F.avg("rho").alias("rho")).toPandas().sort_values(["i", "j"])
    n = int(mean["j"].max()) + 1
    order = hierarchical_order(symmetric(mean["rho"].to_numpy()[None, :], n, 1.0)[0])
    return edges.sparkSession.createDataFrame(list(enumerate(order)), "rank int, asset_ix int")


def permutation_null(block: np.ndarray, replicas: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pooled correlations and per-replica maxima of a window whose columns are shuffled independently."""
    t, n = block.shape
    if replicas < 1 or n < 2:
        raise ValueError("a permutation null needs a replica and two columns")
    i, j = np.triu_indices(n, 1)
    x = rng.permuted(np.broadcast_to(block, (replicas, t, n)), axis=1)
    x = x - x.mean(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rho = np.einsum("rti,rtj->rij", x, x)[:, i, j]
    return rho.ravel(), np.fmax.reduce(rho, axis=1)


def _quantile(x: np.ndarray, q: float) -> float:
    """The quantile of the defined values; pairs with a constant series have none."""
    x = x[np.isfinite(x)]
    return float(np.quantile(x, q)) if x.size else float("nan")


def threshold_null(returns: DataFrame, window: int, windows: int, replicas: int, alpha: float, seed: int) -> DataFrame:
    """(window_ix, end_pos, tau, tau_fwer): the (1 - alpha) quantiles of evenly spaced windows' nulls.

    Windows are independent tasks with generators seeded by (seed, window_ix).
    """
    last = returns.agg(F.max("pos")).first()[0] + 1
    starts = [int(np.rint(x)) for x in np.linspace(0, last - window, windows)]
    ix = returns.sparkSession.createDataFrame([(k, s) for k, s in enumerate(starts)], "window_ix int, start int")
    rows = returns.join(F.broadcast(ix), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + window))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        block = p.pivot(index="pos", columns="asset_ix", values="r").to_numpy()
        pooled, top = permutation_null(block, replicas, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame([(int(key[0]), int(p["pos"].max()), _quantile(pooled, 1 - alpha), _quantile(top, 1 - alpha))], columns=["window_ix", "end_pos", "tau", "tau_fwer"])

    return rows.groupBy("window_ix").applyInPandas(run, "window_ix int, end_pos int, tau double, tau_fwer double")


def calibrated(null: DataFrame) -> DataFrame:
    """(tau, tau_fwer, n_windows): medians across windows."""
    return null.agg(F.median("tau").alias("tau"), F.median("tau_fwer").alias("tau_fwer"), F.count("*").alias("n_windows"))


def plausible(tau: float, low: float = 0.10, high: float = 0.40) -> float:
    """tau, if it lies inside the open interval; else a GraphError."""
    if not low < tau < high:
        raise GraphError(f"threshold {tau} is not between {low} and {high}")
    return tau


def threshold_record(null: DataFrame, config) -> DataFrame:
    """One row: the calibrated thresholds with the settings they come from."""
    parts = {"alpha": config.alpha, "permutations": config.permutations, "window": config.window, "seed": config.seed}
    return calibrated(null).select("*", *[F.lit(v).alias(k) for k, v in parts.items()])


def signs(topology: DataFrame) -> DataFrame:
    """(metric, rho, n_undefined, passes) against the mean correlation: what sign_gate judges, without its refusal.

    The market mode's share should not fall and the spectral entropy not rise with the mean correlation, and
    each date should have all three. rho is over the dates that have; without variance it is null and passes.
    """
    wanted = {"market_mode_share": 1.0, "spectral_entropy": -1.0}
    undefined = " or ".join(f"{c} is null or isnan({c})" for c in (*wanted, "mean_correlation"))
    bad = topology.where(undefined).count()
    rhos = {c: spearman(topology.where(f"not ({undefined})"), c, "mean_correlation").first()["rho"] for c in wanted}
    rows = [(c, rhos[c], bad, not bad and (rhos[c] is None or sign * rhos[c] >= 0)) for c, sign in wanted.items()]
    return topology.sparkSession.createDataFrame(rows, "metric string, rho double, n_undefined long, passes boolean")


def sign_gate(topology: DataFrame) -> DataFrame:
    """(metric, rho) against the mean correlation; a GraphError if the market mode's share falls or the entropy rises with it.

    Either means that an eigenvalue series is inverted, or that the assets have no common mode. A value that is no number is refused too.
    """
    found = signs(topology)
    rows = found.collect()  # two rows
    if rows[0]["n_undefined"]:
        raise GraphError(f"{rows[0]['n_undefined']} dates have a metric without a value")
    if wrong := [r["metric"] for r in rows if not r["passes"]]:
        raise GraphError(f"unexpected sign against the mean correlation: {wrong}")
    return found.select("metric", "rho")
