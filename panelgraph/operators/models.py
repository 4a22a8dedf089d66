"""Forecasters over walk-forward folds.

Zero, historical mean and AR(1) are plain aggregates. AR(p), VAR(p) and the graph network fit per
group in Arrow batches; folds, assets, grid cells and seeds are independent tasks. A model sees
the rows of its training and validation blocks, and for a forecast only what is known at its origin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTIONS = "fold int, date date, asset string, y_true double, y_pred double, model string"


def test_rows(targets: DataFrame, positions: DataFrame) -> DataFrame:
    """(fold, pos, date, asset, r, y_true): the origins of the test blocks; date is the target's."""
    return targets.join(positions.where("split = 'test'"), "pos").select("fold", "pos", F.col("target_date").alias("date"), "asset", "r", F.col("y").alias("y_true"))


def zero(tests: DataFrame) -> DataFrame:
    return tests.select("fold", "date", "asset", "y_true", F.lit(0.0).alias("y_pred"), F.lit("zero").alias("model"))


def train_rows(returns: DataFrame, positions: DataFrame) -> DataFrame:
    return returns.join(positions.where("split = 'train'"), "pos").select("fold", "asset", "pos", "r")


def mean(tests: DataFrame, train: DataFrame) -> DataFrame:
    level = train.groupBy("fold", "asset").agg(F.avg("r").alias("y_pred"))
    return tests.join(level, ["fold", "asset"]).select("fold", "date", "asset", "y_true", "y_pred", F.lit("mean").alias("model"))


def ar1(tests: DataFrame, train: DataFrame) -> DataFrame:
    """First-order autoregression with a constant by least squares, as one aggregate."""
    lagged = train.select("fold", "asset", (F.col("pos") + 1).alias("pos"), F.col("r").alias("x"))
    fit = train.join(lagged, ["fold", "asset", "pos"]).groupBy("fold", "asset").agg(F.covar_pop("x", "r").alias("c"), F.var_pop("x").alias("v"), F.avg("r").alias("my"), F.avg("x").alias("mx"))
    phi = F.coalesce(F.try_divide("c", "v"), F.lit(0.0))
    fit = fit.select("fold", "asset", phi.alias("phi"), (F.col("my") - phi * F.col("mx")).alias("const"))
    return tests.join(fit, ["fold", "asset"]).select("fold", "date", "asset", "y_true", (F.col("const") + F.col("phi") * F.col("r")).alias("y_pred"), F.lit("ar1").alias("model"))


def _design(x: np.ndarray, p: int, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Constant and p lags of a (T, N) block, and what they explain, with `hold` first rows held back."""
    t = len(x)
    cols = [np.ones((t - hold, 1))] + [x[hold - k : t - k] for k in range(1, p + 1)]
    return np.hstack(cols), x[hold:]


def select_order(x: np.ndarray, most: int) -> int:
    """The order with the least BIC; candidates share the sample that the largest one leaves."""
    best, out = np.inf, 0
    for p in range(most + 1):
        a, y = _design(x, p, most)
        e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        n, k = y.shape
        sign, logdet = np.linalg.slogdet(e.T @ e / n)
        bic = (n * logdet if sign > 0 else -np.inf) + k * (k * p + 1) * np.log(n)
        if bic < best - 1e-9:
            best, out = bic, p
    return out


def fit_var(x: np.ndarray, p: int) -> np.ndarray:
    a, y = _design(x, p, p)
    return np.linalg.lstsq(a, y, rcond=None)[0]


def forecast_var(coef: np.ndarray, history: np.ndarray, p: int) -> np.ndarray:
    """One step ahead of a (T, N) history that ends at the origin."""
    return np.concatenate([[1.0], *[history[-k] for k in range(1, p + 1)]]) @ coef


def autoregressions(returns: DataFrame, tests: DataFrame, positions: DataFrame, most: int = 5, order: int | None = None, joint: bool = False, name: str = "ar") -> tuple[DataFrame, DataFrame]:
    """Predictions and diagnostics (fold, asset, lag_order, n_params) of AR (per asset) or VAR (joint) models.

    order fixes the lags, else BIC selects up to `most`. A fold's rows from its training start to
    its last test origin travel to one task (an asset of it for AR).
    """
    span = positions.groupBy("fold").agg(F.min(F.when(F.col("split") == "train", F.col("pos"))).alias("a"), F.max(F.when(F.col("split") == "train", F.col("pos"))).alias("b"), F.max("pos").alias("c"))
    rows = returns.select("pos", "asset", "r").join(F.broadcast(span), (F.col("pos") >= F.col("a")) & (F.col("pos") <= F.col("c")))  # a row a fold
    rows = rows.join(tests.select("fold", "pos", "asset", "date", "y_true"), ["fold", "pos", "asset"], "left")
    schema = PREDICTIONS + ", lag_order int, n_params int"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        wide = p.pivot(index="pos", columns="asset", values="r").sort_index()
        x, pos = wide.to_numpy(), wide.index.to_numpy()
        train = x[(pos >= p["a"].iloc[0]) & (pos <= p["b"].iloc[0])]
        k = order if order is not None else select_order(train, most)
        coef = fit_var(train, k)
        at = {v: i for i, v in enumerate(pos)}
        out = p[p["date"].notna()].sort_values(["pos", "asset"])
        col = {c: i for i, c in enumerate(wide.columns)}
        made = {v: forecast_var(coef, x[: at[v] + 1], k) for v in out["pos"].unique()}
        return pd.DataFrame({"fold": out["fold"], "date": out["date"], "asset": out["asset"], "y_true": out["y_true"], "y_pred": [made[v][col[c]] for v, c in zip(out["pos"], out["asset"], strict=True)], "model": name, "lag_order": k, "n_params": coef.size})

    done = rows.groupBy("fold", *([] if joint else ["asset"])).applyInPandas(run, schema)
    diag = done.groupBy("fold", "asset").agg(F.first("lag_order").alias("lag_order"), F.first("n_params").alias("n_params"))
    return done.drop("lag_order", "n_params"), diag


class GraphNetwork:
    """Two graph convolutions H' = A (H W) + b with a ReLU between, dropout on inputs, and Adam, in numpy."""

    def __init__(self, width: int, hidden: int, dropout: float, rng: np.random.Generator) -> None:
        glorot = lambda a, b: rng.uniform(-1, 1, (a, b)).astype(np.float32) * np.float32((6 / (a + b)) ** 0.5)
        self.p = [glorot(width, hidden), np.zeros(hidden, np.float32), glorot(hidden, 1), np.zeros(1, np.float32)]
        self.dropout, self.rng = dropout, rng
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def forward(self, a: np.ndarray, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, tuple]:
        """x (B, N, F) and a (B, N, N) to forecasts (B, N)."""
        w1, b1, w2, b2 = self.p
        keep = 1 - self.dropout
        d1 = (self.rng.random(x.shape) < keep).astype(np.float32) / np.float32(keep) if train and self.dropout else 1.0
        x = x * d1
        z = a @ (x @ w1) + b1
        h = np.maximum(z, 0)
        d2 = (self.rng.random(h.shape) < keep).astype(np.float32) / np.float32(keep) if train and self.dropout else 1.0
        g = h * d2
        return (a @ (g @ w2) + b2)[..., 0], (a, x, z, g, d2)

    def gradients(self, out: np.ndarray, y: np.ndarray, cache: tuple) -> list[np.ndarray]:
        a, x, z, g, d2 = cache
        e = (2 * (out - y) / y.size)[..., None]
        back = np.swapaxes(a, 1, 2) @ e
        w2 = np.einsum("bnh,bno->ho", g, back)
        dz = (back @ self.p[2].T) * d2 * (z > 0)
        back1 = np.swapaxes(a, 1, 2) @ dz
        return [np.einsum("bnf,bnh->fh", x, back1), dz.sum((0, 1)), w2, e.sum((0, 1))]

    def step(self, grads: list[np.ndarray], rate: float, decay: float) -> None:
        self.t += 1
        for k, g in enumerate(grads):
            g = g + decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = (self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)

    def fit(self, train: tuple, val: tuple, epochs: int = 300, patience: int = 30, rate: float = 0.005, decay: float = 5e-4) -> float:
        """Full-batch training; the weights with the least validation error are kept. Returns that error."""
        best, kept, since = np.inf, [p.copy() for p in self.p], 0
        for _ in range(epochs):
            out, cache = self.forward(train[0], train[1], True)
            self.step(self.gradients(out, train[2], cache), rate, decay)
            loss = float(np.mean((self.forward(val[0], val[1])[0] - val[2]) ** 2))
            if loss < best:
                best, kept, since = loss, [p.copy() for p in self.p], 0
            elif (since := since + 1) >= patience:
                break
        self.p = kept
        return best


def graph_forecasts(features: DataFrame, columns: list[str], targets: DataFrame, adjacency: DataFrame, positions: DataFrame, grid: list[tuple[int, float]], seeds: int = 5, use_graph: bool = True, epochs: int = 300, name: str = "gcn") -> tuple[DataFrame, DataFrame]:
    """Predictions and (fold, hidden, dropout, val_mse) of a seed-averaged network selected per fold.

    features must be standardised per fold. Each (fold, seed) is a task that fits all configurations, so
    a fold travels once a seed; averaging over seeds and the choice of the configuration are DataFrame
    aggregates.
    """
    spark = features.sparkSession
    edge = adjacency.groupBy("pos", F.col("i").alias("asset_ix")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "a"))), lambda s: s["a"]).alias("a"))
    rows = features.select("fold", "split", "pos", "asset", F.array(*columns).alias("x")).join(targets.select("pos", "asset", "asset_ix", "y", "target_date"), ["pos", "asset"]).join(edge, ["pos", "asset_ix"])
    cells = spark.range(seeds).select(F.col("id").cast("int").alias("seed"))
    schema = "fold int, cell int, hidden int, dropout double, split string, date date, asset string, y_true double, pred double"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["pos", "asset_ix"])
        n = p["asset_ix"].nunique()
        part = {}
        for split, q in p.groupby("split"):
            x = np.stack(q["x"].to_numpy()).astype(np.float32).reshape(-1, n, len(columns))
            a = np.stack(q["a"].to_numpy()).astype(np.float32).reshape(-1, n, n)
            part[split] = [a if use_graph else np.broadcast_to(np.eye(n, dtype=np.float32), a.shape), x, q["y"].to_numpy(np.float32).reshape(-1, n)]
        scale = np.float32(part["train"][2].std() or 1.0)
        for v in part.values():
            v[2] = v[2] / scale
        fold, seed = (int(p[c].iloc[0]) for c in ("fold", "seed"))
        out = []
        for cell, (hidden, dropout) in enumerate(grid):
            net = GraphNetwork(len(columns), hidden, float(dropout), np.random.default_rng([seed, fold, cell]))
            net.fit(part["train"], part["val"], epochs)
            for split in ("val", "test"):
                q = p[p["split"] == split]
                pred = net.forward(part[split][0], part[split][1])[0] * scale
                out.append(pd.DataFrame({"fold": fold, "cell": cell, "hidden": hidden, "dropout": float(dropout), "split": split, "date": q["target_date"], "asset": q["asset"], "y_true": q["y"], "pred": pred.reshape(-1).astype(float)}))
        return pd.concat(out)

    made = rows.crossJoin(F.broadcast(cells)).groupBy("fold", "seed").applyInPandas(run, schema)  # a row a seed
    mean_ = made.groupBy("fold", "cell", "hidden", "dropout", "split", "date", "asset").agg(F.first("y_true").alias("y_true"), F.avg("pred").alias("y_pred"))
    error = mean_.where("split = 'val'").groupBy("fold", "cell", "hidden", "dropout").agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2.0))).alias("val_mse"))
    best = error.groupBy("fold").agg(F.min_by("cell", F.struct("val_mse", "cell")).alias("cell"))  # the first wins ties
    out = mean_.where("split = 'test'").join(best, ["fold", "cell"]).select("fold", "date", "asset", "y_true", "y_pred", F.lit(name).alias("model"))
    return out, error.select("fold", "hidden", "dropout", "val_mse")
