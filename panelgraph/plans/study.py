"""The study as composed plans: from a trade table to bars, graphs, folds, forecasts and a backtest."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from panelgraph.config import StudyConfig
from panelgraph.operators import backtest, evaluation, events, features, graph, models, panel, spectral

#: Dated events inside the sample, as fixed values.
EVENTS = [
    ("alpha", datetime.date(1997, 3, 3), "Alpha", "first dated event", "ref-1"),
    ("beta", datetime.date(1998, 8, 17), "Beta", "second dated event", ""),
    ("gamma", datetime.date(2000, 4, 10), "Gamma", "third dated event", "ref-3"),
]
FEATURES = ["r_lag0", "r_lag1", "r_lag2", "r_lag3", "r_lag4", "rv_5", "rv_20", "logvol_z_20"]
OFFSETS = (-56, -28, 0, 28, 56)


@dataclass
class Study:
    """Lazily built tables of one run; each property is a plan, and nothing is computed twice in one query."""

    spark: SparkSession
    sf_dir: str
    config: StudyConfig = StudyConfig()
    #: The variant that SQL can state: the constant tau of the settings, and the three forecasts that are plain aggregates.
    plain: bool = False

    @cached_property
    def bars(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        return panel.bars(rows, self.config.panel.unit, self.config.panel.assets).persist()

    @cached_property
    def panel(self) -> DataFrame:
        return panel.panel(self.bars)

    @cached_property
    def returns(self) -> DataFrame:
        return panel.log_returns(self.panel)

    @cached_property
    def null(self) -> DataFrame:
        g = self.config.graph
        return spectral.threshold_null(self.returns, g.window, g.calibration_windows, g.permutations, g.alpha, g.seed)

    @cached_property
    def tau(self) -> float:
        """The calibrated threshold, one number on the driver; the constant of the settings in the plain variant."""
        return self.config.graph.tau if self.plain else spectral.calibrated(self.null).first()["tau"]

    @cached_property
    def edges(self) -> DataFrame:
        return graph.weighted(graph.rolling_correlation(self.returns, self.config.graph.window), self.tau).persist()

    @cached_property
    def thresholds(self) -> dict[str, float]:
        """The named thresholds beside the one of the graph: family-wise and constant."""
        row = spectral.calibrated(self.null).first()  # one row
        return {"graph_density_fwer": row["tau_fwer"], "graph_density_fixed": self.config.graph.tau}

    @cached_property
    def topology(self) -> DataFrame:
        return graph.edge_topology(self.edges)

    @cached_property
    def spectra(self) -> DataFrame:
        return spectral.spectral_topology(self.edges, self.config.graph.window)

    @cached_property
    def adjacency(self) -> DataFrame:
        return graph.adjacency(self.edges, "w_tau")

    @cached_property
    def events(self) -> DataFrame:
        return events.event_table(self.spark, EVENTS)

    @cached_property
    def features(self) -> DataFrame:
        return features.node_features(self.returns, self.config.features)

    @cached_property
    def folds(self) -> DataFrame:
        n = self.returns.selectExpr("max(pos) + 1 AS n").first()[0]
        return features.folds(self.spark, features.fold_layout(n, self.config.graph.window - 1, self.config.folds))

    @cached_property
    def positions(self) -> DataFrame:
        return features.fold_positions(self.folds)

    @cached_property
    def targets(self) -> DataFrame:
        return features.targets(self.returns, self.config.folds.horizon)

    @cached_property
    def tests(self) -> DataFrame:
        return models.test_rows(self.targets, self.positions)

    @cached_property
    def train(self) -> DataFrame:
        return models.train_rows(self.returns, self.positions)

    @cached_property
    def predictions(self) -> DataFrame:
        """zero, mean and ar1 in the plain variant; else the seven models that are compared, fitted once."""
        out = models.zero(self.tests).unionByName(models.mean(self.tests, self.train))
        if self.plain:
            return out.unionByName(models.ar1(self.tests, self.train)).persist()
        lags = self.returns, self.tests, self.positions
        for more in (models.autoregressions(*lags)[0], models.autoregressions(*lags, joint=True, name="var-bic")[0], self.var_fixed(), self.network(True)[0], self.network(False)[0]):
            out = out.unionByName(more)
        return out.persist()

    def var_fixed(self) -> DataFrame:
        p = self.config.models.fixed_lag
        return models.autoregressions(self.returns, self.tests, self.positions, order=p, joint=True, name=f"var-p{p}")[0]

    def network(self, use_graph: bool) -> tuple[DataFrame, DataFrame]:
        m = self.config.models
        x = features.standardised(self.features, self.positions, FEATURES)
        grid = [(h, d) for h in m.hidden for d in m.dropout]
        return models.graph_forecasts(x, FEATURES, self.targets, self.adjacency, self.positions, grid, m.seeds, use_graph, m.epochs, "gcn" if use_graph else "gcn-nograph")

    @cached_property
    def dm(self) -> DataFrame:
        return evaluation.dm_matrix(self.predictions)

    @cached_property
    def curves(self) -> DataFrame:
        return backtest.curves(self.predictions, self.config.costs_bps)

    @cached_property
    def backtest(self) -> DataFrame:
        return backtest.summary(self.curves, self.config.periods)

    @cached_property
    def event_study(self) -> DataFrame:
        return events.event_study(self.topology, ["mean_correlation", "graph_density"], self.events, OFFSETS)
