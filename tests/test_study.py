import numpy as np
import pytest

from panelgraph.config import ModelConfig, StudyConfig
from panelgraph.operators import models, spectral
from panelgraph.plans.queries import QUERIES
from panelgraph.plans.study import Study

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def test_queries_run_the_study_s_whole_settings(spark, monkeypatch):
    seen = {}

    def spy(module, name):
        real = getattr(module, name)

        def f(*args, **kw):
            seen[name] = args, kw
            return real(*args, **kw)

        monkeypatch.setattr(module, name, f)

    spy(models, "graph_forecasts"), spy(spectral, "threshold_null"), spy(models, "autoregressions")
    for name in ("md8_graph_network", "ts7_permutation_null", "md4_var_fixed"):
        QUERIES[name](spark, SMALL)
    assert seen["graph_forecasts"][0][5:9] == ([(16, 0.2), (16, 0.5), (32, 0.2), (32, 0.5)], 5, True, 300)
    assert seen["threshold_null"][0][1:] == (20, 24, 500, 0.05, 42)
    assert seen["autoregressions"][1]["order"] == 5


def test_graphs_are_thresholded_at_the_calibrated_tau(spark):
    tau = QUERIES["ts8_threshold"](spark, MEDIUM).first()["tau"]
    study = Study(spark, MEDIUM)
    assert study.tau == pytest.approx(tau, abs=1e-6) and study.tau != study.config.graph.tau
    rows = study.edges.select("rho", "w_tau", "w").collect()
    assert rows and all(r.w_tau == (r.w if r.rho is not None and r.rho > study.tau else 0) for r in rows)
    assert Study(spark, MEDIUM, plain=True).tau == study.config.graph.tau
    assert QUERIES["gr3_threshold_whole"](spark, MEDIUM).count() == sum(r.w_tau > 0 for r in rows)
    assert QUERIES["gr3_threshold"](spark, MEDIUM).count() == sum(r.rho is not None and r.rho > 0.2 and r.w > 0 for r in rows)


def test_all_seven_models_are_compared(spark):
    study = Study(spark, MEDIUM, StudyConfig(models=ModelConfig(hidden=(2,), dropout=(0.2,), seeds=1, epochs=2)))
    rows = {r["model"]: r["count"] for r in study.predictions.groupBy("model").count().collect()}
    assert set(rows) == {"zero", "mean", "ar", "var-bic", "var-p5", "gcn", "gcn-nograph"} and len(set(rows.values())) == 1


def test_the_sign_gate_reports_assets_without_a_common_mode(spark):
    """At sf0.01 the mean correlation is about 0, so that both signs are the other way round."""
    got = {r.metric: r for r in QUERIES["prj12_sign_gate"](spark, MEDIUM).collect()}
    study = Study(spark, MEDIUM)
    t = study.topology.join(study.spectra.drop("date"), "pos").toPandas()
    for c in ("market_mode_share", "spectral_entropy"):
        assert abs(got[c].rho - np.corrcoef(t[c].rank(), t.mean_correlation.rank())[0, 1]) < 1e-6
        assert not got[c].passes and got[c].n_undefined == 0
    assert got["market_mode_share"].rho < 0 < got["spectral_entropy"].rho
