import datetime

import numpy as np
import pytest

from panelgraph.config import FeatureConfig, FoldConfig, StudyConfig, config_hash, from_dict
from panelgraph.errors import EvaluationError, FoldError, GraphError, MissingArtifactError, PanelError
from panelgraph.operators import backtest, evaluation, events, features, graph, models, panel, spectral, stats
from panelgraph.sources.store import Store

DAY = datetime.date(2021, 1, 1)


def make_panel(spark, close, volume=None):
    """close: (T, N)."""
    t, n = close.shape
    volume = np.ones_like(close) if volume is None else volume
    rows = [(DAY + datetime.timedelta(days=k), f"A{i}", float(close[k, i]), float(volume[k, i])) for k in range(t) for i in range(n)]
    return panel.panel(spark.createDataFrame(rows, "date date, asset string, close double, volume double"))


def make_returns(spark, r):
    close = np.exp(np.vstack([np.zeros(r.shape[1]), np.cumsum(r, axis=0)]))
    return panel.log_returns(make_panel(spark, close))


def test_returns_are_log_differences_and_drop_the_first_row(spark):
    close = np.array([[1.0, 2.0], [2.0, 1.0], [4.0, 1.0]])
    got = {(r.pos, r.asset): r.r for r in panel.log_returns(make_panel(spark, close)).collect()}
    assert got == pytest.approx({(0, "A0"): np.log(2), (0, "A1"): -np.log(2), (1, "A0"): np.log(2), (1, "A1"): 0.0})


@pytest.mark.parametrize(("spoil", "match"), [("gap", "calendar gaps"), ("cell", "missing cells"), ("price", "prices not positive"), ("volume", "zero volumes")])
def test_a_broken_panel_is_refused_by_name(spark, spoil, match):
    close, volume = np.ones((4, 2)), np.ones((4, 2))
    close[1, 0] = -1 if spoil == "price" else 1
    volume[1, 0] = 0 if spoil == "volume" else 1
    p = make_panel(spark, close, volume)
    if spoil == "gap":
        p = p.where("pos <> 1")
    if spoil == "cell":
        p = p.where("not (pos = 1 and asset = 'A0')")
    with pytest.raises(PanelError, match=match):
        panel.validated(p, "day")


def test_rolling_correlation_is_numpys_and_a_constant_series_gives_null(spark):
    r = np.random.default_rng(3).normal(0, 0.02, (30, 3))
    r[:, 2] = 0.0
    got = {(e.pos, e.i, e.j): e.rho for e in graph.rolling_correlation(make_returns(spark, r), 10).collect()}
    assert len(got) == 21 * 3
    for k in (9, 20, 29):
        assert got[k, 0, 1] == pytest.approx(np.corrcoef(r[k - 9 : k + 1, 0], r[k - 9 : k + 1, 1])[0, 1], abs=1e-9)
        assert got[k, 0, 2] is None


def test_known_edges_have_known_density_mean_and_adjacency(spark):
    rho = {(0, 1): 0.8, (0, 2): 0.3, (0, 3): -0.5, (1, 2): 0.6, (1, 3): 0.1, (2, 3): 0.9}
    rows = spark.createDataFrame([(0, DAY, i, j, v) for (i, j), v in rho.items()], "pos int, date date, i int, j int, rho double")
    edges = graph.weighted(rows, 0.2145)
    t = graph.edge_topology(edges).first()
    assert (t.mean_correlation, t.graph_density) == pytest.approx((2.2 / 6, 4 / 6))
    a = np.zeros((4, 4))
    for e in graph.adjacency(edges, "w_tau").collect():
        a[e.i, e.j] = e.a
    w = np.eye(4)
    for (i, j), v in rho.items():
        w[i, j] = w[j, i] = 1 - np.sqrt(2 * (1 - v)) / 2 if v > 0.2145 else 0
    d = w.sum(axis=1) ** -0.5
    assert a == pytest.approx(d[:, None] * w * d[None, :])
    assert np.abs(np.linalg.eigvalsh(a)).max() <= 1 + 1e-9
    assert graph.isolated_windows(edges).first().n == 0


def test_closed_forms_of_the_matrix_measures():
    k = np.ones((1, 5, 5)) - np.eye(5)
    assert spectral.laplacian_connectivity(k, False) == pytest.approx(5)
    assert spectral.laplacian_connectivity(k, True) == pytest.approx(5 / 4)
    assert spectral.laplacian_connectivity(3 * k, True) == pytest.approx(5 / 4)
    assert spectral.spanning_length(np.array([[[0, 1, 9], [1, 0, 2], [9, 2, 0.0]]])) == pytest.approx(1.5)
    assert spectral.entropy(np.ones((1, 4))) == pytest.approx(np.log(4))
    c = np.array([[1, 0.9, 0.1, 0.1], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.8], [0.1, 0.1, 0.8, 1]])
    order = spectral.hierarchical_order(c)
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset({0, 1}), frozenset({2, 3})}


def test_permutation_null_is_seeded_and_breaks_correlation():
    x = np.random.default_rng(1).normal(size=(60, 1)) + 0.1 * np.random.default_rng(2).normal(size=(60, 4))
    a = spectral.permutation_null(x, 50, np.random.default_rng(5))
    b = spectral.permutation_null(x, 50, np.random.default_rng(5))
    assert np.array_equal(a[0], b[0]) and abs(a[0].mean()) < 0.05
    assert np.quantile(a[1], 0.95) > np.quantile(a[0], 0.95) > 0.1


def test_acf_matches_its_definition(spark):
    r = np.random.default_rng(5).normal(0, 0.02, (80, 1))
    got = {a.lag: a.acf for a in stats.acf(make_returns(spark, r), 5).collect()}
    d = r[:, 0] - r[:, 0].mean()
    assert got == pytest.approx({k: (d[k:] * d[: 80 - k]).sum() / (d * d).sum() for k in range(6)}, abs=1e-9)


def test_study_geometry_has_24_folds_and_bad_layouts_are_refused():
    layout = features.fold_layout(2006, 59, FoldConfig(365, 63, 63, 63))
    tests = [f for f in layout if f[1] == "test"]
    assert (len(tests), tests[0][2], tests[-1][3]) == (24, 487, 1998)
    assert len(features.fold_layout(120, 10, FoldConfig(20, 5, 5, 5))) == 16 * 3
    with pytest.raises(FoldError):
        features.fold_layout(50, 40, FoldConfig(20, 5, 5, 5))


def test_features_and_graphs_do_not_look_ahead(spark):
    r = np.random.default_rng(7).normal(0, 0.02, (60, 3))
    spoiled = r.copy()
    spoiled[40:] = 5.0 + np.random.default_rng(8).normal(0, 1, (20, 3))
    c = FeatureConfig(3, (5,), 5)
    for f in (lambda x: features.node_features(x, c).drop("date"), lambda x: graph.rolling_correlation(x, 10).drop("date")):
        a, b = (sorted(map(tuple, f(make_returns(spark, x)).where("pos < 40").collect()), key=str) for x in (r, spoiled))
        flat = lambda rows: [v for row in rows for v in row if isinstance(v, float)]
        assert flat(a) == pytest.approx(flat(b), abs=1e-12)


def test_standardiser_reads_training_rows_only(spark):
    x = spark.createDataFrame([(k, "A", float(k if k < 10 else 1000)) for k in range(20)], "pos int, asset string, f double")
    pos = features.fold_positions(features.folds(spark, [(0, "train", 0, 9), (0, "val", 10, 14), (0, "test", 15, 19)]))
    s = features.standardiser(x, pos, ["f"]).first()
    assert (s.mean_f, s.sd_f) == pytest.approx((4.5, np.std(np.arange(10.0))))


def test_accuracy_by_hand_and_its_errors(spark):
    rows = [(0, DAY, a, y, p, m) for m, ps in (("zero", (0.0, 0.0)), ("neg", (-1.0, 2.0))) for a, y, p in (("A", 1.0, ps[0]), ("B", -2.0, ps[1]))]
    p = spark.createDataFrame(rows, models.PREDICTIONS)
    got = {r.model: r for r in evaluation.accuracy(p, "zero").collect()}
    assert got["neg"].skill_score == pytest.approx(-3.0) and got["neg"].directional_accuracy == 0
    assert got["zero"].directional_accuracy is None and got["zero"].coverage == 0
    with pytest.raises(EvaluationError):
        evaluation.checked_accuracy(p, "absent")


def test_holm_and_identical_models(spark):
    rows = [(0, DAY + datetime.timedelta(days=k), "A", float(np.sin(k)), v, m) for k in range(30) for m, v in (("a", 0.0), ("b", 0.0), ("c", float(np.cos(k))))]
    got = {(r.model_a, r.model_b): r for r in evaluation.dm_matrix(spark.createDataFrame(rows, models.PREDICTIONS)).collect()}
    assert got["a", "b"].statistic is None and got["a", "b"].p_value == 1 and got["a", "b"].identical
    assert got["a", "c"].statistic == pytest.approx(-got["c", "a"].statistic)
    assert got["a", "c"].p_value_holm == pytest.approx(min(1, 3 * got["a", "c"].p_value))


def test_backtest_by_hand(spark):
    e = lambda x: float(np.log1p(x))
    rows = [(0, DAY + datetime.timedelta(days=k), a, e(y), p, "m") for k, vs in enumerate([((0.1, 1.0), (-0.2, -1.0)), ((0.1, 1.0), (0.2, 1.0))]) for a, (y, p) in zip("AB", vs, strict=True)]
    c = {(r.model, r.cost_bps, r.date.day): r for r in backtest.curves(spark.createDataFrame(rows, models.PREDICTIONS), (0.0, 100.0)).collect()}
    assert c["m", 0.0, 1].gross_return == pytest.approx(0.15) and c["m", 0.0, 2].turnover == pytest.approx(1.0)
    assert c["m", 100.0, 1].net_return == pytest.approx(0.14) and c["buy-and-hold", 0.0, 2].equity == pytest.approx(0.95 * 1.15)
    s = {(r.model, r.cost_bps): r for r in backtest.summary(backtest.curves(spark.createDataFrame(rows, models.PREDICTIONS), (0.0,)), 365).collect()}
    assert s["buy-and-hold", 0.0].max_drawdown == pytest.approx(-0.05)
    with pytest.raises(EvaluationError):
        backtest.curves(spark.createDataFrame(rows, models.PREDICTIONS), (1.0, 1.0))


def test_autoregressions_recover_their_process():
    rng = np.random.default_rng(7)
    x = np.zeros((600, 2))
    a = np.array([[0.5, 0.2], [0.0, 0.4]])
    for k in range(1, 600):
        x[k] = a @ x[k - 1] + rng.normal(0, 0.02, 2)
    assert models.select_order(x, 4) == 1
    assert models.fit_var(x, 1)[1:].T == pytest.approx(a, abs=0.12)
    assert models.select_order(rng.normal(0, 0.02, (400, 1)), 5) == 0


def test_network_gradients_and_learning():
    rng = np.random.default_rng(1)
    x, a = rng.normal(size=(6, 4, 3)), rng.random((6, 4, 4))
    y = rng.normal(size=(6, 4))
    net = models.GraphNetwork(3, 5, 0.0, rng)
    net.p = [p.astype(np.float64) for p in net.p]
    out, cache = net.forward(a, x)
    grads = net.gradients(out, y, cache)
    for k, p in enumerate(net.p):
        at = tuple(0 for _ in p.shape)
        for sign in (1, -1):
            p[at] += sign * 1e-6
            loss = np.mean((net.forward(a, x)[0] - y) ** 2)
            p[at] -= sign * 1e-6
            up, down = (loss, None) if sign == 1 else (up, loss)
        assert grads[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)
    order = rng.permutation(4)
    swapped = net.forward(a[:, order][:, :, order], x[:, order])[0]
    assert swapped == pytest.approx(net.forward(a, x)[0][:, order])


def test_config_refuses_unknown_keys_and_hashes_stably():
    assert config_hash(StudyConfig()) == config_hash(from_dict(StudyConfig, {"graph": {"window": 20}}))
    with pytest.raises(TypeError):
        from_dict(StudyConfig, {"graph": {"windw": 20}})


def test_store_round_trip_and_missing_tables(spark, tmp_path):
    from panelgraph.sources.store import Store

    store = Store(spark, str(tmp_path))
    with pytest.raises(MissingArtifactError, match="step 'graphs'"):
        store.load("returns")
    store.save("returns", spark.range(3))
    assert store.load("returns").count() == 3


def test_pages_stop_at_the_end_and_at_an_empty_page():
    from panelgraph.sources.klines import pages

    feed = lambda s, i, at, n: [[k * 10] for k in range(20) if k * 10 >= at][:3]
    assert [r[0] for r in pages(feed, "X", "1d", 15, 90, 3)] == [20, 30, 40, 50, 60, 70, 80, 90]
    assert [r[0] for r in pages(feed, "X", "1d", 170, 900, 3)] == [170, 180, 190]


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from panelgraph.streaming.bars import event_bars

    rows = [(datetime.datetime(2024, 1, 1 + k % 3, 5), f"t{k % 2}", float(k)) for k in range(30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = event_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, event_bars(batch).select(*[F.col(c) for c in spark.table("bars").columns]).collect()))


def test_tails_match_tables():
    from panelgraph.functions.tails import chi2_sf, t_two_sided

    assert chi2_sf(43.773, 30) == pytest.approx(0.05, abs=1e-4)
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_number_formats(spark):
    from panelgraph.functions import formats

    assert formats.plain_number(1234.5, 1) == "1\u00a0234,5"
    assert formats.plain_pvalue(0.0001) == "<0,001" and formats.plain_number(float("nan")) == "--"
    df = spark.createDataFrame([(1234.5,), (None,)], "x double")
    assert [r[0] for r in df.select(formats.number_column(df.x, 1)).collect()] == ["1\u00a0234,5", "--"]


def test_strategies_are_read_by_their_sharpe_at_both_cost_levels(spark):
    rows = [("a", 0.0, 1.0), ("a", 10.0, 0.2), ("b", 0.0, 0.5), ("b", 10.0, -0.1), ("c", 0.0, -0.5), ("c", 10.0, -0.9), ("d", 0.0, None), ("d", 10.0, None), (backtest.REFERENCE, 0.0, 1.0)]
    got = {r.model: r.verdict for r in backtest.verdicts(spark.createDataFrame(rows, "model string, cost_bps double, sharpe double")).collect()}
    assert got == {"a": backtest.SURVIVES, "b": backtest.CONSUMED, "c": backtest.UNPROFITABLE, "d": backtest.NO_POSITION}
    order = backtest.in_order(spark.createDataFrame(rows, "model string, cost_bps double, sharpe double"), ["d", "a", "c", "b"]).collect()
    assert [r.model for r in order[:5]] == ["d", "a", "c", "b", backtest.REFERENCE] and [r.cost_ix for r in order] == [0] * 5 + [1] * 4


def test_comparisons_refuse_what_they_cannot_compare(spark):
    import datetime

    day = datetime.date(2020, 1, 1)
    schema = "model string, date date, asset string, y_true double, y_pred double"
    make = lambda name, off, n=6: [(name, day + datetime.timedelta(k), a, 0.1 * k, 0.1 * k + off * (k + 1)) for k in range(n) for a in ("x", "y")]
    good = spark.createDataFrame(make("zero", 0.5) + make("m", 0.2), schema)
    losses = evaluation.daily_losses(good)
    assert evaluation.checked_diebold_mariano(losses, "zero", "m").first()["statistic"] > 0
    for a, b, h in (("m", "m", 1), ("m", "zero", 0), ("m", "zero", 6), ("m", "absent", 1)):
        with pytest.raises(EvaluationError):
            evaluation.checked_diebold_mariano(losses, a, b, h)
    same = evaluation.daily_losses(spark.createDataFrame(make("zero", 0.5) + make("m", 0.5), schema))
    with pytest.raises(EvaluationError, match="does not vary"):
        evaluation.checked_diebold_mariano(same, "zero", "m")
    with pytest.raises(EvaluationError):
        evaluation.checked_accuracy(good, "absent")
    with pytest.raises(EvaluationError, match="no error"):
        evaluation.checked_accuracy(spark.createDataFrame(make("zero", 0.0) + make("m", 0.1), schema), "zero")
    with pytest.raises(EvaluationError, match="reference"):
        backtest.checked(spark.createDataFrame(make(backtest.REFERENCE, 0.1), schema))
    with pytest.raises(EvaluationError, match="rectangle"):
        backtest.checked(good.where("not (model = 'm' and asset = 'y' and date = '2020-01-02')"))
    with pytest.raises(EvaluationError):
        evaluation.rank_association(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double"), "x", "y")
    assert backtest.checked(good) is good


def test_topology_and_thresholds_are_gated(spark):
    rows = [(0.1 * k, 0.1 * k, -0.1 * k) for k in range(8)]
    names = "mean_correlation double, market_mode_share double, spectral_entropy double"
    assert {r.metric: round(r.rho, 6) for r in spectral.sign_gate(spark.createDataFrame(rows, names)).collect()} == {"market_mode_share": 1.0, "spectral_entropy": -1.0}
    with pytest.raises(GraphError, match="spectral_entropy"):
        spectral.sign_gate(spark.createDataFrame([(a, b, -c) for a, b, c in rows], names))
    with pytest.raises(GraphError, match="without a value"):
        spectral.sign_gate(spark.createDataFrame([*rows, (0.5, float("nan"), 0.0)], names))
    assert spectral.plausible(0.2) == 0.2
    for tau in (0.1, 0.4, float("nan")):
        with pytest.raises(GraphError):
            spectral.plausible(tau)


def test_events_may_stand_under_a_key_and_need_labels(tmp_path):
    path = tmp_path / "e.yaml"
    path.write_text("events:\n- {key: a, date: 2020-01-02, label: A}\n- {key: b, date: 2020-01-03, label: B, citation: c}\n")
    assert [(r[0], r[2], r[4]) for r in events.load_events(str(path))] == [("a", "A", ""), ("b", "B", "c")]
    for text in ("events: []", "- {key: a, date: 2020-01-02}", "- {date: 2020-01-02, label: A}", "- {key: a, date: soon, label: A}"):
        path.write_text(text)
        with pytest.raises(ValueError):
            events.load_events(str(path))


def test_a_refill_keeps_other_symbols(spark, tmp_path):
    from panelgraph.sources.klines import RAW

    asked = []

    def fetch(symbols):
        asked.append(symbols)
        at = lambda k: 1_577_836_800_000 + k * 86_400_000
        return spark.createDataFrame([(s, at(k), *["1"] * 5, at(k) + 1, "1", 1, "1", "1", "0") for s in symbols for k in range(3)], RAW)

    store = Store(spark, str(tmp_path))
    span = "2020-01-01", "2020-01-03"
    assert store.cached_klines(["A"], *span, fetch).count() == 3 and store.cached_klines(["B", "A"], *span, fetch).count() == 6
    assert store.cached_klines(["A"], *span, fetch).count() == 3 and asked == [["A"], ["B"]]
    assert store.cached_klines(["A"], *span, fetch, force=True).count() == 3 and store.load("klines").count() == 6 and asked[-1] == ["A"]
