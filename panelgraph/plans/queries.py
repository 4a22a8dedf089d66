"""The registered queries of the study and, beside each, its SQL. Doubles are rounded on both sides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelgraph.functions import formats
from panelgraph.operators import backtest, evaluation, events, features, graph, models, panel, spectral, stats
from panelgraph.plans.sql import ACC, ADJ, BT, DM, EDGES, EVENTS, FEAT, FOLDS, sql
from panelgraph.plans.study import FEATURES, OFFSETS, Study
from panelgraph.streaming.bars import event_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 7
LARGE = 1e4
#: Queries whose SQL holds for the plain variant only.
WHOLE = {"rp3_backtest_table", "gr3_threshold", "gr4_adjacency", "gr5_edge_density", "gr18_weighted_degree", "ag4_density_summary", "ag5_topology_summary", "ag6_isolated_windows", "wn15_rank_correlation", "ev1_event_study", "ev4_event_tables", "jn11_fold_topology"}
WHOLE |= {"md1_md2_predictions", "ag12_accuracy", "ag12_accuracy_by_asset", "ag12_accuracy_by_fold", "ag17_positive_skill", "st6_best_worst_fold", "ts1_daily_losses", "ts3_diebold_mariano", "jn9_so6_model_pairs", "bt1_rectangular", "bt2_bt3_positions", "wn10_turnover", "bt4_curves", "wn12_drawdown", "bt8_summary", "bt10_verdicts", "st7_best_tradable", "fg6_equity_curves"}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places (-0.0 to 0.0; large ones to two places), other types as they are."""

    def one(c: str):
        x = F.col(f"`{c}`")
        return (F.when(F.abs(x) >= LARGE, F.round(x, 2)).otherwise(F.round(x, DIGITS)) + F.lit(0.0)).alias(c)

    return df.select(*[one(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, parts: list[str] | None = None, select: str | None = None):
    """Registers f(study) under name; select is its SQL, in which [[x]] stands for x
    rounded like the result (<<x>> if it may be large). Queries with SQL run the plain variant of
    the study; those in WHOLE are registered over the whole study too, as name_whole."""

    def add(f: Callable[[Study], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Study(spark, sf_dir, plain=bool(select))))
        if name in WHOLE:
            QUERIES[f"{name}_whole"] = lambda spark, sf_dir: rounded(f(Study(spark, sf_dir)))
        if select:
            text = re.sub(r"<<(.*?)>>", rf"(CASE WHEN ABS(\1) >= {LARGE} THEN ROUND(\1, 2) ELSE ROUND(\1, {DIGITS}) END + 0.0)", select)
            text = text.replace("[[", "ROUND(CAST(").replace("]]", f" AS DOUBLE), {DIGITS}) + 0.0")
            ORACLES[name] = sql(parts or [], text)
        return f

    return add


ASSETS = [f"S{k}" for k in range(10)]
PIVOT = ", ".join(f"[[MAX(CASE WHEN asset = '{a}' THEN {{0}} END)]] AS \"{a}\"" for a in ASSETS)



def features_means(s: Study) -> DataFrame:
    """(fold, x, y): the mean correlation and density of each fold's test dates."""
    test = s.positions.where("split = 'test'").select("fold", "pos")
    return s.topology.join(test, "pos").groupBy("fold").agg(F.avg("mean_correlation").alias("x"), F.avg("graph_density").alias("y"))


# --- Sources, panels and their checks
query("src4_bars", [], "SELECT date, asset, [[close]] AS close, [[volume]] AS volume, [[quote_volume]] AS quote_volume, trades FROM bars")(lambda s: s.bars)
query("src3_date_range", [], "SELECT date, asset, [[close]] AS close, trades FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")(lambda s: panel.between(s.bars, "1996-01-01", "1997-12-31").select("date", "asset", "close", "trades"))
query("prj2_price_panel", [], f"SELECT date, {PIVOT.format('close')} FROM bars GROUP BY date")(lambda s: panel.wide(s.bars, "close", ASSETS))
query("prj3_volume_panel", [], f"SELECT date, {PIVOT.format('volume')} FROM bars GROUP BY date")(lambda s: panel.wide(s.bars, "volume", ASSETS))
query("jn1_positions", [], "SELECT date, asset, pos, asset_ix FROM panel")(lambda s: s.panel.select("date", "asset", "pos", "asset_ix"))
query(
    "prj4_panel_violations", [],
    "SELECT 'calendar_gaps' AS \"check\", (SELECT COUNT(*) FROM (SELECT unnest(generate_series(MIN(date), MAX(date), INTERVAL 7 DAY))::DATE AS date FROM bars) g WHERE date NOT IN (SELECT date FROM bars)) AS n "
    "UNION ALL SELECT 'missing_cells', COUNT(DISTINCT date) * COUNT(DISTINCT asset) - COUNT(*) FROM bars UNION ALL SELECT 'null_values', COUNT(*) FILTER (close IS NULL OR volume IS NULL) FROM bars "
    "UNION ALL SELECT 'prices_not_positive', COUNT(*) FILTER (close <= 0) FROM bars UNION ALL SELECT 'zero_volumes', COUNT(*) FILTER (volume = 0) FROM bars",
)(lambda s: panel.violations(s.panel, "week"))
query("prj5_log_returns", [], "SELECT pos, date, asset, [[r]] AS r FROM ret")(lambda s: s.returns.select("pos", "date", "asset", "r"))
query("so4_date_difference", [], "SELECT date FROM cal WHERE date NOT IN (SELECT date FROM ret)")(lambda s: s.panel.select("date").distinct().join(s.returns.select("date").distinct(), "date", "left_anti"))
query("jn2_volume_alignment", [], "SELECT pos, asset, [[volume]] AS volume FROM ret")(lambda s: s.returns.select("pos", "asset").join(s.panel.select((F.col("pos") - 1).alias("pos"), "asset", "volume"), ["pos", "asset"], "left"))

# --- Statistics
MOM = "mo AS (SELECT asset, COUNT(*) AS n, AVG(r) AS m FROM ret GROUP BY asset), dv AS (SELECT ret.asset, r - m AS d, n FROM ret JOIN mo USING (asset))"
query(
    "ag1_descriptive", [MOM],
    "SELECT asset, [[(SELECT m FROM mo WHERE mo.asset = dv.asset)]] AS mean, [[SQRT(SUM(d * d) / (COUNT(*) - 1)) * SQRT(52)]] AS volatility_annualized, "
    "[[AVG(d * d * d) / POWER(AVG(d * d), 1.5)]] AS skewness, [[AVG(d * d * d * d) / POWER(AVG(d * d), 2) - 3]] AS excess_kurtosis FROM dv GROUP BY asset",
)(lambda s: stats.descriptive(s.returns, 52))


def _acf_sql(x: str) -> list[str]:
    return [
        f"xs AS (SELECT asset, pos, {x} - AVG({x}) OVER (PARTITION BY asset) AS d FROM ret)",
        "vs AS (SELECT asset, SUM(d * d) AS v, COUNT(*) AS n FROM xs GROUP BY asset)",
        "ac AS (SELECT a.asset, CAST(k AS INTEGER) AS lag, SUM(a.d * b.d) / ANY_VALUE(v) AS acf, ANY_VALUE(n) AS n FROM generate_series(0, 30) g(k) JOIN xs a ON TRUE JOIN xs b ON a.asset = b.asset AND b.pos = a.pos - k JOIN vs ON vs.asset = a.asset GROUP BY a.asset, k)",
    ]


query("ag2_acf", _acf_sql("r"), "SELECT asset, lag, [[acf]] AS acf FROM ac")(lambda s: stats.acf(s.returns, 30))
query("ag2_acf_absolute", _acf_sql("ABS(r)"), "SELECT asset, lag, [[acf]] AS acf FROM ac")(lambda s: stats.acf(s.returns, 30, True))
query("ag3_ljung_box_statistic", _acf_sql("r"), "SELECT asset, [[ANY_VALUE(n) * (ANY_VALUE(n) + 2) * SUM(acf * acf / (n - lag))]] AS lb_stat FROM ac WHERE lag > 0 GROUP BY asset")(lambda s: stats.ljung_box(s.returns, 30).select("asset", "lb_stat"))
query("ts10_ljung_box")(lambda s: stats.ljung_box(s.returns, 30))
ACF_BOTH = [*_acf_sql("r"), *[x.replace("xs AS", "xa AS").replace("vs AS", "va AS").replace("ac AS", "aa AS").replace("FROM xs", "FROM xa").replace("JOIN xs a", "JOIN xa a").replace("JOIN xs b", "JOIN xa b").replace("JOIN vs ON vs", "JOIN va ON va") for x in _acf_sql("ABS(r)")]]
query(
    "prj6_stylised_gate", [*ACF_BOTH, MOM, "ku AS (SELECT asset, AVG(d * d * d * d) / POWER(AVG(d * d), 2) - 3 AS k FROM dv GROUP BY asset)"],
    "SELECT asset, 'excess_kurtosis' AS \"check\", [[k]] AS value FROM ku WHERE k <= 0 UNION ALL SELECT asset, 'acf1', [[acf]] FROM ac WHERE lag = 1 AND ABS(acf) >= CASE WHEN asset = 'S3' THEN 0.6 ELSE 0.1 END UNION ALL SELECT asset, 'abs_acf1', [[acf]] FROM aa WHERE lag = 1 AND acf <= 0.05",
)(lambda s: stats.stylised_gate(stats.descriptive(s.returns, 52), stats.acf(s.returns, 1), stats.acf(s.returns, 1, True), exceptions={"S3": 0.6}))

# --- Windows and graphs
query("jn4_pairs", [EDGES], "SELECT pos, i, j, [[x]] AS x, [[y]] AS y FROM pr")(lambda s: graph.pairs(s.returns).drop("date"))
query("wn1_causal_window", [], "SELECT pos, asset, CASE WHEN COUNT(*) OVER w = 5 THEN ROUND(AVG(r) OVER w, 7) + 0.0 END AS mean_5 FROM ret WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS 4 PRECEDING)")(
    lambda s: s.returns.select("pos", "asset", F.when(F.count("*").over((w := Window.partitionBy("asset").orderBy("pos").rowsBetween(-4, 0))) == 5, F.avg("r").over(w)).alias("mean_5"))
)
query("wn2_rolling_correlation", [EDGES], "SELECT pos, date, i, j, [[rho]] AS rho FROM edges")(lambda s: s.edges.select("pos", "date", "i", "j", "rho"))
query("gr1_distance_weights", [EDGES], "SELECT pos, i, j, [[d]] AS d, [[w]] AS w FROM edges")(lambda s: s.edges.select("pos", "i", "j", "d", "w"))
query("gr3_threshold", [EDGES], "SELECT pos, i, j, [[w_tau]] AS w_tau FROM edges WHERE w_tau > 0")(lambda s: s.edges.where("w_tau > 0").select("pos", "i", "j", "w_tau"))
query("gr4_adjacency", [EDGES, ADJ], "SELECT pos, i, j, [[a]] AS a FROM adj")(lambda s: s.adjacency)
query("gr5_edge_density", [EDGES], "SELECT pos, date, [[graph_density]] AS graph_density FROM topo")(lambda s: s.topology.select("pos", "date", "graph_density"))
query("gr6_mean_correlation", [EDGES], "SELECT pos, date, [[mean_correlation]] AS mean_correlation FROM topo")(lambda s: s.topology.select("pos", "date", "mean_correlation"))
query("gr18_weighted_degree", [EDGES, ADJ], "SELECT pos, i, [[SUM(w)]] AS degree FROM mir GROUP BY pos, i")(lambda s: graph.degrees(s.edges))
query(
    "prj8_edge_violations", [EDGES],
    "SELECT 'rho_null' AS \"check\", COUNT(*) FILTER (rho IS NULL) AS n FROM edges UNION ALL SELECT 'rho_outside', COUNT(*) FILTER (ABS(rho) > 1.000001) FROM edges "
    "UNION ALL SELECT 'w_outside', COUNT(*) FILTER (w < 0 OR w > 1) FROM edges UNION ALL SELECT 'not_upper', COUNT(*) FILTER (i >= j) FROM edges",
)(lambda s: graph.edge_violations(s.edges))
query("ag4_density_summary", [EDGES], "SELECT [[AVG(graph_density)]] AS mean, [[MIN(graph_density)]] AS min, [[MAX(graph_density)]] AS max, [[STDDEV_POP(graph_density)]] AS sd FROM topo")(lambda s: graph.density_summary(s.topology))
query(
    "ag5_topology_summary", [EDGES, EVENTS],
    "SELECT metric, [[AVG(value)]] AS mean, [[STDDEV_SAMP(value)]] AS sd, [[MIN(value)]] AS min, [[MEDIAN(value)]] AS median, [[MAX(value)]] AS max, [[STDDEV_SAMP(value) / NULLIF(ABS(AVG(value)), 0)]] AS cv FROM lg GROUP BY metric",
)(lambda s: stats.summary(s.topology, ["mean_correlation", "graph_density"]))
query("ag6_isolated_windows", [EDGES, ADJ], "SELECT COUNT(*) AS n FROM (SELECT pos FROM (SELECT pos, i, SUM(w) AS s FROM mir GROUP BY pos, i) GROUP BY pos HAVING BOOL_OR(s = 0))")(lambda s: graph.isolated_windows(s.edges))
query("ag16_regime_quantiles", [EDGES], "SELECT [[quantile_cont(mean_correlation, 0.1)]] AS q10, [[quantile_cont(mean_correlation, 0.9)]] AS q90, [[MEDIAN(mean_correlation)]] AS median FROM topo")(
    lambda s: s.topology.agg(F.percentile("mean_correlation", F.lit(0.1)).alias("q10"), F.percentile("mean_correlation", F.lit(0.9)).alias("q90"), F.median("mean_correlation").alias("median"))
)
query("ap1_density_at", [EDGES], "SELECT tau, pos, [[AVG(CASE WHEN rho > tau THEN 1.0 ELSE 0.0 END)]] AS density FROM edges, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) t(tau) GROUP BY tau, pos")(lambda s: graph.density_at(s.edges, [0.1, 0.3, 0.5]))
query("jn13_delta", [EDGES], "SELECT t.date, [[t.mean_correlation]] AS value, [[t.mean_correlation - b.mean_correlation]] AS delta FROM topo t LEFT JOIN topo b ON b.date = t.date - 28")(
    lambda s: s.topology.alias("t").join(s.topology.alias("b"), F.col("b.date") == F.date_sub("t.date", 28), "left").select("t.date", F.col("t.mean_correlation").alias("value"), (F.col("t.mean_correlation") - F.col("b.mean_correlation")).alias("delta"))
)
query(
    "gr13_marchenko_pastur", [],
    "SELECT CAST(k AS INTEGER) AS k, CASE WHEN k * 0.1 > POWER(1 - SQRT(0.5), 2) AND k * 0.1 < POWER(1 + SQRT(0.5), 2) THEN ROUND(SQRT((POWER(1 + SQRT(0.5), 2) - k * 0.1) * (k * 0.1 - POWER(1 - SQRT(0.5), 2))) / (2 * PI() * 0.5 * k * 0.1), 7) ELSE 0.0 END AS density FROM generate_series(1, 40) g(k)",
)(lambda s: s.spark.range(1, 41).select(F.col("id").cast("int").alias("k"), graph.marchenko_pastur(F.col("id") * 0.1, 0.5).alias("density")))
query("gr7_gr12_spectral_topology")(lambda s: s.spectra.drop("eigenvalues"))
query("gr14_topology")(lambda s: s.topology.join(graph.densities(s.edges, s.thresholds), "pos").join(s.spectra.drop("date", "eigenvalues"), "pos"))
query("gr14_densities", [EDGES], "SELECT pos, [[AVG(CASE WHEN rho > 0.2 THEN 1.0 ELSE 0.0 END)]] AS graph_density_fixed, [[AVG(CASE WHEN rho > 0.35 THEN 1.0 ELSE 0.0 END)]] AS graph_density_fwer FROM edges GROUP BY pos")(
    lambda s: graph.densities(s.edges, {"graph_density_fixed": 0.2, "graph_density_fwer": 0.35})
)
query("ts9_threshold_record")(lambda s: spectral.threshold_record(s.null, s.config.graph))
query("gr15_regime_spectra")(lambda s: spectral.regime_spectra(s.spectra, s.topology))
query("gr16_hierarchical_order")(lambda s: spectral.asset_order(s.edges))
query("ts7_permutation_null")(lambda s: s.null)
query("ts8_threshold")(lambda s: spectral.calibrated(s.null))
query(
    "wn15_rank_correlation", [EDGES, "rk AS (SELECT RANK() OVER (ORDER BY mean_correlation) + (COUNT(*) OVER (PARTITION BY mean_correlation) - 1) / 2.0 AS a, RANK() OVER (ORDER BY graph_density) + (COUNT(*) OVER (PARTITION BY graph_density) - 1) / 2.0 AS b FROM topo)"],
    "SELECT [[COVAR_POP(a, b) / (STDDEV_POP(a) * STDDEV_POP(b))]] AS rho, COUNT(*) AS n FROM rk",
)(lambda s: evaluation.spearman(s.topology, "mean_correlation", "graph_density"))

# As rows, as in prj6 and prj8: assets without a common mode, like those of the test tables, are a finding and no error of the query.
query("prj12_sign_gate")(lambda s: spectral.signs(s.topology.join(s.spectra.drop("date"), "pos")))

# --- Events
query("prj9_uncited_events", [EDGES, EVENTS], "SELECT event_key FROM ev WHERE citation = ''")(lambda s: events.without_citation(s.events))
query("ev3_post_event_dates", [EDGES, EVENTS], "SELECT event_key, event_date + 60 AS post_date FROM ev")(lambda s: events.post_event_dates(s.events))
query("ev1_event_study", [EDGES, EVENTS], "SELECT event_key, event_date, label, metric, offset_days, date_used, [[value]] AS value, [[percentile]] AS percentile, [[pct_change_clean]] AS pct_change_clean, [[pct_change_local]] AS pct_change_local FROM es")(lambda s: s.event_study)
query("jn10_nearest_date", [EDGES, EVENTS], "SELECT event_key, offset_days, date_used FROM nu")(lambda s: s.event_study.where("metric = 'mean_correlation' and date_used is not null").select("event_key", "offset_days", "date_used"))
query("ev4_event_tables", [EDGES, EVENTS], "SELECT event_key, metric, " + ", ".join(f"[[MAX(CASE WHEN offset_days = {o} THEN value END)]] AS \"{o}\"" for o in OFFSETS) + " FROM es GROUP BY event_key, metric")(lambda s: events.event_tables(s.event_study, OFFSETS))
query("wn14_percentile", [EDGES, EVENTS], "SELECT date, metric, [[percentile]] AS percentile FROM lp")(lambda s: events.strictly_below(s.topology.select("date", "mean_correlation", "graph_density").unpivot(["date"], ["mean_correlation", "graph_density"], "metric", "value")).drop("value"))

# --- Features and folds
query("wf1_node_features", [FEAT], "SELECT pos, asset, " + ", ".join(f"[[{c}]] AS {c}" for c in FEATURES) + " FROM fe0")(lambda s: s.features.select("pos", "asset", *FEATURES))
query("wf4_folds", [FOLDS], "SELECT fold, split, pos_start, pos_end FROM folds")(lambda s: s.folds)
query("jn6_fold_positions", [FOLDS], "SELECT fold, split, pos FROM fpos")(lambda s: s.positions)
query("jn5_lead_target", [FOLDS], "SELECT pos, asset, target_date, [[y]] AS y FROM tgt")(lambda s: s.targets.select("pos", "asset", "target_date", "y"))
query("jn3_aligned_graph", [EDGES], "SELECT pos, asset_ix, pos IN (SELECT pos FROM edges) AS has_graph FROM ret")(lambda s: features.aligned_graph(s.returns, s.edges))
query("wn8_lag_history", [], "SELECT pos, asset, ROUND(LAG(r, 2) OVER w, 7) + 0.0 AS h0, ROUND(LAG(r, 1) OVER w, 7) + 0.0 AS h1, ROUND(r, 7) + 0.0 AS h2 FROM ret WINDOW w AS (PARTITION BY asset ORDER BY pos) QUALIFY LAG(r, 2) OVER w IS NOT NULL")(
    lambda s: features.lag_history(s.returns, 3).where("history is not null").select("pos", "asset", *[F.col("history")[k].alias(f"h{k}") for k in range(3)])
)
STD = ["sd0 AS (SELECT fold, asset, " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in FEATURES) + " FROM fe0 JOIN fpos USING (pos) WHERE split = 'train' GROUP BY fold, asset)"]
query("ag8_standardiser", [FEAT, FOLDS, *STD], "SELECT fold, asset, " + ", ".join(f"[[m_{c}]] AS mean_{c}, [[CASE WHEN s_{c} <= 1e-12 * GREATEST(ABS(m_{c}), 1) THEN 1 ELSE s_{c} END]] AS sd_{c}" for c in FEATURES) + " FROM sd0")(lambda s: features.standardiser(s.features, s.positions, FEATURES))
query("wf3_standardised", [FEAT, FOLDS, *STD], "SELECT fold, split, pos, asset, " + ", ".join(f"[[({c} - m_{c}) / CASE WHEN s_{c} <= 1e-12 * GREATEST(ABS(m_{c}), 1) THEN 1 ELSE s_{c} END]] AS {c}" for c in FEATURES) + " FROM fe0 JOIN fpos USING (pos) JOIN sd0 USING (fold, asset)")(lambda s: features.standardised(s.features, s.positions, FEATURES))
query("prj11_fold_guard", [FEAT, FOLDS], "SELECT fold, CAST(SUM(" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in FEATURES) + ") AS BIGINT) AS n_null FROM fpos JOIN fe0 USING (pos) GROUP BY fold")(lambda s: features.fold_guard(s.positions, s.features, FEATURES))
query("jn11_fold_topology", [EDGES, FOLDS], "SELECT fold, [[AVG(graph_density)]] AS mean_density FROM topo JOIN fpos USING (pos) WHERE split = 'test' GROUP BY fold")(lambda s: s.topology.join(s.positions.where("split = 'test'"), "pos").groupBy("fold").agg(F.avg("graph_density").alias("mean_density")))
query("fg4_fold_scheme", [FOLDS], "SELECT fold, split, a.date AS start_date, b.date AS end_date FROM folds JOIN (SELECT DISTINCT pos, date FROM ret) a ON a.pos = pos_start JOIN (SELECT DISTINCT pos, date FROM ret) b ON b.pos = pos_end")(
    lambda s: s.folds.join((d := s.returns.select("pos", "date").distinct()).select(F.col("pos").alias("pos_start"), F.col("date").alias("start_date")), "pos_start").join(d.select(F.col("pos").alias("pos_end"), F.col("date").alias("end_date")), "pos_end").select("fold", "split", "start_date", "end_date")
)

# --- Forecasts
query("md1_md2_predictions", [FOLDS], "SELECT fold, date, asset, model, [[y_true]] AS y_true, [[y_pred]] AS y_pred FROM pred")(lambda s: s.predictions.select("fold", "date", "asset", "model", "y_true", "y_pred"))
query("ag7_historical_mean", [FOLDS], "SELECT fold, asset, [[m]] AS level FROM hm")(lambda s: s.train.groupBy("fold", "asset").agg(F.avg("r").alias("level")))
query("md3_ar_bic")(lambda s: models.autoregressions(s.returns, s.tests, s.positions)[0])
query("md3_ar_diagnostics")(lambda s: models.autoregressions(s.returns, s.tests, s.positions)[1])
query("md4_var_bic")(lambda s: models.autoregressions(s.returns, s.tests, s.positions, joint=True, name="var-bic")[0])
query("md4_var_fixed")(lambda s: s.var_fixed())
query("ag14_var_orders")(lambda s: models.autoregressions(s.returns, s.tests, s.positions, joint=True, name="var-bic")[1].agg(F.array_sort(F.collect_set("lag_order")).alias("orders")))
query("md8_graph_network")(lambda s: s.network(True)[0])
query("md6_no_graph")(lambda s: s.network(False)[0])
query("md8_validation_errors")(lambda s: s.network(True)[1])

# --- Accuracy and tests
SKILL = (
    "SELECT {by} g.model, [[SQRT(g.mse)]] AS rmse, [[g.mae]] AS mae, [[g.da]] AS directional_accuracy, [[g.coverage]] AS coverage, [[1 - g.mse / NULLIF(b.mse, 0)]] AS skill_score, g.n AS n_predictions "
    "FROM (SELECT {keys} model, AVG(e2) AS mse, AVG(ABS(y_true - y_pred)) AS mae, AVG(CASE WHEN taken = 1 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END) AS da, AVG(taken) AS coverage, COUNT(*) AS n FROM sq GROUP BY {keys} model) g "
    "JOIN (SELECT {keys} AVG(e2) AS mse FROM sq WHERE model = 'zero' {group}) b {on}"
)
query("ag12_accuracy", [FOLDS, ACC], SKILL.format(by="", keys="", group="", on="ON TRUE"))(lambda s: evaluation.accuracy(s.predictions, "zero"))
query("ag12_accuracy_by_asset", [FOLDS, ACC], SKILL.format(by="g.asset,", keys="asset,", group="GROUP BY asset", on="ON g.asset = b.asset"))(lambda s: evaluation.accuracy(s.predictions, "zero", ["asset"]))
query("ag12_accuracy_by_fold", [FOLDS, ACC], SKILL.format(by="g.fold,", keys="fold,", group="GROUP BY fold", on="ON g.fold = b.fold"))(lambda s: evaluation.accuracy(s.predictions, "zero", ["fold"]))
query(
    "ag17_positive_skill", [FOLDS, ACC],
    "SELECT g.model, COUNT(*) FILTER (1 - g.mse / b.mse > 1e-12) AS n_positive, COUNT(*) AS n FROM (SELECT model, asset, AVG(e2) AS mse FROM sq GROUP BY model, asset) g JOIN (SELECT asset, AVG(e2) AS mse FROM sq WHERE model = 'zero' GROUP BY asset) b USING (asset) GROUP BY g.model",
)(lambda s: evaluation.accuracy(s.predictions, "zero", ["asset"]).groupBy("model").agg(F.count_if(F.col("skill_score") > 1e-12).alias("n_positive"), F.count("*").alias("n")))
query(
    "st6_best_worst_fold", [FOLDS, ACC],
    "SELECT model, arg_max(fold, -mse) AS best, arg_max(fold, mse) AS worst FROM (SELECT model, fold, AVG(e2) AS mse FROM sq GROUP BY model, fold) GROUP BY model",
)(lambda s: evaluation.accuracy(s.predictions, "zero", ["fold"]).groupBy("model").agg(F.min_by("fold", "rmse").alias("best"), F.max_by("fold", "rmse").alias("worst")))
query("ag18_shape", [FOLDS], "SELECT COUNT(DISTINCT date) AS n_days, COUNT(DISTINCT asset) AS n_assets, [[AVG(CASE WHEN y_true = 0 THEN 1.0 ELSE 0.0 END)]] AS flat FROM pred")(lambda s: s.predictions.agg(F.count_distinct("date").alias("n_days"), F.count_distinct("asset").alias("n_assets"), F.avg((F.col("y_true") == 0).cast("double")).alias("flat")))
query("jn7_uncovered", [FOLDS], "SELECT COUNT(*) AS n FROM pred p WHERE NOT EXISTS (SELECT 1 FROM pred b WHERE b.model = 'zero' AND b.date = p.date AND b.asset = p.asset)")(lambda s: evaluation.uncovered(s.predictions, "zero").agg(F.count("*").alias("n")))
query("ts1_daily_losses", [FOLDS, DM], "SELECT model, date, [[loss]] AS loss FROM ls")(lambda s: evaluation.daily_losses(s.predictions))
query("ts3_diebold_mariano", [FOLDS, DM], "SELECT model_a, model_b, ROUND(CASE WHEN v > 1e-30 THEN mean_d / SQRT(v / n) * SQRT((n - 1.0) / n) END, 5) AS statistic, n - 1 AS df, [[mean_d]] AS mean_loss_differential FROM dm")(
    lambda s: evaluation.diebold_mariano(evaluation.daily_losses(s.predictions)).withColumn("statistic", F.round("statistic", 5))
)
query("ts4_dm_matrix")(lambda s: s.dm)
query("wn13_holm", [], "SELECT k, [[LEAST(1.0, MAX(p * (4 - rn + 1)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING))]] AS p_value_holm FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS rn FROM (VALUES (1, 0.01::DOUBLE), (2, 0.04::DOUBLE), (3, 0.03::DOUBLE), (4, 0.005::DOUBLE)) v(k, p))")(
    lambda s: evaluation.holm(s.spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005)], "k int, p_value double")).select("k", "p_value_holm")
)
query("jn9_so6_model_pairs", [FOLDS], "SELECT DISTINCT LEAST(a.model, b.model) AS model_a, GREATEST(a.model, b.model) AS model_b FROM (SELECT DISTINCT model FROM pred) a JOIN (SELECT DISTINCT model FROM pred) b ON a.model <> b.model")(
    lambda s: s.dm.select(F.least("model_a", "model_b").alias("model_a"), F.greatest("model_a", "model_b").alias("model_b")).distinct()
)
query(
    "ts6_rank_association", [EDGES, FOLDS, "ft AS (SELECT fold, AVG(mean_correlation) AS x, AVG(graph_density) AS y FROM topo JOIN fpos USING (pos) WHERE split = 'test' GROUP BY fold), sl AS (SELECT MEDIAN((b.y - a.y) / (b.x - a.x)) AS s FROM ft a JOIN ft b ON a.x < b.x), rk AS (SELECT x, y, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ft)"],
    "SELECT [[COVAR_POP(rx, ry) / (STDDEV_POP(rx) * STDDEV_POP(ry))]] AS rho, [[ANY_VALUE(s)]] AS slope, [[MEDIAN(y) - ANY_VALUE(s) * MEDIAN(x)]] AS intercept, COUNT(*) AS n FROM rk, sl",
)(lambda s: evaluation.rank_association(features_means(s), "x", "y").drop("p_value"))
query("fg7_density_vs_skill")(lambda s: QUERIES["jn11_fold_topology_whole"](s.spark, s.sf_dir).join(evaluation.accuracy(s.predictions, "zero", ["fold"]).where("model = 'gcn'").select("fold", "skill_score"), "fold"))
query(
    "fg7_density_vs_skill_plain", [EDGES, FOLDS, ACC],
    "SELECT fold, t.mean_density, [[1 - g.mse / NULLIF(b.mse, 0)]] AS skill_score FROM (SELECT fold, [[AVG(graph_density)]] AS mean_density FROM topo JOIN fpos USING (pos) WHERE split = 'test' GROUP BY fold) t "
    "JOIN (SELECT fold, AVG(e2) AS mse FROM sq WHERE model = 'ar1' GROUP BY fold) g USING (fold) JOIN (SELECT fold, AVG(e2) AS mse FROM sq WHERE model = 'zero' GROUP BY fold) b USING (fold)",
)(lambda s: features_means(s).select("fold", F.col("y").alias("mean_density")).join(evaluation.accuracy(s.predictions, "zero", ["fold"]).where("model = 'ar1'").select("fold", "skill_score"), "fold"))

# --- Backtest
query("bt1_rectangular", [FOLDS], "SELECT model, COUNT(DISTINCT date) * COUNT(DISTINCT asset) - COUNT(DISTINCT (date, asset)) AS missing, COUNT(*) - COUNT(DISTINCT (date, asset)) AS duplicates FROM pred GROUP BY model")(lambda s: backtest.rectangular_gaps(s.predictions))
query("bt2_bt3_positions", [FOLDS, BT], "SELECT model, date, asset, [[wt]] AS weight, [[ret]] AS ret FROM po")(lambda s: backtest.positions(s.predictions))
query("wn10_turnover", [FOLDS, BT], "SELECT model, date, [[gross_return]] AS gross_return, [[turnover]] AS turnover FROM dy")(lambda s: s.curves.where("cost_bps = 0").select("model", "date", "gross_return", "turnover"))
query("bt4_curves", [FOLDS, BT], "SELECT model, cost_bps, date, [[gross_return]] AS gross_return, [[turnover]] AS turnover, [[cost]] AS cost, [[net_return]] AS net_return, <<equity>> AS equity FROM cv")(lambda s: s.curves)
query("wn12_drawdown", [FOLDS, BT], "SELECT model, cost_bps, date, [[drawdown]] AS drawdown FROM dr")(lambda s: backtest.drawdowns(s.curves).select("model", "cost_bps", "date", "drawdown"))
query(
    "bt8_summary", [FOLDS, BT],
    "SELECT model, cost_bps, n_days, [[mean_turnover]] AS mean_turnover, [[CASE WHEN last > 0 THEN POWER(last, 52.0 / n_days) - 1 END]] AS annualized_return, [[sd * SQRT(52)]] AS annualized_volatility, [[av / NULLIF(sd, 0) * SQRT(52)]] AS sharpe, [[max_drawdown]] AS max_drawdown, <<last - 1>> AS cumulative_return FROM bt",
)(lambda s: s.backtest)
query(
    "bt10_verdicts", [FOLDS, BT, "ends AS (SELECT model, MAX(CASE WHEN cost_bps = 0 THEN av / NULLIF(sd, 0) END) AS gross, MAX(CASE WHEN cost_bps = 10 THEN av / NULLIF(sd, 0) END) AS net FROM bt WHERE model <> 'buy-and-hold' GROUP BY model)"],
    "SELECT model, CASE WHEN gross IS NULL THEN 'no position taken' WHEN net > 0 THEN 'survives the cost' WHEN gross > 0 THEN 'the cost consumes the edge' ELSE 'unprofitable either way' END AS verdict FROM ends",
)(lambda s: backtest.verdicts(s.backtest))
query(
    "st2_st3_backtest_order", [FOLDS, BT],
    "SELECT model, cost_bps, n_days, CAST(DENSE_RANK() OVER (ORDER BY cost_bps) - 1 AS INTEGER) AS cost_ix, CASE model WHEN 'zero' THEN 0 WHEN 'mean' THEN 1 WHEN 'ar1' THEN 2 ELSE 3 END AS model_ix FROM bt",
)(lambda s: backtest.in_order(s.backtest.select("model", "cost_bps", "n_days"), ["zero", "mean", "ar1"]))
query("st1_accuracy_order", [FOLDS, ACC], "SELECT fold, model, CAST(ROW_NUMBER() OVER (PARTITION BY fold ORDER BY SQRT(AVG(e2)), model) AS INTEGER) AS rank FROM sq GROUP BY fold, model")(
    lambda s: evaluation.by_error(evaluation.checked_accuracy(s.predictions, "zero", ["fold"]), ["fold"]).select("fold", "model", "rank")
)
query("ts4_dm_statistics", [FOLDS, DM], "SELECT model_a, model_b, [[mean_d / SQRT(CASE WHEN v > 1e-30 THEN v END / n) * SQRT((n - 1.0) / n)]] AS statistic, n - 1 AS df, v IS NULL OR v <= 1e-30 AS identical FROM dm")(
    lambda s: evaluation.dm_matrix(s.predictions).select("model_a", "model_b", "statistic", "df", "identical")
)
query("st7_best_tradable", [FOLDS, BT], "SELECT cost_bps, arg_max(model, av / sd) AS model, [[MAX(av / sd * SQRT(52))]] AS sharpe FROM bt WHERE sd > 0 AND av > 0 AND model <> 'buy-and-hold' GROUP BY cost_bps")(lambda s: backtest.best_tradable(s.backtest))
query("fg6_equity_curves", [FOLDS, BT], "SELECT model, cost_bps, date, <<equity>> AS equity FROM cv WHERE model <> 'zero'")(lambda s: s.curves.where("model <> 'zero'").select("model", "cost_bps", "date", "equity"))
RP3 = ", ".join(
    f"MAX(CASE WHEN cost_bps = {c} THEN CASE WHEN {x} IS NULL THEN '{formats.MISSING}' ELSE replace(format('{{:.3f}}', {x}), '.', ',') END END) AS \"{c}_{name}\""
    for c in (0.0, 10.0)
    for name, x in (("sharpe", "av / NULLIF(sd, 0) * SQRT(52)"), ("max_drawdown", "max_drawdown"))
)
query("rp3_backtest_table", [FOLDS, BT], f"SELECT model, {RP3} FROM bt GROUP BY model")(lambda s: s.backtest.groupBy("model").pivot("cost_bps", [0.0, 10.0]).agg(formats.number_column(F.first("sharpe")).alias("sharpe"), formats.number_column(F.first("max_drawdown")).alias("max_drawdown")))

# --- Beyond the study's tables
QUERIES["ss1_event_bars"] = lambda spark, d: rounded(event_bars(spark.read.parquet(f"{d}/events.parquet")))
ORACLES["ss1_event_bars"] = f"SELECT CAST(ts AS DATE) AS date, event_type, COUNT(*) AS n, ROUND(SUM(value), {DIGITS}) + 0.0 AS total FROM events GROUP BY 1, 2"
