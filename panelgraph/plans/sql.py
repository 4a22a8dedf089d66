"""The study in DuckDB SQL, as common table expressions that the oracle queries share."""

from __future__ import annotations

BASE = """
raw AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS asset,
  l_extendedprice, l_quantity FROM lineitem WHERE l_quantity > 0),
bars AS (SELECT date, asset, SUM(l_extendedprice) / SUM(l_quantity) AS close, SUM(l_quantity) AS volume,
  SUM(l_extendedprice) AS quote_volume, COUNT(*) AS trades FROM raw GROUP BY date, asset),
cal AS (SELECT date, CAST(ROW_NUMBER() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM bars)),
ast AS (SELECT asset, CAST(ROW_NUMBER() OVER (ORDER BY asset) - 1 AS INTEGER) AS asset_ix FROM (SELECT DISTINCT asset FROM bars)),
panel AS (SELECT * FROM bars JOIN cal USING (date) JOIN ast USING (asset)),
ret0 AS (SELECT *, ln(close) - LAG(ln(close)) OVER (PARTITION BY asset ORDER BY pos) AS r FROM panel),
ret AS (SELECT pos - 1 AS pos, date, asset, asset_ix, r, volume FROM ret0 WHERE r IS NOT NULL)"""
EDGES = """
pr AS (SELECT a.pos, a.date, a.asset_ix AS i, b.asset_ix AS j, a.r AS x, b.r AS y FROM ret a JOIN ret b ON a.pos = b.pos AND a.asset_ix < b.asset_ix),
ro AS (SELECT pos, date, i, j, COVAR_POP(x, y) OVER w / NULLIF(STDDEV_POP(x) OVER w * STDDEV_POP(y) OVER w, 0) AS rho, COUNT(*) OVER w AS n FROM pr
  WINDOW w AS (PARTITION BY i, j ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ed AS (SELECT pos, date, i, j, rho, SQRT(2 * (1 - GREATEST(-1, LEAST(1, rho)))) AS d FROM ro WHERE n = 20),
edges AS (SELECT *, GREATEST(0, LEAST(1, 1 - d / 2)) AS w, CASE WHEN rho > 0.2 THEN GREATEST(0, LEAST(1, 1 - d / 2)) ELSE 0 END AS w_tau FROM ed),
topo AS (SELECT pos, date, AVG(rho) AS mean_correlation, AVG(CASE WHEN w_tau <> 0 THEN 1.0 ELSE 0.0 END) AS graph_density FROM edges GROUP BY pos, date)"""
ADJ = """
mir AS (SELECT pos, i, j, w_tau AS w FROM edges UNION ALL SELECT pos, j, i, w_tau FROM edges),
ful AS (SELECT * FROM mir UNION ALL SELECT DISTINCT pos, i, i AS j, 1.0 AS w FROM mir),
deg AS (SELECT pos, i, SUM(w) AS deg FROM ful GROUP BY pos, i),
adj AS (SELECT f.pos, f.i, f.j, f.w / SQRT(a.deg * b.deg) AS a FROM ful f JOIN deg a ON f.pos = a.pos AND f.i = a.i JOIN deg b ON f.pos = b.pos AND f.j = b.i)"""
FEAT = """
fe0 AS (SELECT pos, date, asset, asset_ix, r, r AS r_lag0, LAG(r, 1) OVER o AS r_lag1, LAG(r, 2) OVER o AS r_lag2, LAG(r, 3) OVER o AS r_lag3, LAG(r, 4) OVER o AS r_lag4,
  CASE WHEN COUNT(*) OVER w5 = 5 THEN SQRT(AVG(r * r) OVER w5) END AS rv_5, CASE WHEN COUNT(*) OVER w20 = 20 THEN SQRT(AVG(r * r) OVER w20) END AS rv_20,
  CASE WHEN COUNT(*) OVER w20 = 20 THEN (ln(volume) - AVG(ln(volume)) OVER w20) / (CASE WHEN STDDEV_POP(ln(volume)) OVER w20 <= 1e-12 * GREATEST(ABS(AVG(ln(volume)) OVER w20), 1.0)
    THEN 1.0 ELSE STDDEV_POP(ln(volume)) OVER w20 END) END AS logvol_z_20 FROM ret
  WINDOW o AS (PARTITION BY asset ORDER BY pos), w5 AS (PARTITION BY asset ORDER BY pos ROWS 4 PRECEDING), w20 AS (PARTITION BY asset ORDER BY pos ROWS 19 PRECEDING))"""
FOLDS = """
nobs AS (SELECT MAX(pos) + 1 AS n FROM ret),
fk AS (SELECT CAST(k AS INTEGER) AS fold, CAST(19 + 26 * k AS INTEGER) AS s FROM nobs, generate_series(0, 1000) g(k) WHERE 19 + 26 * k + 156 - 1 <= n - 1 - 1),
folds AS (SELECT fold, 'train' AS split, s AS pos_start, s + 103 AS pos_end FROM fk UNION ALL SELECT fold, 'val', s + 104, s + 129 FROM fk UNION ALL SELECT fold, 'test', s + 130, s + 155 FROM fk),
fpos AS (SELECT fold, split, CAST(u.pos AS INTEGER) AS pos FROM folds, LATERAL (SELECT unnest(generate_series(pos_start, pos_end)) AS pos) u),
tgt AS (SELECT pos, asset, asset_ix, r, LEAD(date) OVER (PARTITION BY asset ORDER BY pos) AS target_date, LEAD(r) OVER (PARTITION BY asset ORDER BY pos) AS y FROM ret),
tst AS (SELECT fold, pos, target_date AS date, asset, r, y AS y_true FROM tgt JOIN fpos USING (pos) WHERE split = 'test'),
trn AS (SELECT fold, asset, pos, r FROM ret JOIN fpos USING (pos) WHERE split = 'train'),
hm AS (SELECT fold, asset, AVG(r) AS m FROM trn GROUP BY fold, asset),
arf AS (SELECT a.fold, a.asset, COALESCE(COVAR_POP(b.r, a.r) / NULLIF(VAR_POP(b.r), 0), 0) AS phi, AVG(a.r) AS my, AVG(b.r) AS mx
  FROM trn a JOIN trn b ON a.fold = b.fold AND a.asset = b.asset AND a.pos = b.pos + 1 GROUP BY a.fold, a.asset),
pred AS (SELECT fold, date, asset, y_true, 0.0::DOUBLE AS y_pred, 'zero' AS model FROM tst
  UNION ALL SELECT t.fold, date, t.asset, y_true, m, 'mean' FROM tst t JOIN hm USING (fold, asset)
  UNION ALL SELECT t.fold, date, t.asset, y_true, my - phi * mx + phi * r, 'ar1' FROM tst t JOIN arf USING (fold, asset))"""
ACC = """
sq AS (SELECT *, (y_true - y_pred) * (y_true - y_pred) AS e2, CASE WHEN y_true <> 0 AND y_pred <> 0 THEN 1.0 ELSE 0.0 END AS taken FROM pred)"""
DM = """
ls AS (SELECT model, date, AVG((y_true - y_pred) * (y_true - y_pred)) AS loss FROM pred GROUP BY model, date),
dd AS (SELECT a.model AS model_a, b.model AS model_b, a.loss - b.loss AS d FROM ls a JOIN ls b ON a.date = b.date AND a.model <> b.model),
dm AS (SELECT model_a, model_b, COUNT(*) AS n, AVG(d) AS mean_d, VAR_POP(d) AS v FROM dd GROUP BY model_a, model_b)"""
BT = """
na AS (SELECT COUNT(DISTINCT asset) AS n FROM pred),
po AS (SELECT model, date, asset, CAST(sign(y_pred) AS DOUBLE) / n AS wt, exp(y_true) - 1 AS ret FROM pred, na
  UNION ALL SELECT 'buy-and-hold', date, asset, 1.0 / n, exp(y_true) - 1 FROM (SELECT DISTINCT date, asset, y_true FROM pred), na),
mv AS (SELECT *, ABS(wt - LAG(wt, 1, 0.0) OVER (PARTITION BY model, asset ORDER BY date)) AS moved FROM po),
dy AS (SELECT model, date, SUM(wt * ret) AS gross_return, SUM(moved) AS turnover FROM mv GROUP BY model, date),
cs AS (SELECT * FROM (VALUES (0.0::DOUBLE), (10.0::DOUBLE)) c(cost_bps)),
nt AS (SELECT model, cost_bps, date, gross_return, turnover, turnover * cost_bps * 1e-4 AS cost, gross_return - turnover * cost_bps * 1e-4 AS net_return FROM dy, cs),
cv AS (SELECT *, product(1 + net_return) OVER (PARTITION BY model, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM nt),
dr AS (SELECT *, GREATEST(equity, 0) / GREATEST(1.0, MAX(equity) OVER (PARTITION BY model, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM cv),
bt AS (SELECT model, cost_bps, COUNT(*) AS n_days, AVG(turnover) AS mean_turnover, arg_max(equity, date) AS last, STDDEV_SAMP(net_return) AS sd, AVG(net_return) AS av, LEAST(MIN(drawdown), 0) AS max_drawdown FROM dr GROUP BY model, cost_bps)"""
EVENTS = """
ev AS (SELECT * FROM (VALUES ('alpha', DATE '1997-03-03', 'Alpha', 'ref-1'), ('beta', DATE '1998-08-17', 'Beta', ''), ('gamma', DATE '2000-04-10', 'Gamma', 'ref-3')) e(event_key, event_date, label, citation)),
gr AS (SELECT *, event_date + CAST(o AS INTEGER) AS target, CAST(o AS INTEGER) AS offset_days FROM ev, (VALUES (-56), (-28), (0), (28), (56)) f(o)),
nu AS (SELECT event_key, offset_days, arg_min(date, ABS(date - target) * 2 + (CASE WHEN date > target THEN 1 ELSE 0 END)) AS date_used FROM gr, topo WHERE ABS(date - target) <= 3 GROUP BY event_key, offset_days),
lg AS (SELECT date, 'mean_correlation' AS metric, mean_correlation AS value FROM topo UNION ALL SELECT date, 'graph_density', graph_density FROM topo),
lp AS (SELECT *, (RANK() OVER (PARTITION BY metric ORDER BY value) - 1) * 1.0 / COUNT(*) OVER (PARTITION BY metric) AS percentile FROM lg),
st AS (SELECT g.event_key, g.event_date, g.label, m.metric, g.offset_days, n.date_used, l.value, CASE WHEN l.value IS NOT NULL THEN l.percentile END AS percentile
  FROM gr g CROSS JOIN (VALUES ('mean_correlation'), ('graph_density')) m(metric) LEFT JOIN nu n ON g.event_key = n.event_key AND g.offset_days = n.offset_days
  LEFT JOIN lp l ON l.date = n.date_used AND l.metric = m.metric),
es AS (SELECT *, 100 * (MAX(CASE WHEN offset_days = 56 THEN value END) OVER e - MAX(CASE WHEN offset_days = -56 THEN value END) OVER e) / NULLIF(MAX(CASE WHEN offset_days = -56 THEN value END) OVER e, 0) AS pct_change_clean,
  100 * (MAX(CASE WHEN offset_days = 28 THEN value END) OVER e - MAX(CASE WHEN offset_days = -28 THEN value END) OVER e) / NULLIF(MAX(CASE WHEN offset_days = -28 THEN value END) OVER e, 0) AS pct_change_local
  FROM st WINDOW e AS (PARTITION BY event_key, metric))"""


def sql(parts: list[str], select: str) -> str:
    """A query over the named expressions."""
    return "WITH " + ",".join([BASE, *parts]) + "\n" + select
