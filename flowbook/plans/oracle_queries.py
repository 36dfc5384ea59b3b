"""DuckDB SQL for every registered query that is expressible in SQL."""

from __future__ import annotations

from flowbook.plans import oracle as O

SQL: dict[str, str] = {}


def sig(expr: str, digits: int = 9) -> str:
    e = f"(floor(log10(abs({expr}))) - {digits - 1})"
    return (f"(CASE WHEN ({expr}) = 0 THEN 0.0 WHEN {e} >= 0 "
            f"THEN round(({expr}) / pow(10.0, {e})) * pow(10.0, {e}) "
            f"ELSE round(({expr}) * pow(10.0, -{e})) / pow(10.0, -{e}) END + 0.0)")


SQL["features_a"] = f"""{O.with_views(O.MARKET_EVENTS)}
SELECT row_id,
  {O.select_features(O.features_a_exprs())}
FROM market_events"""

SQL["features_a_plus"] = f"""{O.with_views(O.MARKET_EVENTS)}
SELECT row_id,
  {O.select_features(O.features_a_plus_exprs("bid_qty"))}
FROM market_events"""

SQL["features_b"] = f"""{O.with_views(O.MARKET_EVENTS)}
SELECT row_id,
  {O.select_features(O.features_b_exprs())}
FROM market_events"""

_bulk_feats = ",\n    ".join(f"{O.fin(x)} AS {n}" for n, x in O.features_a_exprs())
_bulk_sums = ",\n  ".join(f"{sig(f'sum({n})')} AS sum_{n}" for n, _ in O.features_a_exprs())
SQL["features_a_bulk"] = f"""{O.with_views(O.MARKET_LINEITEM)},
fa AS (SELECT l_returnflag,
    {_bulk_feats}
  FROM market_lineitem)
SELECT l_returnflag, count(*) AS n,
  {_bulk_sums}
FROM fa GROUP BY l_returnflag"""


# ------------------------------------------------------------------ cleaning
MARKET = ["bid_qty", "ask_qty", "buy_qty", "sell_qty", "volume"]
MARKET_L = MARKET + ["label"]


def dirty_cols(cols: list[str], dirty: list[str]) -> str:
    out = []
    for c in cols:
        if c in dirty:
            out.append(f"CASE WHEN row_id % 50 = 0 THEN NULL WHEN row_id % 51 = 0 THEN 'inf'::DOUBLE "
                       f"WHEN row_id % 53 = 0 THEN 'nan'::DOUBLE ELSE {c} END AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def r6all(cols: list[str]) -> str:
    return ", ".join(f"{O.r6(f'CAST({c} AS DOUBLE)')} AS {c}" for c in cols)


ME = O.with_views(O.MARKET_EVENTS)
COLQ = '"column"'
EV_COLS = ["row_id", "ts"] + MARKET_L


def dirty_view(dirty: list[str]) -> str:
    return f"{ME}, d AS (SELECT {dirty_cols(EV_COLS, dirty)} FROM market_events)"


def fin_or_null(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


SQL["inf_to_null"] = f"""{dirty_view(['bid_qty', 'volume'])}
SELECT row_id, {", ".join(f"{O.r6(fin_or_null(c))} AS {c}" for c in MARKET_L)} FROM d"""

SQL["null_profile"] = f"""{dirty_view(['bid_qty', 'buy_qty', 'label'])},
p AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS {COLQ}, count_if(NOT coalesce(isfinite({c}), false)) AS nulls FROM d" for c in MARKET_L)}
  UNION ALL SELECT 'row_id', count_if(row_id IS NULL) FROM d
  UNION ALL SELECT 'ts', count_if(ts IS NULL) FROM d)
SELECT "column", nulls FROM p WHERE nulls > 0"""

SQL["drop_null_columns"] = f"""{ME}
SELECT row_id, ts, {r6all(['bid_qty', 'buy_qty', 'volume', 'label'])} FROM market_events"""

SQL["drop_inf_columns"] = f"""{ME}
SELECT row_id, ts, {r6all(MARKET_L)},
  {O.r6("CASE WHEN row_id % 50 <> 0 THEN ask_qty END")} AS x_partial,
  CAST(NULL AS DOUBLE) AS x_empty,
  {O.r6("CAST(row_id % 17 AS DOUBLE) * 0.25")} AS x_signal
FROM market_events"""

SQL["drop_all_null_columns"] = f"""{ME}
SELECT row_id, ts, {r6all(MARKET_L)},
  {O.r6("CASE WHEN row_id % 50 <> 0 THEN ask_qty END")} AS x_partial,
  {O.r6("CAST(row_id % 17 AS DOUBLE) * 0.25")} AS x_signal
FROM market_events"""

SQL["drop_null_rows"] = f"""{dirty_view(['bid_qty', 'label'])}
SELECT row_id, {r6all(MARKET_L)} FROM d
WHERE bid_qty IS NOT NULL AND NOT isnan(bid_qty) AND label IS NOT NULL AND NOT isnan(label)"""

SQL["fill_null"] = f"""{dirty_view(['bid_qty', 'volume'])}
SELECT row_id, {", ".join(f"{O.r6(f'CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE {c} END')} AS {c}" for c in MARKET_L)}
FROM d"""

SQL["sanitize"] = f"""{dirty_view(['bid_qty', 'sell_qty', 'label'])}
SELECT row_id, {", ".join(f"{O.r6(O.fin(c))} AS {c}" for c in MARKET_L)} FROM d"""

SQL["finite_label"] = f"""{dirty_view(['label'])}
SELECT row_id, {r6all(MARKET_L)} FROM d WHERE isfinite(label)"""

SQL["align_columns"] = f"""{O.with_views(O.MARKET_LINEITEM)}
SELECT {r6all(MARKET_L)} FROM market_lineitem"""


def _narrow_case(c: str, kind: str) -> str:
    if kind == "int":
        return (f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
                f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
                f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END")
    fmax = "3.4028234663852886e38"
    return f"CASE WHEN min({c}) > -{fmax} AND max({c}) < {fmax} THEN 'float' ELSE 'double' END"


_NARROW = [("event_id", "bigint", "int"), ("user_id", "bigint", "int"), ("value", "double", "float"),
           ("small_int", "int", "int"), ("value_e6", "double", "float"), ("value_e40", "double", "float")]
SQL["narrow_types"] = """WITH n AS (
  SELECT event_id, user_id, value, CAST(event_id % 100 AS INTEGER) AS small_int,
         value * 1e6 AS value_e6, value * 1e40 AS value_e40 FROM events)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"'{t}' AS from_type, {_narrow_case(c, k)} AS to_type FROM n" for c, t, k in _NARROW)

SQL["category_to_int"] = """SELECT CAST(CAST(l_linenumber AS VARCHAR) AS INTEGER) AS cat, count(*) AS n
FROM lineitem GROUP BY 1"""

SQL["policy_p1"] = f"""{ME}
SELECT row_id, ts, {r6all(['bid_qty', 'buy_qty', 'volume'])} FROM market_events"""

_p2_src = f"""{ME},
src AS (
  SELECT row_id, ts,
    CASE WHEN row_id % 50 = 0 OR row_id % 51 = 0 OR row_id % 53 = 0 THEN NULL ELSE bid_qty END AS bid_qty,
    ask_qty, buy_qty, sell_qty, volume, label,
    CAST(row_id % 17 AS DOUBLE) * 0.25 AS x_signal
  FROM market_events),
clean AS (SELECT * FROM src WHERE bid_qty IS NOT NULL)"""
_p2_feats = O.features_a_exprs() + O.features_a_plus_exprs("x_signal")
SQL["policy_p2"] = f"""{_p2_src}
SELECT row_id, {O.select_features(_p2_feats)}, {", ".join(f"{O.r6(O.fin(c))} AS {c}" for c in MARKET_L)}
FROM clean"""

# ------------------------------------------------------------------ row statistics
_XS = "list_filter(x, lambda v: v IS NOT NULL AND NOT isnan(v))"


def row_stat_exprs(x: str = "x") -> list[tuple[str, str]]:
    xs = _XS.replace("x,", f"{x},", 1)
    mean = f"list_avg({xs})"
    return [
        ("x_stat_mean", mean),
        ("x_stat_std", f"list_aggregate({xs}, 'stddev_samp')"),
        ("x_stat_range", f"list_max({xs}) - list_min({xs})"),
        ("x_stat_median", f"list_aggregate({xs}, 'quantile_cont', 0.5)"),
        ("x_stat_p25", f"list_aggregate({xs}, 'quantile_cont', 0.25)"),
        ("x_stat_p75", f"list_aggregate({xs}, 'quantile_cont', 0.75)"),
        ("x_stat_above_mean_count", f"CAST(len(list_filter({xs}, lambda v: v > {mean})) AS DOUBLE)"),
        ("x_stat_idx_max", f"CAST(list_position({x}, list_max({xs})) AS DOUBLE)"),
        ("x_stat_idx_min", f"CAST(list_position({x}, list_min({xs})) AS DOUBLE)"),
    ]


SIG = O.with_views(O.SIGNALS)
SQL["row_stats"] = f"""{SIG}
SELECT row_id, {", ".join(f"{O.r6(O.fin(e))} AS {n}" for n, e in row_stat_exprs()[:7])} FROM signals"""

SQL["row_argext"] = f"""{SIG}
SELECT row_id, {", ".join(f"{O.r6(O.fin(e))} AS {n}" for n, e in row_stat_exprs()[7:])} FROM signals"""

_MS = f"""{O.with_views(O.MARKET_EVENTS, O.SIGNALS)},
ms AS (SELECT m.*, s.x FROM market_events m JOIN signals s ON s.row_id = m.row_id % (SELECT count(*) FROM signals)),
st AS (SELECT *, {", ".join(f"{O.fin(e)} AS {n}" for n, e in row_stat_exprs())} FROM ms)"""


def _ln(m: str) -> str:
    return f"(CASE WHEN {m} > 0 THEN ln({m}) END)"


SQL["log_interactions"] = f"""{_MS}
SELECT row_id, {", ".join(
    f"{O.r6(O.fin(f'x[{i + 1}] * {_ln(m)}'))} AS X{i + 1}_log_x_{m}"
    for m in ["volume", "buy_qty", "sell_qty", "x_stat_mean", "x_stat_median"] for i in range(64))}
FROM st"""

_B_FLOAT = ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in MARKET_L)
SQL["policy_p3"] = f"""{O.with_views(O.MARKET_EVENTS, O.SIGNALS)},
ms AS (SELECT CAST(m.row_id AS SMALLINT) AS row_id, {_B_FLOAT.replace('CAST(', 'CAST(m.')},
          list_transform(s.x, lambda v: CASE WHEN isfinite(v) THEN v ELSE 0.0 END) AS x
       FROM market_events m JOIN signals s ON s.row_id = m.row_id % (SELECT count(*) FROM signals)),
f AS (SELECT row_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MARKET_L)}, x FROM ms
      WHERE isfinite(label))
SELECT row_id, {", ".join(f"{O.r6(O.fin(c))} AS {c}" for c in MARKET_L)},
  {O.select_features(O.features_b_exprs())},
  {", ".join(f"{O.r6(O.fin(e))} AS {n}" for n, e in row_stat_exprs())}
FROM f"""


# ------------------------------------------------------------------ ordering
POS = "(row_number() OVER (ORDER BY ts, row_id) - 1)"

SQL["sort_by_time"] = f"{ME}\nSELECT row_id, ts FROM market_events"
SQL["global_position"] = f"{ME}\nSELECT row_id, ts, {POS} AS pos FROM market_events"
SQL["chrono_split"] = f"""{ME}
SELECT row_id, CASE WHEN {POS} < CAST(floor(count(*) OVER () * 0.8) AS BIGINT) THEN 'train' ELSE 'valid' END AS split
FROM market_events"""
SQL["random_split"] = f"""{ME}
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) - 1
       < CAST(ceil(count(*) OVER () * 0.3) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM market_events"""


def fold_sql(pos: str, n: str, k: int = 5) -> str:
    q = f"({n} // {k})"
    r = f"({n} % {k})"
    big = f"({r} * ({q} + 1))"
    return (f"CAST(CASE WHEN {pos} < {big} THEN {pos} // ({q} + 1) "
            f"ELSE {r} + ({pos} - {big}) // {q} END AS INTEGER)")


SQL["contiguous_kfold"] = f"""{ME},
p AS (SELECT row_id, {POS} AS pos, count(*) OVER () AS n FROM market_events)
SELECT row_id, {fold_sql('pos', 'n')} AS fold FROM p"""
SQL["shuffled_kfold"] = f"""{ME},
p AS (SELECT row_id, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || ':37'), row_id) - 1 AS pos,
             count(*) OVER () AS n FROM market_events)
SELECT row_id, {fold_sql('pos', 'n')} AS fold FROM p"""
SQL["fold_filter"] = f"""{ME},
p AS (SELECT row_id, label, {POS} AS pos, count(*) OVER () AS n FROM market_events)
SELECT row_id, {r6all(['label'])} FROM p WHERE {fold_sql('pos', 'n')} = 4"""
SQL["top_k"] = f"""{ME}
SELECT row_id, {r6all(['label'])} FROM market_events ORDER BY label DESC, row_id LIMIT 80"""

_RES = f"""{ME},
r AS (SELECT *, abs(label - avg(label) OVER ()) AS residual FROM market_events)"""
SQL["nth_largest"] = f"""{_RES},
k AS (SELECT greatest(1, CAST(floor(0.001 * count(*)) AS BIGINT)) AS n_out FROM r)
SELECT (SELECT n_out FROM k) AS n_out,
       {O.r6("(SELECT min(residual) FROM (SELECT residual FROM r ORDER BY residual DESC LIMIT (SELECT n_out FROM k)))")} AS threshold"""

# ------------------------------------------------------------------ scaling
def _nz(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR abs({x}) < 2.220446049250313e-15 THEN 1.0 ELSE {x} END)"


_TRAIN = f"""{ME},
p AS (SELECT *, {POS} AS pos, count(*) OVER () AS n FROM market_events),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MARKET_L)}
       FROM p WHERE pos < CAST(floor(n * 0.8) AS BIGINT))"""
SQL["standardize"] = f"""{_TRAIN}
SELECT row_id, {", ".join(f"{O.r6(f'({c} - m_{c}) / {_nz(f's_{c}')}')} AS {c}" for c in MARKET_L)}
FROM market_events, st"""

SQL["label_scale_roundtrip"] = f"""{ME},
st AS (SELECT avg(label) AS m, stddev_pop(label) AS s FROM market_events),
z AS (SELECT row_id, (label - m) / {_nz('s')} AS label_z, m, s FROM market_events, st)
SELECT row_id, {O.r6('label_z')} AS label_z, {O.r6(f"label_z * {_nz('s')} + m")} AS label_back FROM z"""

SQL["minmax_scale"] = f"""{ME},
st AS (SELECT {", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in MARKET_L)} FROM market_events)
SELECT row_id, {", ".join(f"{O.r6(f'({c} - a_{c}) / {_nz(f'(b_{c} - a_{c})')}')} AS {c}" for c in MARKET_L)}
FROM market_events, st"""

SQL["robust_scale"] = f"""{ME},
st AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in MARKET)}
       FROM market_events)
SELECT row_id, {", ".join(f"{O.r6(f'({c} - md_{c}) / {_nz(f'(q3_{c} - q1_{c})')}')} AS {c}" for c in MARKET)}
FROM market_events, st"""

# ------------------------------------------------------------------ metrics
_PRED = f"""{ME},
pr AS (SELECT *, (buy_qty - sell_qty) / (volume + 2.0) AS prediction FROM market_events)"""


def metric_sql(t: str = "label", p: str = "prediction") -> str:
    sse = f"sum(({t} - {p}) * ({t} - {p}))"
    sst = f"(var_pop({t}) * count({t}))"
    return ", ".join([
        f"{O.r6(f'covar_pop({t}, {p}) / (stddev_pop({t}) * stddev_pop({p}))')} AS pearson",
        f"{O.r6(f'CASE WHEN {sst} > 0 THEN 1.0 - {sse} / {sst} WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END')} AS r2",
        f"{O.r6(f'avg(abs({t} - {p}))')} AS mae",
        f"{O.r6(f'sqrt(avg(({t} - {p}) * ({t} - {p})))')} AS rmse",
        f"{O.r6(f'avg(({t} - {p}) * ({t} - {p}))')} AS mse",
        "count(*) AS n",
    ])


SQL["regression_metrics"] = f"{_PRED}\nSELECT {metric_sql()} FROM pr"


def _lost(c: str, shift: int) -> str:
    k = f"(row_id + {shift})"
    return f"CASE WHEN {k} % 50 <> 0 AND {k} % 51 <> 0 AND {k} % 53 <> 0 THEN {c} END"


_PAIRS = f"""{_PRED},
lost AS (SELECT row_id, {_lost('label', 0)} AS label, {_lost('prediction', 7)} AS prediction FROM pr),
pairs AS (SELECT * FROM lost WHERE label IS NOT NULL AND prediction IS NOT NULL)"""
SQL["regression_metrics_dirty"] = f"{_PAIRS}\nSELECT {metric_sql()} FROM pairs"
SQL["prediction_correlation_dirty"] = f"""{_PAIRS}
SELECT {O.r6('covar_pop(label, prediction) / (stddev_pop(label) * stddev_pop(prediction))')} AS pearson, count(*) AS n FROM pairs"""
_LOST = f"""{ME},
lost AS (SELECT row_id, {", ".join(f"{_lost(c, 7 * i)} AS {c}" for i, c in enumerate(MARKET_L))} FROM market_events)"""
SQL["standardize_dirty"] = f"""{_LOST},
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MARKET)} FROM lost)
SELECT row_id, {", ".join(f"{O.r6(f'({c} - m_{c}) / {_nz(f's_{c}')}')} AS {c}" for c in MARKET)} FROM lost, st"""
SQL["minmax_scale_dirty"] = f"""{_LOST},
st AS (SELECT {", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in MARKET)} FROM lost)
SELECT row_id, {", ".join(f"{O.r6(f'({c} - a_{c}) / {_nz(f'(b_{c} - a_{c})')}')} AS {c}" for c in MARKET)} FROM lost, st"""
SQL["f_score_dirty"] = f"""{_LOST},
r AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, covar_pop({c}, label) / (stddev_pop({c}) * stddev_pop(label)) AS r, count(*) AS n FROM lost WHERE {c} IS NOT NULL AND label IS NOT NULL" for c in MARKET)})
SELECT feature, {O.r6('r')} AS r, {sig('r * r / (1.0 - r * r) * (n - 2)', 8)} AS f_score FROM r"""
SQL["global_position_null_keys"] = f"""{ME}
SELECT row_id, row_number() OVER (ORDER BY CASE WHEN row_id % 3 <> 0 THEN CAST(bid_qty AS DECIMAL(20,4)) END NULLS FIRST, row_id) - 1 AS pos
FROM market_events"""
SQL["metrics_by_fold"] = f"""{_PRED},
p AS (SELECT *, {POS} AS pos, count(*) OVER () AS n_all FROM pr),
f AS (SELECT *, {fold_sql('pos', 'n_all')} AS fold FROM p)
SELECT fold, {metric_sql()} FROM f GROUP BY fold"""
SQL["batch_mean_loss"] = f"""{_PRED},
p AS (SELECT *, {POS} AS pos FROM pr),
b AS (SELECT pos // 256 AS batch_id, avg((label - prediction) * (label - prediction)) AS bl FROM p GROUP BY 1)
SELECT {O.r6('avg(bl)')} AS loss, count(*) AS batches FROM b"""

_ATTACH = f"""{_PRED},
ids AS (SELECT {POS} + 1 AS "ID", prediction FROM pr),
tmpl AS (SELECT event_id + 1 AS "ID", value AS template_prediction FROM events),
j AS (SELECT t."ID", i.prediction, t.template_prediction FROM tmpl t LEFT JOIN ids i ON t."ID" = i."ID")"""
SQL["attach_predictions"] = f"""{_ATTACH}
SELECT "ID", {O.r6('prediction')} AS prediction, {O.r6('template_prediction')} AS template_prediction FROM j"""
SQL["prediction_correlation"] = f"""{_ATTACH}
SELECT {O.r6('covar_pop(template_prediction, prediction) / (stddev_pop(template_prediction) * stddev_pop(prediction))')} AS pearson,
       count(*) AS n
FROM j WHERE prediction IS NOT NULL AND template_prediction IS NOT NULL"""

# ------------------------------------------------------------------ weights
SQL["time_decay_weights"] = f"""{ME},
p AS (SELECT row_id, {POS} AS pos, count(*) OVER () AS n FROM market_events),
f AS (SELECT *, {fold_sql('pos', 'n')} AS fold FROM p),
t AS (SELECT row_id, row_number() OVER (ORDER BY pos) - 1 AS tp, count(*) OVER () AS nt FROM f WHERE fold <> 4),
w AS (SELECT row_id, pow(0.95, 1.0 - tp / (nt - 1.0)) AS w, nt FROM t)
SELECT row_id, {O.r6('w * nt / sum(w) OVER ()')} AS weight FROM w"""

SQL["outlier_downweight"] = f"""{_RES},
p AS (SELECT row_id, residual, {POS} AS pos, count(*) OVER () AS n FROM r),
w0 AS (SELECT row_id, residual, pow(0.95, 1.0 - pos / (n - 1.0)) AS w, n FROM p),
w1 AS (SELECT row_id, residual, w * n / sum(w) OVER () AS weight FROM w0),
k AS (SELECT greatest(1, CAST(floor(0.001 * count(*)) AS BIGINT)) AS n_out FROM w1),
thr AS (SELECT min(residual) AS t FROM (SELECT residual FROM w1 ORDER BY residual DESC LIMIT (SELECT n_out FROM k))),
mm AS (SELECT min(residual) AS lo, max(residual) AS hi FROM w1, thr WHERE residual >= t)
SELECT row_id, {O.r6('CASE WHEN residual >= t THEN weight * (0.8 - 0.6 * ((residual - lo) / (hi - lo + 1e-8))) ELSE weight END')} AS weight
FROM w1, thr, mm"""

# ------------------------------------------------------------------ selection / ridge
_FA = f"""{ME},
fa AS (SELECT label, {", ".join(f"{O.fin(x)} AS {n}" for n, x in O.features_a_exprs())} FROM market_events),
u AS (UNPIVOT fa ON {", ".join(n for n, _ in O.features_a_exprs())} INTO NAME feature VALUE v),
r AS (SELECT feature, covar_pop(v, label) / (stddev_pop(v) * stddev_pop(label)) AS r, count(*) AS n
      FROM u GROUP BY feature)"""
SQL["f_score_top_k"] = f"""{_FA}
SELECT feature, {sig('r * r / (1.0 - r * r) * (n - 2)', 6)} AS f_score FROM r
WHERE isfinite(r * r / (1.0 - r * r))
ORDER BY r * r / (1.0 - r * r) * (n - 2) DESC, feature LIMIT 20"""

SQL["parquet_load"] = """
SELECT side, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem, (VALUES ('train'), ('valid')) AS s(side) GROUP BY side, l_returnflag"""
SQL["csv_round_trip"] = 'SELECT event_id + 1 AS "ID", value AS prediction FROM events'
SQL["stamped_csv"] = f"""{_PRED},
old AS (SELECT event_id AS row_id, value AS old FROM events),
r AS (SELECT covar_pop(old, prediction) / (stddev_pop(old) * stddev_pop(prediction)) AS r FROM pr JOIN old USING (row_id))
SELECT row_id + 1 AS "ID", {O.r6('prediction')} AS prediction, 'pred_piereson_cor' || printf('%.6f', r) || '.csv' AS file FROM pr, r"""
SQL["model_round_trip"] = f"""{ME},
w AS (SELECT regr_slope(label, buy_qty) AS slope, regr_intercept(label, buy_qty) AS start FROM market_events)
SELECT row_id, {O.r6('start + slope * buy_qty')} AS fitted FROM market_events, w"""
SQL["sort_by_time_order"] = f"{ME}\nSELECT count(*) AS n, true AS in_order FROM market_events"
SQL["ridge_head"] = f"""{ME},
s AS (SELECT covar_pop(buy_qty, label) * count(*) AS sxy, var_pop(buy_qty) * count(*) AS sxx,
             avg(buy_qty) AS mx, avg(label) AS my FROM market_events),
w AS (SELECT sxy / (sxx + 0.1) AS coef, mx, my FROM s)
SELECT {sig('coef', 6)} AS coef, {sig('my - coef * mx', 6)} AS intercept FROM w"""


# streaming parity: the stream must produce exactly the batch result
SQL["features_a_stream"] = SQL["features_a"]

_bulk_b_feats = ",\n    ".join(f"{O.fin(x)} AS {n}" for n, x in O.features_b_exprs())
_bulk_b_sums = ",\n  ".join(f"{sig(f'sum({n})')} AS sum_{n}" for n, _ in O.features_b_exprs())
SQL["features_b_bulk"] = f"""{O.with_views(O.MARKET_LINEITEM)},
fb AS (SELECT l_returnflag,
    {_bulk_b_feats}
  FROM market_lineitem)
SELECT l_returnflag, count(*) AS n,
  {_bulk_b_sums}
FROM fb GROUP BY l_returnflag"""


def _wide_col(i: int) -> str:
    c = f"CASE WHEN (event_id + {i}) % {i + 7} <> 0 THEN value * {float(i)} END"
    if i % 7 == 3:
        c = f"CASE WHEN event_id % 101 = {i % 101} THEN 'inf'::DOUBLE ELSE {c} END"
    return c


SQL["wide_profile"] = ("WITH w AS (SELECT " + ", ".join(f"{_wide_col(i)} AS X{i}" for i in range(1, 897)) +
                       " FROM events), p AS (" +
                       " UNION ALL ".join(f"SELECT 'X{i}' AS {COLQ}, count_if(NOT coalesce(isfinite(X{i}), false)) AS nulls FROM w"
                                          for i in range(1, 897)) +
                       ") SELECT " + COLQ + ", nulls FROM p WHERE nulls > 0")

SQL["wide_profile_array"] = SQL["wide_profile"]


# ------------------------------------------------------------------ latent pair, networks
# Two standardised columns have the principal direction (1, sign r) / sqrt 2.
_PAIR = f"""{ME},
m AS (SELECT avg(bid_qty) AS ma, stddev_pop(bid_qty) AS sa, avg(buy_qty) AS mb, stddev_pop(buy_qty) AS sb, avg(label) AS my FROM market_events),
z AS (SELECT row_id, ts, label, (bid_qty - ma) / sa AS z1, (buy_qty - mb) / sb AS z2, my FROM market_events, m),
g AS (SELECT CASE WHEN avg(z1 * z2) >= 0 THEN 1.0 ELSE -1.0 END AS sgn FROM z),
l AS (SELECT z.*, sgn, (z1 + sgn * z2) / sqrt(2.0) AS code FROM z, g),
w AS (SELECT sum(code * (label - my)) / (sum(code * code) + 0.1) AS w FROM l),
s AS (SELECT row_id, ts, label, z1, z2, my + w * code AS prediction, code / sqrt(2.0) AS b1, sgn * code / sqrt(2.0) AS b2 FROM l, w)"""

SQL["latent_pair"] = f"""{_PAIR}
SELECT row_id, {O.r6('prediction')} AS prediction, {O.r6('b1')} AS bid_qty_back, {O.r6('b2')} AS buy_qty_back FROM s"""

SQL["composite_loss"] = f"""{_PAIR},
e AS (SELECT (label - prediction) ** 2 AS p, ((z1 - b1) ** 2 + (z2 - b2) ** 2) / 2 AS r, {POS} // 256 AS batch FROM s),
b AS (SELECT avg(p + 0.5 * r) AS loss FROM e GROUP BY batch)
SELECT {O.r6('avg(p)')} AS pred_mse, {O.r6('avg(r)')} AS recon_mse, {O.r6('avg(p) + 0.5 * avg(r)')} AS loss,
  {O.r6('(SELECT avg(loss) FROM b)')} AS batch_loss, (SELECT count(*) FROM b) AS batches FROM e"""


def network_sql(source: str, keys: str) -> str:
    """The example network's forward pass, layer by layer."""
    inputs = ["bid_qty", "ask_qty", "buy_qty", "sell_qty", "volume"]
    bias, mean, var, gamma, beta = [-0.1, 0.0, 0.1], [0.1, 0.2, 0.3], [1.0, 2.0, 3.0], [1.0, 0.5, 2.0], [0.0, 0.1, -0.1]
    sigmoid = "1.0 / (1.0 + exp(-({})))"
    first = []
    for j in range(3):
        total = " + ".join(f"{c} * ({((3 * j + 5 * i) % 7 - 3) / 1000}::DOUBLE)" for i, c in enumerate(inputs))
        first.append(f"(({total} + ({bias[j]})) - {mean[j]}) / sqrt({var[j]} + 0.00001::DOUBLE) * {gamma[j]} + ({beta[j]}) AS n{j}")
    swish = [f"n{j} * ({sigmoid.format(f'n{j}')}) AS h{j}" for j in range(3)]
    second = []
    for j, b in enumerate([0.1, -0.2, 0.3]):
        total = " + ".join(f"h{i} * ({((j + 2 * i) % 5 - 2) / 4}::DOUBLE)" for i in range(3))
        second.append(f"{sigmoid.format(f'{total} + ({b})')} + h{j} AS k{j}")
    return (f"n AS (SELECT {keys}, {', '.join(first)} FROM {source}),\nh AS (SELECT {keys}, {', '.join(swish)} FROM n),\n"
            f"k AS (SELECT {keys}, {', '.join(second)} FROM h)\nSELECT {keys}, {O.r6('0.5 * k0 - k1 + 0.25 * k2 + 0.05')} AS prediction FROM k")


SQL["batch_scoring"] = f"{O.with_views(O.MARKET_LINEITEM)},\n{network_sql('market_lineitem', 'l_returnflag')}"
SQL["stream_scoring"] = f"{ME},\n{network_sql('market_events', 'row_id')}"


# ------------------------------------------------------------------ one-split fits
def stump_sql(rows: str, by: str) -> str:
    """The best split of feature m, by weighted squared error, for each ``by``
    group of ``rows`` (by, m, w, y): thr, and the means left and right of it."""
    return f"""
v AS (SELECT {by} AS f, m, sum(w) AS w, sum(w * y) AS s FROM {rows} GROUP BY {by}, m),
c AS (SELECT f, m, sum(w) OVER l AS wl, sum(s) OVER l AS sl, sum(w) OVER a AS wa, sum(s) OVER a AS sa FROM v
      WINDOW l AS (PARTITION BY f ORDER BY m), a AS (PARTITION BY f)),
b AS (SELECT f, arg_max(struct_pack(thr := m, lo := sl / wl, hi := (sa - sl) / (wa - wl)), sl * sl / wl + (sa - sl) * (sa - sl) / (wa - wl)) AS t
      FROM c WHERE m < 6 GROUP BY f)"""


_ONE = f"""{ME},
p AS (SELECT row_id, label AS y, row_id % 7 AS m, {POS} AS pos, count(*) OVER () AS n FROM market_events),
q AS (SELECT *, {fold_sql('pos', 'n')} AS fold FROM p)"""
_FOLDS = f"""{_ONE},
k AS (SELECT unnest(range(5)) AS f),
o AS (SELECT f, m, y, row_number() OVER (PARTITION BY f ORDER BY pos) - 1 AS tpos, count(*) OVER (PARTITION BY f) AS cnt FROM q, k WHERE fold <> f),
r AS (SELECT f, m, y, pow(0.95::DOUBLE, 1 - tpos / (cnt - 1)::DOUBLE) AS w FROM o),{stump_sql('r', 'f')}"""
_PREDICTED = "CASE WHEN q.m <= b.t.thr THEN b.t.lo ELSE b.t.hi END"
SQL["fold_stumps"] = f"""{_FOLDS}
SELECT row_id, fold, {O.r6(_PREDICTED)} AS prediction FROM q JOIN b ON b.f = q.fold"""
SQL["stump_ensemble"] = f"""{_FOLDS}
SELECT row_id, {O.r6(f"avg({_PREDICTED})")} AS prediction FROM q, b GROUP BY row_id"""
_WHOLE = f"""{_ONE},
r AS (SELECT 0 AS f, m, y, 1.0::DOUBLE AS w FROM q),{stump_sql('r', 'f')}"""
SQL["refit_stump"] = f"""{_WHOLE}
SELECT row_id, {O.r6(_PREDICTED)} AS prediction FROM q, b"""
_FIRST = f"""{_ONE},
r AS (SELECT 0 AS f, m, y, 1.0::DOUBLE AS w FROM q WHERE pos < CAST(floor(n * 0.8) AS BIGINT)),{stump_sql('r', 'f')},
e AS (SELECT pos < CAST(floor(n * 0.8) AS BIGINT) AS train, y, {_PREDICTED} AS h FROM q, b)"""
SQL["shap_stump"] = f"""{_FIRST},
g AS (SELECT avg(h) AS mean FROM e WHERE train),
i AS (SELECT avg(abs(h - mean)) AS importance FROM e, g WHERE train)
SELECT 'm7' AS feature, {sig('importance', 6)} AS importance FROM i"""
SQL["early_stopping_stump"] = f"""{_FIRST}
SELECT 1::INTEGER AS round, {O.r6('sqrt(avg((y - h) ** 2) FILTER (WHERE train))')} AS train_loss,
  {O.r6('sqrt(avg((y - h) ** 2) FILTER (WHERE NOT train))')} AS held_out_loss, true AS kept FROM e"""

SQL["regularised_stump"] = f"""{_ONE},
a AS (SELECT avg(y) AS base FROM q),
v AS (SELECT m, sum(base - y) AS g, count(*)::DOUBLE AS h FROM q, a GROUP BY m),
c AS (SELECT m, sum(g) OVER (ORDER BY m) AS gl, sum(h) OVER (ORDER BY m) AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h FROM v),
d AS (SELECT m, hl, h - hl AS hr, sign(gl) * greatest(abs(gl) - 0.5, 0) AS tl, sign(g - gl) * greatest(abs(g - gl) - 0.5, 0) AS tr,
        sign(g) * greatest(abs(g) - 0.5, 0) AS t, h FROM c WHERE m < 6),
e AS (SELECT *, tl * tl / (hl + 75.4484) + tr * tr / (hr + 75.4484) - t * t / (h + 75.4484) AS gain FROM d WHERE hl >= 16 AND hr >= 16),
b AS (SELECT m AS thr, -tl / (hl + 75.4484) AS lo, -tr / (hr + 75.4484) AS hi FROM e WHERE gain > 1e-6 ORDER BY gain DESC, m LIMIT 1)
SELECT row_id, {O.r6("base + coalesce(CASE WHEN q.m <= b.thr THEN b.lo ELSE b.hi END, 0.0)")} AS prediction
FROM q CROSS JOIN a LEFT JOIN b ON true"""
