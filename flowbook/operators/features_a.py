"""Order-flow / depth / liquidity feature map, set A (58 columns) and A+ (11 more).

Row-wise and stateless: the whole set is one projection of Column
expressions (shared sub-expressions are left to Catalyst's
subexpression elimination), followed by the sanitising projection.
Because it is a pure projection it runs unchanged on streaming DataFrames.

Division follows IEEE-then-sanitise semantics: ``try_divide`` yields NULL
where IEEE would give inf/NaN, and the final ``finite_or_zero`` maps both to 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbook.functions.numeric import div, finite_or_zero
from flowbook.session import tune_session

# Epsilons used by the feature formulas.
EPS_A = 1e-10
EPS_A_PLUS = 1e-6


@dataclass(frozen=True)
class MarketColumns:
    bid: str = "bid_qty"
    ask: str = "ask_qty"
    buy: str = "buy_qty"
    sell: str = "sell_qty"
    volume: str = "volume"

    def names(self) -> list[str]:
        return [self.bid, self.ask, self.buy, self.sell, self.volume]


def _set_a(m: MarketColumns) -> list[tuple[str, Column]]:
    b, a, p, s, v = (F.col(c).cast("double") for c in m.names())
    e = F.lit(EPS_A)
    nof = p - s
    td = b + a
    ofi = div(p - s, p + s + e)
    v_e = v + e
    td_e = td + e
    depth_imb = div(b - a, td_e)
    spread = F.abs(b - a)
    return [
        ("bid_ask_interaction", b * a),
        ("bid_buy_interaction", b * p),
        ("bid_sell_interaction", b * s),
        ("ask_buy_interaction", a * p),
        ("ask_sell_interaction", a * s),
        ("volume_weighted_sell", s * v),
        ("buy_sell_ratio", div(p, s + e)),
        ("selling_pressure", div(s, v_e)),
        ("log_volume", F.log1p(v)),
        ("effective_spread_proxy", div(F.abs(p - s), v_e)),
        ("bid_ask_imbalance", div(b - a, b + a + e)),
        ("order_flow_imbalance", ofi),
        ("liquidity_ratio", div(b + a, v_e)),
        ("net_order_flow", nof),
        ("normalized_net_flow", div(nof, v_e)),
        ("buying_pressure", div(p, v_e)),
        ("volume_weighted_buy", p * v),
        ("total_depth", td),
        ("depth_imbalance", depth_imb),
        ("relative_spread", div(F.abs(b - a), td_e)),
        ("log_depth", F.log1p(td)),
        ("kyle_lambda", div(F.abs(nof), v_e)),
        ("flow_toxicity", F.abs(ofi) * v),
        ("aggressive_flow_ratio", div(p + s, td_e)),
        ("volume_depth_ratio", div(v, td_e)),
        ("activity_intensity", div(p + s, v_e)),
        ("log_buy_qty", F.log1p(p)),
        ("log_sell_qty", F.log1p(s)),
        ("log_bid_qty", F.log1p(b)),
        ("log_ask_qty", F.log1p(a)),
        ("realized_spread_proxy", div(F.lit(2.0) * F.abs(nof), v_e)),
        ("price_impact_proxy", div(nof, td_e)),
        ("quote_volatility_proxy", F.abs(depth_imb)),
        ("flow_depth_interaction", nof * td),
        ("imbalance_volume_interaction", ofi * v),
        ("depth_volume_interaction", td * v),
        ("buy_sell_spread", F.abs(p - s)),
        ("bid_ask_spread", spread),
        ("trade_informativeness", div(nof, b + a + e)),
        ("execution_shortfall_proxy", div(F.abs(p - s), v_e)),
        ("adverse_selection_proxy", div(nof, td_e) * v),
        ("fill_probability", div(v, p + s + e)),
        ("execution_rate", div(p + s, td_e)),
        ("market_efficiency", div(v, spread + e)),
        ("sqrt_volume", F.sqrt(v)),
        ("sqrt_depth", F.sqrt(td)),
        ("volume_squared", F.pow(v, F.lit(2.0))),
        ("imbalance_squared", F.pow(ofi, F.lit(2.0))),
        ("bid_ratio", div(b, td_e)),
        ("ask_ratio", div(a, td_e)),
        ("buy_ratio", div(p, p + s + e)),
        ("sell_ratio", div(s, p + s + e)),
        ("liquidity_consumption", div(p + s, td_e)),
        ("market_stress", div(v, td_e) * F.abs(ofi)),
        ("depth_depletion", div(v, b + a + e)),
        ("net_buying_ratio", div(nof, v_e)),
        ("directional_volume", nof * F.log1p(v)),
        ("signed_volume", F.signum(nof) * v),
    ]


def _set_a_plus(m: MarketColumns, x293: Column) -> list[tuple[str, Column]]:
    b, a, p, s, v = (F.col(c).cast("double") for c in m.names())
    e = F.lit(EPS_A)
    e6 = F.lit(EPS_A_PLUS)
    sqrt_v = F.sqrt(v)
    log_v = F.log1p(v)
    activity = div(p + s, v + e)
    fill = div(v, p + s + e)
    log_sell = F.log1p(s)
    log_buy = F.log1p(p)
    return [
        ("ask_buy_interaction_x_X293", x293 * (a * p)),
        ("sqrt_volume_div_log_volume", div(sqrt_v, log_v + e6)),
        ("sqrt_volume_div_activity_intensity", div(sqrt_v, activity + e6)),
        ("sqrt_volume_mul_fill_probability", sqrt_v * fill),
        ("volume_div_sqrt_volume", div(v, sqrt_v + e6)),
        ("sqrt_volume_div_fill_probability", div(sqrt_v, fill + e6)),
        ("sqrt_volume_mul_activity_intensity", sqrt_v * activity),
        ("sqrt_volume_div_log_sell_qty", div(sqrt_v, log_sell + e6)),
        ("log_buy_qty_mul_sqrt_volume", log_buy * sqrt_v),
        ("sqrt_volume_mul_log_buy_qty", sqrt_v * log_buy),
        ("log_volume_mul_sqrt_volume", log_v * sqrt_v),
    ]


# Output column names of set A and set A+, in output order.
FEATURES_A = [
    "bid_ask_interaction", "bid_buy_interaction", "bid_sell_interaction", "ask_buy_interaction",
    "ask_sell_interaction", "volume_weighted_sell", "buy_sell_ratio", "selling_pressure", "log_volume",
    "effective_spread_proxy", "bid_ask_imbalance", "order_flow_imbalance", "liquidity_ratio",
    "net_order_flow", "normalized_net_flow", "buying_pressure", "volume_weighted_buy", "total_depth",
    "depth_imbalance", "relative_spread", "log_depth", "kyle_lambda", "flow_toxicity",
    "aggressive_flow_ratio", "volume_depth_ratio", "activity_intensity", "log_buy_qty", "log_sell_qty",
    "log_bid_qty", "log_ask_qty", "realized_spread_proxy", "price_impact_proxy", "quote_volatility_proxy",
    "flow_depth_interaction", "imbalance_volume_interaction", "depth_volume_interaction", "buy_sell_spread",
    "bid_ask_spread", "trade_informativeness", "execution_shortfall_proxy", "adverse_selection_proxy",
    "fill_probability", "execution_rate", "market_efficiency", "sqrt_volume", "sqrt_depth", "volume_squared",
    "imbalance_squared", "bid_ratio", "ask_ratio", "buy_ratio", "sell_ratio", "liquidity_consumption",
    "market_stress", "depth_depletion", "net_buying_ratio", "directional_volume", "signed_volume",
]
FEATURES_A_PLUS = [
    "ask_buy_interaction_x_X293", "sqrt_volume_div_log_volume", "sqrt_volume_div_activity_intensity",
    "sqrt_volume_mul_fill_probability", "volume_div_sqrt_volume", "sqrt_volume_div_fill_probability",
    "sqrt_volume_mul_activity_intensity", "sqrt_volume_div_log_sell_qty", "log_buy_qty_mul_sqrt_volume",
    "sqrt_volume_mul_log_buy_qty", "log_volume_mul_sqrt_volume",
]


def add_features_a(
    df: DataFrame,
    cols: MarketColumns = MarketColumns(),
    plus: bool = False,
    x293: str | Column = "X293",
    sanitize: bool = True,
    label: str = "label",
) -> DataFrame:
    """Append set A (and with ``plus=True`` set A+) to ``df``.

    ``sanitize`` applies C8 to every fractional column of the result, as the
    reference does after the feature map; ``label`` alone is left as it is, so
    that rows can still be filtered by it.
    """
    tune_session(df.sparkSession)  # else the formulas' methods are never compiled
    feats = _set_a(cols)
    if plus:
        xc = F.col(x293) if isinstance(x293, str) else x293
        feats = feats + _set_a_plus(cols, xc)
    new = {n for n, _ in feats}
    keep = [c for c in df.columns if c not in new]
    fields = {f.name: f.dataType for f in df.schema.fields}

    def out(c: str) -> Column:
        dt = fields[c]
        if c == label or not isinstance(dt, (T.FloatType, T.DoubleType)):
            return F.col(c)
        return finite_or_zero(F.col(c)).cast(dt).alias(c)

    # two projections: formulas once, then the sanitiser over their results
    # (a formula referenced twice is not inlined by CollapseProject, so the
    # generated code stays small enough for whole-stage codegen)
    raw = df.select(*[F.col(c) for c in keep], *[e.alias(n) for n, e in feats])
    if not sanitize:
        return raw
    return raw.select(*[out(c) for c in keep], *[finite_or_zero(F.col(n)).alias(n) for n, _ in feats])
