"""Microstructure feature map, set B (31 columns).

Eight names coincide with set A but several have a different meaning
(``bid_ask_spread`` is signed here, ``liquidity_consumption`` is
volume/depth), so the sets are separate operators.  One projection plus
the sanitising wrapper; stateless and streaming-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbook.functions.numeric import div, finite_or_zero
from flowbook.operators.features_a import MarketColumns
from flowbook.session import tune_session

# Fixed value: epsilon used by the set-B formulas.
EPS_B = 1e-8


def _set_b(m: MarketColumns) -> list[tuple[str, Column]]:
    b, a, p, s, v = (F.col(c).cast("double") for c in m.names())
    e = F.lit(EPS_B)
    one = F.lit(1.0)
    sp = a - b
    tl = b + a
    v_e = v + e
    nof = p - s
    ofi = div(nof, p + s + e)
    buy_p = div(p, v_e)
    sell_p = div(s, v_e)
    net_p = buy_p - sell_p
    depth_r = div(tl, v_e)
    bid_d = div(b, v_e)
    ask_d = div(a, v_e)
    kyle = div(F.abs(nof), v_e)
    amihud = div(F.abs(net_p), v_e)
    return [
        ("bid_ask_spread", sp),
        ("bid_ask_ratio", div(b, a + e)),
        ("total_liquidity", tl),
        ("liquidity_imbalance", div(b - a, tl + e)),
        ("normalized_spread", div(sp, tl + e)),
        ("buy_sell_ratio", div(p, s + e)),
        ("net_order_flow", nof),
        ("order_flow_imbalance", ofi),
        ("volume_participation", div(v, p + s + e)),
        ("aggressive_ratio", div(p + s, v_e)),
        ("buy_pressure", buy_p),
        ("sell_pressure", sell_p),
        ("net_pressure", net_p),
        ("pressure_ratio", div(buy_p, sell_p + e)),
        ("depth_ratio", depth_r),
        ("bid_depth_ratio", bid_d),
        ("ask_depth_ratio", ask_d),
        ("depth_imbalance", div(bid_d - ask_d, depth_r + e)),
        ("kyle_lambda", kyle),
        ("amihud_illiquidity", amihud),
        ("liquidity_consumption", div(v, tl + e)),
        ("price_efficiency", div(one, one + amihud)),
        ("execution_quality", div(v, sp + one)),
        ("pin_proxy", F.abs(ofi) * amihud),
        ("order_toxicity", F.abs(ofi) * kyle),
        ("bid_momentum", div(b * p, v_e)),
        ("ask_momentum", div(a * s, v_e)),
        ("liquidity_adjusted_volume", div(v, F.sqrt(tl + one))),
        ("log_volume", F.log1p(v)),
        ("log_liquidity", F.log1p(tl)),
        ("log_spread", F.log1p(F.abs(sp))),
    ]


# Output column names of set B, in output order.
FEATURES_B = [
    "bid_ask_spread", "bid_ask_ratio", "total_liquidity", "liquidity_imbalance", "normalized_spread",
    "buy_sell_ratio", "net_order_flow", "order_flow_imbalance", "volume_participation", "aggressive_ratio",
    "buy_pressure", "sell_pressure", "net_pressure", "pressure_ratio", "depth_ratio", "bid_depth_ratio",
    "ask_depth_ratio", "depth_imbalance", "kyle_lambda", "amihud_illiquidity", "liquidity_consumption",
    "price_efficiency", "execution_quality", "pin_proxy", "order_toxicity", "bid_momentum", "ask_momentum",
    "liquidity_adjusted_volume", "log_volume", "log_liquidity", "log_spread",
]


def add_features_b(df: DataFrame, cols: MarketColumns = MarketColumns(), sanitize: bool = True) -> DataFrame:
    """Append set B; ``sanitize`` applies C8 to the new and the market columns."""
    tune_session(df.sparkSession)  # else the formulas' methods are never compiled
    feats = _set_b(cols)
    new = {n for n, _ in feats}
    market = set(cols.names())
    keep = [c for c in df.columns if c not in new]

    def out(c: str) -> Column:
        return finite_or_zero(F.col(c)).alias(c) if sanitize and c in market else F.col(c)

    # two projections: formulas once, then the sanitiser over their results
    # (a formula referenced twice is not inlined by CollapseProject, so the
    # generated code stays small enough for whole-stage codegen)
    raw = df.select(*[F.col(c) for c in keep], *[e.alias(n) for n, e in feats])
    if not sanitize:
        return raw
    return raw.select(*[out(c) for c in keep], *[finite_or_zero(F.col(n)).alias(n) for n, _ in feats])
