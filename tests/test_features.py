import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbook.operators.features_a import (FEATURES_A, FEATURES_A_PLUS, MarketColumns, _set_a, _set_a_plus,
                                           add_features_a)
from flowbook.operators.features_b import FEATURES_B, _set_b, add_features_b

MARKET = ["bid_qty", "ask_qty", "buy_qty", "sell_qty", "volume"]


def test_name_lists_match_builders(spark):
    assert [n for n, _ in _set_a(MarketColumns())] == FEATURES_A
    assert [n for n, _ in _set_a_plus(MarketColumns(), F.lit(0.0))] == FEATURES_A_PLUS
    assert [n for n, _ in _set_b(MarketColumns())] == FEATURES_B
    assert len(FEATURES_A) == 58 and len(FEATURES_A_PLUS) == 11 and len(FEATURES_B) == 31


def _zero_frame(spark):
    rows = [
        (0.0, 0.0, 0.0, 0.0, 0.0),        # all zero
        (2.0, 1.0, 3.0, 1.0, 5.0),        # ask - bid = -1 -> execution_quality divides by 0
        (1.0, 2.0, 3.0, 1.0, -1.0),       # volume = -1 -> log1p(-1)
        (-1.0, -2.0, -3.0, -4.0, -5.0),   # negative quantities
    ]
    return spark.createDataFrame(rows, ",".join(f"{c} double" for c in MARKET))


def test_zero_denominators_are_finite(spark):
    df = add_features_b(add_features_a(_zero_frame(spark), plus=True, x293="bid_qty"))
    rows = df.collect()
    for r in rows:
        for c in FEATURES_A + FEATURES_A_PLUS + FEATURES_B:
            v = r[c]
            assert v is not None and math.isfinite(v), (c, v)
    # ask - bid = -1 row: execution_quality = v / 0 -> 0
    assert rows[1]["execution_quality"] == 0.0
    # all-zero row: ratios with epsilon denominators are exactly 0
    assert rows[0]["buy_sell_ratio"] == 0.0 and rows[0]["log_volume"] == 0.0


def _np_set_a(b, a, p, s, v):
    e = 1e-10
    with np.errstate(all="ignore"):
        nof = p - s
        td = b + a
        ofi = (p - s) / (p + s + e)
        return {
            "kyle_lambda": np.abs(nof) / (v + e),
            "market_stress": v / (td + e) * np.abs(ofi),
            "signed_volume": np.sign(nof) * v,
            "directional_volume": nof * np.log1p(v),
            "imbalance_squared": ofi ** 2,
            "market_efficiency": v / (np.abs(b - a) + e),
        }


def test_set_a_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.uniform(0, 50, size=(200, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ",".join(f"{c} double" for c in MARKET))
    got = add_features_a(df).toPandas()
    ref = _np_set_a(*[data[:, i] for i in range(5)])
    for k, v in ref.items():
        np.testing.assert_allclose(got[k].to_numpy(), v, rtol=1e-12, atol=1e-12)


def test_all_columns_but_the_label_are_sanitised(spark):
    df = spark.createDataFrame([(float("inf"), 1.0, 1.0, 1.0, 1.0, float("nan"), float("inf"), "a")],
                               ",".join(f"{c} double" for c in MARKET) + ", other double, label double, name string")
    r = add_features_a(df).first()
    assert r["bid_qty"] == 0.0 and r["other"] == 0.0
    assert math.isinf(r["label"]) and r["name"] == "a"


def test_policy_p2_test_side(spark):
    from flowbook.plans.policies import policy_p2, policy_p2_test
    kinds = ",".join(f"{c} double" for c in MARKET) + ", X293 double, spare double, label double"
    train = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 1.0, float("inf"), 0.5), (None, 2.0, 3.0, 4.0, 5.0, 1.0, 1.0, 0.5)], kinds)
    test = spark.createDataFrame([(None, 2.0, float("nan"), 4.0, 5.0, float("inf"), 1.0, None)] * 2, kinds)
    cleaned = policy_p2(train)
    out = policy_p2_test(test, cleaned)
    assert out.columns == [c for c in cleaned.columns if c != "label"] and "spare" not in out.columns
    assert cleaned.count() == 1 and out.count() == 2
    assert all(math.isfinite(v) for r in out.collect() for v in r)


def test_streaming_parity(spark, tmp_path):
    from flowbook.streaming.features import read_market_stream, stream_features
    data = [(float(i), float(i % 7) + 0.5, float(i) * 0.4, float(i) * 0.3, float(i) + 1.0) for i in range(50)]
    src = str(tmp_path / "src")
    batch = spark.createDataFrame(data, ",".join(f"{c} double" for c in MARKET))
    batch.write.parquet(src)
    stream = read_market_stream(spark, src, batch.schema)
    q = (stream_features(stream, "b").writeStream.format("memory").queryName("parity_b")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("parity_b").orderBy("bid_qty").collect()
    want = add_features_b(batch).orderBy("bid_qty").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_stream_batches_do_not_grow_with_the_files(spark, monkeypatch):
    from pathlib import Path

    from flowbook import session
    from flowbook.plans import queries as Q
    paths, scratch, events = {}, session.scratch_path, Q.V.market_events
    monkeypatch.setattr(session, "scratch_path", lambda s, name: paths.setdefault(name, scratch(s, name)))
    monkeypatch.setattr(Q.V, "market_events", lambda s, sf: events(s, sf).repartition(12))
    out = Q.q_features_a_stream(spark, "/root/testdata/sf0.001")
    commits = [p for p in Path(paths["stream-ckpt"].removeprefix("file:"), "commits").iterdir() if p.name.isdigit()]
    assert out.count() == events(spark, "/root/testdata/sf0.001").count()
    assert 1 < len(commits) <= 4


@pytest.mark.parametrize("limit,after", [("65535", "8000"), ("20000", "20000")])
@pytest.mark.parametrize("add", [add_features_a, add_features_b])
def test_maps_bound_the_size_of_generated_methods(spark, add, limit, after):
    """HotSpot does not compile longer ones; a limit of the user's own stays."""
    own = spark.newSession()
    own.conf.set("spark.sql.codegen.hugeMethodLimit", limit)
    add(_zero_frame(own))
    assert own.conf.get("spark.sql.codegen.hugeMethodLimit") == after
