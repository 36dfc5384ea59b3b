"""The latent flow, networks of other libraries, and scoring a stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbook.functions import arrays as A
from flowbook.operators import metrics as M
from flowbook.operators import networks as N
from flowbook.plans import pipelines as PL
from flowbook.plans.queries import example_network
from flowbook.sources import adapters as V
from flowbook.sources import files as FS
from flowbook.streaming.features import read_market_stream, stream_features
from flowbook.streaming.scoring import batch_writer, read_scored, start_scoring

SF = "/root/testdata/sf0.001"


def test_decoding_equals_the_norm_identity(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 6)) @ draw.normal(size=(6, 6))
    rows = [(i, *map(float, x[i]), float(x[i, 0] + draw.normal())) for i in range(200)]
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(rows, ["row_id", *names, "label"])
    scored, loss = PL.latent_ridge(df, df, names, k=3)
    got = scored.select("scaled", "reconstructed", "latent", "label", "prediction").collect()
    square = [sum(a * a for a in r.scaled) - float(r.latent.dot(r.latent)) for r in got]
    error = [sum((a - b) ** 2 for a, b in zip(r.scaled, r.reconstructed)) for r in got]
    assert error == pytest.approx(square, abs=1e-9)
    row = loss.first()
    assert row.recon_mse == pytest.approx(np.mean(error) / 6) and row.loss == pytest.approx(row.pred_mse + 0.5 * row.recon_mse)
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(sorted(r.scaled for r in got), sorted(z.tolist()), atol=1e-9)
    # As many directions as features lose nothing.
    assert PL.latent_ridge(df, df, names, k=6)[1].first().recon_mse == pytest.approx(0, abs=1e-18)


def test_batch_loss_weighs_batches_alike(spark):
    rows = [(i, 1.0, 0.0, [0.0, 0.0], [float(i == 4), 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "pos long, label double, prediction double, x array<double>, y array<double>")
    got = M.batch_composite_loss(df, "label", "prediction", "x", "y", batch_size=4).first()
    assert (got.loss, got.batches) == (pytest.approx((1 + 1.25) / 2), 2)


def test_latent_flow(spark, tmp_path):
    valid = V.market_all_signals(spark, SF)
    lost = F.transform("x", lambda v, i: F.when(~((i == 6) & (F.col("row_id") == 5)), v))
    train = valid.withColumn("x", A.with_names(lost, "x", A.names_of(valid, "x")))
    template = V.table(spark, SF, "events").select((F.col("event_id") + 1).alias("ID"), F.col("value").alias("prediction"))
    run = PL.latent_flow(train, valid, template, str(tmp_path), k=128)
    n = valid.count()
    assert run.dropped == ["X7"] and run.model.pca.pc.numCols == 128 and run.model.pca.pc.numRows == 5 + 58 + 170
    assert run.predictions.count() == n and FS.read_template(spark, run.path).count() == n and "pred_piereson_cor" in run.path
    report = run.report.first()
    assert report.n == math.ceil(0.3 * n) and report.pearson > 0.5 and run.loss.first().batches == -(-report.n // 256)


def plain(network, x):
    done = [x]
    for layer in network.layers:
        y = [sum(w * v for w, v in zip(row, done[-1])) + b for row, b in zip(layer.weights, layer.bias)]
        if layer.norm:
            y = [(v - m) / math.sqrt(s + 1e-5) * g + t for v, m, s, g, t in zip(y, *layer.norm)]
        s = [1 / (1 + math.exp(-v)) for v in y]
        y = {"linear": y, "sigmoid": s, "swish": [v * t for v, t in zip(y, s)], "relu": [max(v, 0.0) for v in y]}[layer.activation]
        done.append([v + (done[layer.skip + 1][i] if layer.skip is not None else 0.0) for i, v in enumerate(y)])
    return done[-1]


def test_network_round_trip_and_forward_pass(spark, tmp_path):
    network = example_network()
    path = N.save(spark, network, str(tmp_path / "net"))
    assert N.load(spark, path) == network
    df = spark.createDataFrame([(i, [float(i * 37 % 11), 0.5 * i, -1.0, 100.0 * i, 3.0]) for i in range(30)] + [(98, [1.0, None, 0.0, 0.0, 0.0]), (99, None)], "row_id long, x array<double>")
    got = {r.row_id: r.prediction for r in N.score_network(df, path, F.col("x")).collect()}
    for r in df.collect():
        want = plain(network, r.x)[0] if r.x and None not in r.x else None
        assert got[r.row_id] == (pytest.approx(want, rel=1e-12) if want is not None else None)
    wide = N.Network([N.Layer([[1.0, 0.0], [0.0, 2.0]], [0.0, 1.0], "relu", skip=N.INPUT)])
    out = N.score_network(spark.createDataFrame([(1.0, -3.0)], "a double, b double"), N.save(spark, wide, str(tmp_path / "wide")), ["a", "b"]).first()
    assert out.prediction == [2.0, -3.0]


@pytest.mark.parametrize("layers", [
    [N.Layer([[1.0]], [0.0], "tanh")],
    [N.Layer([[1.0]], [0.0, 1.0])],
    [N.Layer([[1.0]], [0.0]), N.Layer([[1.0, 2.0]], [0.0])],
    [N.Layer([[1.0], [1.0]], [0.0, 0.0], skip=N.INPUT)],
    [N.Layer([[1.0]], [0.0], norm=[[1.0], [1.0], [1.0]])],
])
def test_networks_that_do_not_fit(layers):
    with pytest.raises(ValueError):
        N.Network(layers)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, sink, network = (str(tmp_path / n) for n in ("source", "sink", "net"))
    N.save(spark, example_network(), network)
    events = V.market_events(spark, SF)
    events.repartition(3, "row_id").write.parquet(source)

    def scored(batch):
        return N.score_network(batch, network, PL.MARKET).select("row_id", "prediction")

    stream = read_market_stream(spark, source, events.schema, max_files_per_trigger=1)
    start_scoring(stream, scored, sink, str(tmp_path / "checkpoint")).awaitTermination()
    shape = scored(events).schema
    first = sorted(map(tuple, read_scored(spark, sink, shape).collect()))
    assert sorted((a, b) for a, b, _ in first) == sorted(map(tuple, scored(events).collect())) and {b for _, _, b in first} == {0, 1, 2}
    ids = [a for a, _, b in first if b == 1]
    batch_writer(scored, sink)(events.where(F.col("row_id").isin(ids)), 1)
    assert sorted(map(tuple, read_scored(spark, sink, shape).collect())) == first
    # A second start has nothing left to do.
    start_scoring(read_market_stream(spark, source, events.schema), scored, sink, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, read_scored(spark, sink, shape).collect())) == first


def test_every_stateless_map_takes_a_stream(spark, tmp_path):
    rows = V.market_signals(spark, SF)
    rows.write.parquet(str(tmp_path / "rows"))
    stream = read_market_stream(spark, str(tmp_path / "rows"), rows.schema)
    stream = stream_features(stream_features(stream_features(stream, "b"), "row_stats"), "interactions")
    query = stream.writeStream.format("memory").queryName("mapped").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = stream_features(stream_features(stream_features(rows, "b"), "row_stats"), "interactions")
    assert spark.table("mapped").orderBy("row_id").first() == batch.orderBy("row_id").first()
    assert spark.table("mapped").count() == batch.count()


def test_only_numbers_are_stored_for_the_loss(spark, tmp_path, monkeypatch):
    """The split's scored rows are stored and shuffled without their arrays."""
    kept, store = {}, PL.stored
    monkeypatch.setattr(PL, "stored", lambda df, name: (kept.setdefault(name, df.dtypes), store(df, name))[1])
    valid = V.market_signals(spark, SF)
    template = V.table(spark, SF, "events").select((F.col("event_id") + 1).alias("ID"), F.col("value").alias("prediction"))
    PL.latent_flow(valid, valid, template, str(tmp_path), k=4)
    assert not [c for c, t in kept["latent-scored"] if t.startswith("array")]
