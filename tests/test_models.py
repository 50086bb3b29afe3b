"""Models: shapes, gradients, learning, checkpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seawake.functions.encode import positional_encoding
from seawake.models.autograd import Adam, Tensor, parameter
from seawake.models.lstm import TSSPL, SpatialLSTM
from seawake.models.trainer import TrajectoryTrainer, compute_loss, to_arrays
from seawake.models.transformer import TrajectoryDecoder, TrajectoryEmbedding, TrajectoryEncoder, TrajectoryTransformer, causal_mask, predict
from seawake.operators import features

from .test_operators import db, sailing, table


def check_gradients(model, x, loss):
    out = loss(model(x))
    out.backward()
    rng = np.random.default_rng(0)
    for p in model.parameters():
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep, h = p.data[at], 1e-5
        p.data[at] = keep + h
        up = loss(model(x)).data
        p.data[at] = keep - h
        down = loss(model(x)).data
        p.data[at] = keep
        assert abs((up - down) / (2 * h) - (p.grad[at] if p.grad is not None else 0)) < 1e-4


def square(t):
    return (t * t).mean()


def test_lstm_gradients_and_shapes():
    model = SpatialLSTM(5, 2)
    x = np.random.default_rng(1).normal(size=(3, 4, 2))
    assert model(x).shape == (3, 2)
    check_gradients(model, x, square)
    n = SpatialLSTM(64)
    assert sum(p.data.size for p in n.parameters()) == 4 * 64 * (2 + 64 + 2) + 64 * 2 + 2
    for bad in (np.zeros((3, 2)), np.zeros((3, 4, 3)), np.zeros((0, 4, 2))):
        with pytest.raises(ValueError):
            model(bad)


@pytest.mark.parametrize("layers", [1, 2])
def test_lstm_gradients_of_whole_layers(layers):
    rng = np.random.default_rng(3)
    model, x, y = SpatialLSTM(5, layers), rng.normal(size=(7, 4, 2)), rng.normal(size=(7, 2))
    loss = square(model(x) - y)
    loss.backward()
    want = [p.grad for p in model.parameters()]
    assert model.gradients(x, y) == pytest.approx(float(loss.data), abs=1e-12)
    assert all(np.allclose(a, p.grad, atol=1e-12) for a, p in zip(want, model.parameters(), strict=True))
    assert model.gradients(x.astype("f"), y.astype("f")) == pytest.approx(float(loss.data), rel=1e-5)


def test_lstm_fit_table(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 10)) * 0.3
    rows[:, -2:] = rows[:, 6:8] * 0.5  # the target follows from the last step
    names = [f"x{i}" for i in range(10)]
    table = spark.createDataFrame(rows.tolist(), names)
    one = table.coalesce(1)
    model, plain = SpatialLSTM(8), SpatialLSTM(8)
    losses = model.fit_table(one, 3, 0.01)
    x, y, adam, want = rows[:, :-2].reshape(-1, 4, 2).astype("f"), rows[:, -2:].astype("f"), Adam(plain.parameters(), 0.01), []
    for epoch in range(3):
        want.append(np.mean(plain._pass(adam, x, y, np.random.default_rng((0, epoch)).permutation(300), 32)))
    assert np.allclose(losses, want, atol=1e-6)
    assert all(np.allclose(a.data, b.data, atol=1e-6) for a, b in zip(model.parameters(), plain.parameters(), strict=True))
    parts = table.repartition(5)
    dealt, again = SpatialLSTM(8), SpatialLSTM(8)
    losses = dealt.fit_table(parts, 12, 0.01)
    assert losses[-1] < 0.5 * losses[0] and losses == again.fit_table(parts, 12, 0.01)
    assert all(np.array_equal(a.data, b.data) for a, b in zip(dealt.parameters(), again.parameters(), strict=True))
    with pytest.raises(ValueError, match="no windows"):
        SpatialLSTM(8).fit_table(table.limit(0), 1, 0.01)
    with pytest.raises(ValueError, match="two numbers"):
        SpatialLSTM(8).fit_table(table.drop("x0"), 1, 0.01)


def test_weighted_gradients():
    rng = np.random.default_rng(6)
    model, x, y, w = SpatialLSTM(5), rng.normal(size=(7, 4, 2)), rng.normal(size=(7, 2)), rng.uniform(size=7)
    d = model(x) - y
    loss = (d * d * w[:, None]).mean()
    loss.backward()
    want = [p.grad for p in model.parameters()]
    assert model.gradients(x, y, w) == pytest.approx(float(loss.data), abs=1e-12)
    assert all(np.allclose(a, p.grad, atol=1e-12) for a, p in zip(want, model.parameters(), strict=True))


def test_lstm_fit_table_of_counted_windows(spark):
    """A window with its number trains as its copies do."""
    rng = np.random.default_rng(4)
    rows, times = rng.normal(size=(40, 10)) * 0.3, rng.integers(1, 9, 40)
    rows[:, -2:] = rows[:, 6:8] * 0.5
    names = [f"x{i}" for i in range(10)]
    counted = spark.createDataFrame([(*map(float, r), int(n)) for r, n in zip(rows, times, strict=True)], [*names, "n"]).coalesce(1)
    copies = spark.createDataFrame(np.repeat(rows, times, axis=0).tolist(), names).coalesce(1)
    one, other = SpatialLSTM(8), SpatialLSTM(8)
    # Copies of weight 1, in the same order: the same training.
    assert np.allclose(one.fit_table(counted, 3, 0.01, a_row=1.0), other.fit_table(copies, 3, 0.01), atol=1e-9)
    assert all(np.allclose(a.data, b.data, atol=1e-9) for a, b in zip(one.parameters(), other.parameters(), strict=True))
    mean = float(times.mean())
    losses = SpatialLSTM(8).fit_table(counted, 40, 0.01, a_row=mean)
    assert losses[-1] < 0.2 * losses[0]


def test_transformer_gradients():
    model = TrajectoryTransformer(8, 2, 1, 1, 16, 0.0, 10)
    check_gradients(model, np.random.default_rng(2).normal(size=(2, 5, 6)), square)


def test_encoder_masks():
    rng = np.random.default_rng(3)
    encoder = TrajectoryEncoder(16, 4, 2, 32, 0.0)
    x = rng.normal(size=(2, 6, 16))
    padding = np.zeros((2, 6), bool)
    padding[:, 4:] = True
    y = x.copy()
    y[:, 4:] = rng.normal(size=(2, 2, 16))
    assert np.allclose(encoder(x, None, padding).data[:, :4], encoder(y, None, padding).data[:, :4])
    z = x.copy()
    z[:, 5] = 0
    assert np.allclose(encoder(x, causal_mask(6)).data[:, :5], encoder(z, causal_mask(6)).data[:, :5])
    assert not np.allclose(encoder(x).data[:, :5], encoder(z).data[:, :5])
    decoder = TrajectoryDecoder(16, 4, 1, 32, 0.0)
    assert decoder(x, rng.normal(size=(2, 3, 16))).shape == (2, 6, 16)
    for bad in (np.zeros((2, 6, 15)), np.zeros((2, 16))):
        with pytest.raises(ValueError):
            encoder(bad)
    with pytest.raises(ValueError):
        decoder(x, np.zeros((3, 3, 16)))
    with pytest.raises(ValueError):
        TrajectoryEncoder(10, 4)


def test_embedding():
    e = TrajectoryEmbedding(6, 8, 12, np.random.default_rng(0))
    x = np.random.default_rng(1).normal(size=(2, 5, 6))
    mask = np.array([[1, 1, 0, 0, 0], [1, 1, 1, 1, 1]], bool)
    out = e(x, mask).data
    assert out.shape == (2, 5, 8) and (out[0, 2:] == 0).all() and np.allclose(out[1], e(x).data[1])
    with pytest.raises(ValueError):
        e(np.zeros((1, 13, 6)))
    places = positional_encoding(12, 8)
    assert places[0, 1] == 1 and places[0, 0] == 0 and abs(places[3, 2] - np.sin(3 / 10000 ** (2 / 8))) < 1e-12
    with pytest.raises(ValueError):
        positional_encoding(4, 3)


def test_widths_and_dropout():
    for flags, width in (((True, True, True), 6), ((False, True, False), 4), ((False, False, False), 2)):
        model = TrajectoryTransformer(8, 2, 1, 1, 8, 0.5, 10, *flags)
        x = np.ones((1, 4, width))
        assert model(x).shape == (1, 4, width) and np.allclose(model(x).data, model(x).data)
        model.train()
        assert not np.allclose(model(x).data, model(x).data)


def test_adam_clips_and_descends():
    p = parameter(np.array([5.0, -3.0]))
    adam = Adam([p], 0.1)
    for _ in range(200):
        loss = square(p * 1.0)
        adam.zero_grad()
        loss.backward()
        assert adam.clip(1.0) >= 0 and np.sqrt((p.grad**2).sum()) <= 1.0 + 1e-6
        adam.step()
    assert np.abs(p.data).max() < 0.1


def test_loss_counts_masked_places():
    t, a, m = np.zeros((1, 3, 2)), np.array([[1, 1, 0]], bool), np.array([[0, 1, 1]], bool)
    assert float(compute_loss(Tensor(np.full((1, 3, 2), 2.0)), t, a, m).data) == 4.0
    assert np.isnan(float(compute_loss(Tensor(t), t, a, np.zeros_like(m)).data))


def test_training_and_checkpoints(spark, tmp_path):
    df = features.masked_dataset(table(spark, [sailing(12 + i, sog=5.0 + i) for i in range(8)]), 16)
    data = to_arrays(df)
    make = lambda: TrajectoryTransformer(8, 2, 1, 1, 16, 0.0, 16, seed=1)
    trainer = TrajectoryTrainer(make(), data, data, str(tmp_path), batch=4, learning_rate=0.01)
    table_ = trainer.train(4)
    assert len(table_) == 4 and table_.val_loss.iloc[-1] < table_.val_loss.iloc[0]
    again = TrajectoryTrainer(make(), data, data, str(tmp_path), batch=4, learning_rate=0.01)
    state = again.load_checkpoint("latest")
    assert state["epoch"] == 4 and again.train_step == trainer.train_step == 8
    assert all(np.array_equal(a.data, b.data) for a, b in zip(trainer.model.parameters(), again.model.parameters()))
    assert len(again.train(5, resume="latest")) == 1
    stuck = TrajectoryTrainer(make(), data, data, str(tmp_path / "s"), learning_rate=0.0, least_rate=0.0, patience=2, batch=4)
    assert len(stuck.train(10)) == 3
    rows = predict(trainer.model, df).collect()
    assert len(rows) == 8 and np.array(rows[0].predicted).shape == (16, 6)


def test_tsspl(spark):
    west = [(48.0 + 0.0 * i, -125 - i * 0.01, 4, 270) for i in range(20)]
    north = [(48 + i * 0.01, -125.0, 12, 0) for i in range(18)]
    history = db(spark, west, north)
    target = db(spark, west[:10]).withColumnRenamed("traj_id", "target_id")
    model = TSSPL(history, n_epochs=15, hidden_size=16)
    rows = model.predict(target, 3).orderBy("step").collect()
    assert model.losses[-1] < model.losses[0]
    assert all(abs(r.lat - west[9 + r.step][0]) < 0.5 and abs(r.lon - west[9 + r.step][1]) < 0.5 for r in rows)
    longer = model.predict(target, 12).orderBy("step").collect()
    assert len(longer) == 12 and longer[-1].lat == 0 and longer[9].lat != 0
    with pytest.raises(ValueError, match="sum to 1"):
        TSSPL(history, w_d=0.9)
    with pytest.raises(ValueError, match="no two"):
        TSSPL(db(spark, west[:3], north[:3]))
    assert history.select(F.size("points").alias("n")).count() == 2


def test_tsspl_trains_equal_windows_once(spark, monkeypatch):
    """Twenty copies of a pair make 400 times the windows, and the same rows to train on."""
    west = [(48.0, -125 - i * 0.25, 4, 270) for i in range(20)]
    north = [(48 + i * 0.25, -125.0, 12, 0) for i in range(20)]
    trained = []
    fit = SpatialLSTM.fit_table
    monkeypatch.setattr(SpatialLSTM, "fit_table", lambda self, windows, *a, **b: trained.append((windows.count(), windows.agg({"n": "sum"}).first()[0])) or fit(self, windows, *a, **b))
    TSSPL(db(spark, *[west, north] * 20), n_epochs=1, hidden_size=4)
    assert trained == [(31, 40 * 39 * 15)]
