import numpy as np
import pytest

from drawlake.operators import network as N
from drawlake.operators import predict
from drawlake.plans import q_model
from drawlake.plans.base import cases


def layered(rng, inputs, outputs):
    """Three layers of each kind of unit with every kind of link and offset; a layer without input links, one without links to the outputs."""
    return {
        "ti": rng.normal(size=inputs), "ih": [rng.normal(size=(inputs, 4)), None, rng.normal(size=(inputs, 2))], "th": [rng.normal(size=4), None, rng.normal(size=2)],
        "hh": [rng.normal(size=(4, 3)), rng.normal(size=(3, 2))], "bh": [rng.normal(size=4), rng.normal(size=3), None],
        "ho": [rng.normal(size=(4, outputs)), None, rng.normal(size=(2, outputs))], "io": rng.normal(size=(inputs, outputs)), "bo": rng.normal(size=outputs),
    }


NET = N.Network(["tanh", "sin", "identity"], omit={0: [1], 2: [0], -1: [2]})


def targets(rng, loss, outputs, n):
    return {"squared": rng.normal(size=(n, outputs)), "class": rng.integers(0, outputs, (n, 1)), "binary": rng.integers(0, 2, (n, outputs)), "count": rng.poisson(2, (n, outputs))}[loss].astype(float)


@pytest.mark.parametrize("loss", N.LOSSES)
def test_gradient_against_differences(loss):
    """Every parameter of every kind of link, for every kind of target."""
    rng = np.random.default_rng(3)
    x, start = rng.normal(size=(9, 3)), layered(rng, 3, 3)
    t = targets(rng, loss, 3, 9)
    lose, slope = N.LOSSES[loss]
    total = lambda p: lose(NET.output(x, p), t).sum() * (0.5 if loss == "squared" else 1)
    _, grad = NET.gradient(x, start, lambda o: slope(o, t))
    values, places = N.flat(start)
    got, same = N.flat(grad)
    assert places == same
    for i in range(len(values)):
        ends = []
        for h in (1e-6, -1e-6):
            moved = values.copy()
            moved[i] += h
            ends.append(total(N.unflat(moved, start)))
        assert got[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5), (i, places)


def test_omitted_inputs_change_nothing():
    rng = np.random.default_rng(4)
    x, p = rng.normal(size=(5, 3)), layered(rng, 3, 2)
    net = N.Network(NET.units, omit={0: [1], 1: [1], 2: [1], -1: [1]})
    y = x.copy()
    y[:, 1] = 99
    assert net.output(y, p) == pytest.approx(net.output(x, p))
    assert net.output(x, p) != pytest.approx(N.Network(NET.units).output(x, p))


def frame(spark, x, t, held):
    rows = [(*map(float, a), *map(float, b), bool(h)) for a, b, h in zip(x, t, held)]
    names = [f"x{i}" for i in range(x.shape[1])], [f"t{i}" for i in range(t.shape[1])]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in sum(names, [])) + ", v boolean").repartition(3), *names


@pytest.mark.parametrize("loss", N.LOSSES)
def test_fit_against_numpy(spark, loss):
    """Training on distributed cases moves as the same steps in numpy do."""
    rng = np.random.default_rng(5)
    x, start = rng.normal(size=(70, 3)), layered(rng, 3, 2)
    t, held = targets(rng, loss, 2, 70), np.arange(70) % 5 == 0
    df, inputs, names = frame(spark, x, t, held)
    step = {n: (0.001 if loss == "count" else 0.1) * (1 + 0.2 * i) for i, n in enumerate(N.GROUPS)}
    trace = N.network_fit(df, inputs, names, start, NET, 3, step, "v", prior=0.01, loss=loss)
    lose, slope = N.LOSSES[loss]
    now, places = N.flat(start)
    size = np.concatenate([np.full(int(np.prod(s)), step[n]) for n, _, s in places])
    for at, on_train, on_held, params in trace:
        assert N.flat(params)[0] == pytest.approx(now)
        out, grad = NET.gradient(x[~held], params, lambda o: slope(o, t[~held]))
        assert on_train == pytest.approx(lose(out, t[~held]).mean())
        assert on_held == pytest.approx(lose(NET.output(x[held], params), t[held]).mean())
        now = now - size / (56 + 1) * (N.flat(grad)[0] + 0.01 * now)
    assert [r[0] for r in trace] == [0, 1, 2] and N.early_stop(trace)[2] == min(r[2] for r in trace)


def test_fit_leaves_out_unknown_targets(spark):
    rng = np.random.default_rng(6)
    x, t = rng.normal(size=(30, 2)), rng.normal(size=(30, 1))
    start = {"ih": [rng.normal(size=(2, 3))], "ho": [rng.normal(size=(3, 1))], "bo": np.zeros(1)}
    df, inputs, names = frame(spark, x, t, np.zeros(30))
    more = df.unionByName(spark.createDataFrame([(1.0, 2.0, None, False)], df.schema))
    net = N.Network(["sin"])
    a, b = (N.network_fit(f, inputs, names[0], start, net, 2, 0.1) for f in (df, more))
    assert a[1][1] == pytest.approx(b[1][1]) and a[1][2] is None
    assert N.network_fit(df.limit(0), inputs, names[0], start, net, 2, 0.1) == []
    with pytest.raises(ValueError):
        N.Network(["sin"], keep={0}).gradient(x, start, lambda o: o)


def test_ensemble_query_against_numpy(spark, sf_dir):
    """The registered ensemble: both networks trained, stopped early and averaged in numpy."""
    rows = cases(spark, sf_dir).toPandas()
    x, t = rows[["x1", "x2"]].to_numpy(), rows[["t"]].to_numpy()
    net, means = N.Network(["tanh"]), []
    for k in range(2):
        rng = np.random.default_rng(k)
        p = {"ih": [rng.normal(0, 0.3, (2, 4))], "bh": [np.zeros(4)], "ho": [rng.normal(0, 0.3, (4, 1))], "bo": np.zeros(1)}
        held, seen = (rows["case_id"] % 2 == k).to_numpy(), []
        for _ in range(6):
            seen.append((((net.output(x[held], p) - t[held]) ** 2).mean(), len(seen), p))
            _, grad = net.gradient(x[~held], p, lambda o: o - t[~held])
            p = N.unflat(N.flat(p)[0] - 0.05 / ((~held).sum() + 1) * N.flat(grad)[0], p)
        means.append(net.output(x, min(seen, key=lambda r: r[:2])[2])[:, 0])
    got = {r.case_id: r["mean"] for r in q_model.p17_network_ensemble(spark, sf_dir).collect()}
    assert got == pytest.approx(dict(zip(rows["case_id"], np.mean(means, axis=0))))


def test_spread_scalar(spark):
    rng = np.random.default_rng(8)
    x, p = rng.normal(size=(50, 3)), layered(rng, 3, 1)
    df, inputs, _ = frame(spark, x, np.zeros((50, 1)), np.zeros(50))
    got = {r.layer: r.spread for r in predict.hidden_spread_scalar(predict.hidden_spread(df, inputs, [("a", 1, p)], NET)).collect()}
    assert got == pytest.approx({i: np.sqrt(h.var(axis=0).sum()) / h.shape[1] for i, h in enumerate(NET.hidden(x, p))})


def test_net_predict_against_numpy(spark, monkeypatch):
    """Means and log probabilities in one pass; blocks of draws change nothing, far targets and null ones are no trouble."""
    rng = np.random.default_rng(9)
    x, t = rng.normal(size=(40, 3)), rng.normal(size=(40, 2))
    t[0] = 500.0
    draws = [("a", i, layered(rng, 3, 2)) for i in range(7)]
    lw, sd = rng.normal(size=7) * 3 + 900, rng.uniform(0.2, 2, 7)
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, t))]
    rows[3] = (*rows[3][:4], None, rows[3][5])
    df = spark.createDataFrame(rows, "k long, x0 double, x1 double, x2 double, t0 double, t1 double").repartition(3)
    o = np.stack([NET.output(x, p) for _, _, p in draws])
    w = np.exp(lw - lw.max())[:, None, None]
    mean = (w * o).sum(0) / w.sum()
    logs = -((t - o) ** 2) / (2 * sd[:, None, None] ** 2) - np.log(sd)[:, None, None] - 0.5 * np.log(2 * np.pi) + np.log(w / w.sum())
    want = np.log(np.exp(logs - logs.max(0)).sum(0)) + logs.max(0)
    want[3, 0] = 0.0
    for most in (predict.BLOCK_BYTES, 900):
        monkeypatch.setattr(predict, "BLOCK_BYTES", most)
        got = {(r.k, r.j): (r["mean"], r.log_prob) for r in predict.net_predict(df, "k", ["x0", "x1", "x2"], draws, NET, lw.tolist(), ["t0", "t1"], sd.tolist()).collect()}
        assert len(got) == 80 and all(got[i, j] == (pytest.approx(mean[i, j]), pytest.approx(want[i, j], abs=1e-9)) for i in range(40) for j in range(2))
    plain = {(r.k, r.j): r["mean"] for r in predict.net_predict(df, "k", ["x0", "x1", "x2"], draws, NET).collect()}
    assert all(plain[i, j] == pytest.approx(o.mean(0)[i, j]) for i, j in plain)
