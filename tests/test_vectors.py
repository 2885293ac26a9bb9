import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomark.functions import vectors as fv
from fathomark.operators import align, descent, mkmmd, mmd
from fathomark.operators import vectors as ov

D = 6


def frame(spark, x, start=0, **const):
    rows = [(start + i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "item_id bigint, v array<double>")
    for k, v in const.items():
        df = df.withColumn(k, F.lit(v))
    return df


def back(df):
    return np.stack([r["v"] for r in df.orderBy("item_id").collect()])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(D, D))
    x, t = rng.normal(size=(400, D)) @ mix + 1.0, rng.normal(size=(300, D)) * 2.0 - 1.0
    return x, t, frame(spark, x).cache(), frame(spark, t, 10_000).cache()


def test_moments_and_covariance(data):
    x, _, fx, _ = data
    m = align.moments(fx.repartition(5), True)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.std, x.std(0))
    assert np.allclose(m.cov, np.cov(x, rowvar=False))
    c = x - x.mean(0)
    assert m.fourth == pytest.approx(((c**2).sum(1) ** 2).sum())


def test_zscore_and_mean_shift(data):
    x, t, fx, ft = data
    z = align.fit_align(fx, ft, "zscore")
    for f, side in ((fx, "source"), (ft, "target")):
        got = back(z.transform(f, side))
        assert np.allclose(got.mean(0), 0) and np.allclose(got.std(0), 1)
    ms = align.fit_align(fx, ft, "mean_shift")
    assert np.allclose(back(ms.transform(fx, "source")), x + t.mean(0) - x.mean(0))
    assert np.allclose(back(ms.transform(ft, "target")), t)


def test_constant_dimension_is_left_alone(spark):
    f = frame(spark, [[1.0, 2.0], [1.0, 4.0]])
    got = back(align.fit_align(f, f, "zscore").transform(f, "source"))
    assert np.allclose(got[:, 0], 0) and np.allclose(got[:, 1], [-1, 1])


def test_coral_and_diag_match_moments(data):
    x, t, fx, ft = data
    got = back(align.fit_align(fx, ft, "coral", eps=1e-9).transform(fx, "source"))
    assert np.allclose(np.cov(got, rowvar=False), np.cov(t, rowvar=False), atol=1e-5)
    got = back(align.fit_align(fx, ft, "diag_match").transform(fx, "source"))
    assert np.allclose(got.std(0), t.std(0)) and np.allclose(got.mean(0), t.mean(0))


def test_ledoit_wolf_by_definition(data):
    x, _, fx, _ = data
    cov, s = align.ledoit_wolf(align.moments(fx, True))
    c = x - x.mean(0)
    n, d = c.shape
    emp = c.T @ c / n
    mu = np.trace(emp) / d
    delta = ((emp - mu * np.eye(d)) ** 2).sum() / d
    beta = min(sum(((np.outer(r, r) - emp) ** 2).sum() for r in c) / n**2 / d, delta)
    assert s == pytest.approx(beta / delta, rel=1e-9)
    assert np.allclose(cov, (1 - s) * emp + s * mu * np.eye(d))


def test_contract(data, spark):
    _, _, fx, ft = data
    with pytest.raises(ValueError):
        align.fit_align(fx, ft, "magic")
    with pytest.raises(ValueError):
        align.Coral()
    with pytest.raises(RuntimeError):
        align.ZScore().transform(fx, "source")
    with pytest.raises(TypeError):
        align.ZScore().fit(fx.withColumn("v", F.col("v").cast("array<float>")), ft)
    m = align.fit_align(fx, ft, "none")
    assert m.fit_ids.count() == 700
    with pytest.raises(ValueError):
        m.transform(fx, "elsewhere")


def test_singular_is_refused():
    with pytest.raises(align.SingularCovariance):
        align.matrix_power(np.diag([1.0, 0.0]), -0.5)
    with pytest.raises(align.SingularCovariance):
        align.matrix_power(np.diag([1.0, 1e-13]), -0.5)


def test_diagnostics_of_identity():
    d = align.diagnose(np.eye(5))
    assert d["condition_number"] == 1.0 and d["numerical_rank"] == 5
    assert d["spectral_entropy_rank"] == pytest.approx(5) and d["participation_ratio"] == pytest.approx(5)


def test_shrinkage_path_reaches_predicted_scalar(data):
    _, _, fx, ft = data
    got = {r.eps: r for r in align.shrinkage_path(fx, ft, [0.01, 1000.0]).collect()}
    assert got[1000.0]["residual"] < 0.01 < got[0.01]["residual"]
    assert got[1000.0]["ratio"] == pytest.approx(1.0, abs=0.01)


def test_gradient_by_differences(data):
    x, t, fx, ft = data
    omega = mkmmd.frequencies(D, 6, 1.3)
    goal = mkmmd.feature_sums(ft, omega, np.eye(D), np.zeros(D), outer=False)
    at = lambda w, b: mkmmd.objective(mkmmd.feature_sums(fx, omega, w, b, outer=True), goal, omega, w, 0.3, 5)
    w, b = np.eye(D) + 0.1, np.full(D, 0.2)
    _, gw, gb = at(w, b)
    for i, j in ((0, 0), (1, 2)):
        e = np.zeros((D, D))
        e[i, j] = 1e-5
        assert gw[i, j] == pytest.approx((at(w + e, b)[0] - at(w - e, b)[0]) / 2e-5, rel=1e-5, abs=1e-8)
    e = np.eye(D)[1] * 1e-5
    assert gb[1] == pytest.approx((at(w, b + e)[0] - at(w, b - e)[0]) / 2e-5, rel=1e-5, abs=1e-8)


def test_features_estimate_the_kernel_discrepancy(data):
    x, t, fx, ft = data
    omega = mkmmd.frequencies(D, 400, 2.0, seed=3)
    one = lambda df: mkmmd.feature_sums(df, omega, np.eye(D), np.zeros(D), outer=False)
    got = mkmmd.discrepancy(one(fx), one(ft), 5)
    want = [mmd.mmd2(x, t, 2.0, (m,)) for m in mmd.MULTIPLIERS]
    assert np.allclose(got, want, atol=0.05)


@pytest.mark.parametrize("diagonal", [True, False])
def test_mkmmd_not_worse_than_start(data, diagonal):
    _, _, fx, ft = data
    m = align.MKMMD(lam=0.01, diagonal=diagonal, steps=8, features=16).fit(fx, ft)
    assert m.diagnostics["final_mmd2"] <= m.diagnostics["start_mmd2"]
    assert back(m.transform(fx, "source")).shape == (400, D)


def test_mkmmd_recovers_a_planted_map(spark):
    """Also with more rows than any pool would hold, and planted only in the rows with the largest ids."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3000, 2)), rng.normal(size=(3000, 2)) * [1.5, 0.5] + [1.0, -2.0]
    m = align.MKMMD(lam=0.0, diagonal=True, steps=25, features=32, warm_start=False).fit(frame(spark, x), frame(spark, y))
    assert np.allclose(np.diag(m.matrix), [1.5, 0.5], atol=0.15) and np.allclose(m.shift, [1.0, -2.0], atol=0.12)
    assert m.diagnostics["final_mmd2"] < 0.02 * m.diagnostics["start_mmd2"] and not m.diagnostics["reverted"]


def test_second_moments_in_one_scan(spark):
    """Far from zero, over keys, many tasks and more dimensions than a block."""
    rng = np.random.default_rng(6)
    d = ov.MOMENT_BLOCK + 9
    x = rng.normal(size=(700, d)) * rng.uniform(0.5, 2, d) + 1e4
    df = frame(spark, x).withColumn("k", F.col("item_id") % 3).repartition(7)
    for key in range(3):
        mine = x[np.arange(700) % 3 == key]
        rows = sorted(ov.gram(df, ["k"]).where(F.col("k") == key).collect(), key=lambda r: r["i"])
        y = mine - mine.mean(0)
        assert len(rows) == d and rows[0]["n"] == len(mine)
        assert np.allclose(rows[0]["mean"], mine.mean(0), rtol=1e-12)
        assert np.allclose(np.stack([r["row"] for r in rows]), y.T @ y, rtol=1e-6, atol=1e-5)
        assert sum(r["fourth"] for r in rows) == pytest.approx(((y * y).sum(1) ** 2).sum(), rel=1e-6)
    assert ov.gram(df.limit(0), ["k"]).count() == 0


def test_lbfgs_and_lockstep():
    a = np.diag([1.0, 50.0, 400.0])
    bowl = lambda c: lambda x: (float((x - c) @ a @ (x - c)), 2 * a @ (x - c))
    goals = {k: np.full(3, float(k)) for k in range(3)}
    jobs = []

    def evaluate(points):
        jobs.append(len(points))
        return {k: bowl(goals[k])(x) for k, x in points.items()}

    got = descent.drive({k: descent.lbfgs(np.ones(3) * 5, 100, 1e-8) for k in goals}, evaluate)
    assert all(s.converged and np.allclose(s.x, goals[k], atol=1e-5) for k, s in got.items())
    assert len(jobs) < 60 and jobs[0] == 3
    short = descent.drive({0: descent.lbfgs(np.ones(3) * 5, 2, 1e-8)}, evaluate)[0]
    assert not short.converged and short.steps == 2


def test_mmd_by_brute_force(data):
    x, t, fx, ft = data
    rows = mmd.two_sides(fx.limit(40), ft.limit(30)).withColumn("cell", F.lit(0)).cache()
    bw = mmd.median_bandwidth(rows, ["cell"])
    got = mmd.measure(rows, ["cell"], bw).first()
    a, b = mmd.sides_of(rows.toPandas())
    both = np.vstack([a, b])
    dist = [np.linalg.norm(p - q) for i, p in enumerate(both) for q in both[i + 1:]]
    h = np.sqrt(np.median(np.square(dist)))
    assert got["bandwidth"] == pytest.approx(h)
    k = lambda p, q: sum(np.exp(-((p - q) ** 2).sum() / (2 * (m * h) ** 2)) for m in mmd.MULTIPLIERS)
    xx = np.mean([k(p, q) for i, p in enumerate(a) for j, q in enumerate(a) if i != j])
    yy = np.mean([k(p, q) for i, p in enumerate(b) for j, q in enumerate(b) if i != j])
    xy = np.mean([k(p, q) for p in a for q in b])
    assert got["mmd2"] == pytest.approx(xx + yy - 2 * xy)


def test_same_distribution_may_be_negative(spark):
    rng = np.random.default_rng(5)
    vals = []
    for i in range(6):
        a, b = rng.normal(size=(30, 2)), rng.normal(size=(30, 2))
        vals.append(mmd.mmd2(a, b, 1.0))
    assert min(vals) < 0


def test_displaced_class_stands_out(spark):
    rng = np.random.default_rng(1)
    rows = []
    for lab, move in (("near", 0.0), ("far", 6.0), ("rare", 0.0)):
        n = 5 if lab == "rare" else 60
        for side, off in (("a", 0.0), ("b", move)):
            rows += [(lab, side, len(rows) + i, [float(v) for v in rng.normal(size=4) + off]) for i in range(n)]
    df = spark.createDataFrame(rows, "label string, side string, item_id bigint, v array<double>")
    got = {r.label: r for r in mmd.conditional_mmd(df, "label", 20).collect()}
    assert got["far"]["effect_size"] > 10 * abs(got["near"]["effect_size"])
    assert got["rare"]["effect_size"] is None and "support below 20 (source 5, target 5)" == got["rare"]["undefined_reason"]


def test_bandwidth_of_identical_points():
    assert mmd.bandwidth_of(np.ones((5, 2))) == 1.0


def test_blend_ends_and_range(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "o array<double>, a array<double>")
    end = lambda w: df.select(fv.blend(F.col("o"), F.col("a"), w)).first()[0]
    assert end(0.0) == [1.0, 2.0] and end(1.0) == [3.0, 5.0]
    with pytest.raises(ValueError):
        fv.blend(F.col("o"), F.col("a"), 1.2)
    with pytest.raises(ValueError):
        fv.blend_groups(F.col("o"), F.col("a"), [0, 3], [0.5])


def test_segments_of_short_items(spark):
    df = spark.createDataFrame([("short", 0, 1.0), ("short", 1, 3.0), ("one", 0, 7.0)] + [("long", i, float(i)) for i in range(16)], "u string, t int, x double")
    got = {(r.u, r.segment): r.x for r in ov.segment_pool(df, "u", F.floor(F.col("t") / 4), ["t"], ["x"], 8).collect()}
    assert len(got) == 24
    assert [got[("long", i)] for i in range(8)] == [0.5 + 2 * i for i in range(8)]
    assert [got[("short", i)] for i in range(8)] == [1.0] * 4 + [3.0] * 4
    assert {got[("one", i)] for i in range(8)} == {7.0}


def test_layer_specs():
    assert ov.parse_layer_spec(" last ", 13) == ("last", 12, 12)
    assert ov.parse_layer_spec("mean:2-5", 13) == ("mean", 2, 5)
    for bad in ("layer:13", "mean:5-2", "first"):
        with pytest.raises(ValueError):
            ov.parse_layer_spec(bad, 13)


def test_dimension_groups_follow_profiles(spark):
    """Decided by the rows with the largest ids: over the first thousand all dimensions are alike."""
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=1500), rng.normal(size=1500)
    b[1200:] += 9
    a[:1200] = b[:1200]
    x = np.stack([a, b, a + 0.01, b + 0.01], axis=1)
    got = {r["dim"]: r["group"] for r in ov.group_dims(frame(spark, x), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}


def test_kernel_kmeans_equals_kmeans_cost():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 30)) * 6
    p = centres[np.arange(40) % 4] + rng.normal(size=(40, 30))
    label = ov.kernel_kmeans(p @ p.T, 4, seed=2)
    assert len(set(label)) == 4 and all((label[:4] == label[k : k + 4]).all() for k in range(0, 40, 4))
    got = {g: s for g, _, s in ov.scatter(p @ p.T, label)}
    for g in got:
        mine = p[label == g]
        assert got[g] == pytest.approx(((mine - mine.mean(0)) ** 2).sum())


def test_ladder_keeps_rungs_without_an_effect_and_notes_warm_starts(data, spark):
    _, _, fx, ft = data
    still = spark.createDataFrame([(i, [1.0] * D) for i in range(12)], "item_id bigint, v array<double>")
    rungs = {"none": mmd.two_sides(fx, ft), "mean_shift": mmd.two_sides(align.MeanShift().fit(fx, ft).transform(fx, "source"), ft), "flat": mmd.two_sides(still, still)}
    got = {(r.rung, r.bandwidth_scale): r for r in mmd.ladder_table(rungs, (0.5, 1.0), repeats=3, cap=100, reverted={"mean_shift": True}).collect()}
    assert len(got) == 6
    assert got["flat", 1.0].effect_size is None and got["flat", 1.0]["rank"] is None and not got["flat", 1.0].stable
    assert got["none", 1.0]["rank"] > got["mean_shift", 1.0]["rank"] == 1 and got["none", 0.5].stable
    assert "warm start" in got["mean_shift", 0.5].note and got["none", 0.5].note is None
