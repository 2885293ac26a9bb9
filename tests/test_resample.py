import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomark.operators import resample as rs
from fathomark.operators import summaries as sm

CLASSES = ("a", "b", "c")


def _arms(spark, hit_a, hit_b, n=1800):
    rng = np.random.default_rng(3)
    rows = []
    for arm, hit in (("a", hit_a), ("b", hit_b)):
        t = rng.integers(0, 3, n)
        p = np.where(rng.random(n) < hit, t, rng.integers(0, 3, n))
        # Group 0 holds a third of all rows.
        g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 12, n))
        rows += [(int(i % 3), "c0" if i % 2 else "c1", int(g[i]), arm, CLASSES[t[i]], CLASSES[p[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "seed int, cond string, grp int, arm string, y_true string, y_pred string")
    return rs.pack_arms(df, CLASSES, [], "arm", ("a", "b")).cache()


@pytest.fixture(scope="module")
def planted(spark):
    return _arms(spark, 0.8, 0.3)


def test_rows_and_blocks_agree(planted):
    a = rs.replicates(planted, ["a", "b"], 3, [], 30).toPandas().sort_values("rep")
    b = rs.block_replicates(planted, ["a", "b"], 3, [], 30, blocks=4).toPandas().sort_values("rep")
    assert np.allclose(a["s_a"], b["s_a"]) and np.allclose(a["s_b"], b["s_b"])


def test_replicates_match_brute_force(planted):
    """The same draws applied one by one in plain Python."""
    pdf, reps = planted.toPandas(), 12
    groups = rs.index_groups(planted)
    idx = {(r.seed, r.idx): r.grp for r in groups.collect()}
    draws = rs.group_draws(groups, reps).toPandas()
    seeds = rs.seed_draws(groups, reps).toPandas()
    got = {r.rep: r.s_a for r in rs.replicates(planted, ["a"], 3, [], reps).collect()}

    def f1(cells):
        m = cells.reshape(3, 3)
        den = m.sum(0) + m.sum(1)
        return np.mean(2 * np.diag(m)[den > 0] / den[den > 0])

    for rep in range(reps):
        per = []
        for s in seeds[seeds.rep == rep]["seed"]:
            scores = []
            for c in ("c0", "c1"):
                total = np.zeros(9)
                for i in draws[(draws.rep == rep) & (draws.seed == s)]["idx"]:
                    hit = pdf[(pdf.seed == s) & (pdf.cond == c) & (pdf.grp == idx[(s, i)])]
                    for v in hit["a"]:
                        total += v
                scores.append(f1(total))
            per.append(np.mean(scores))
        assert got[rep] == pytest.approx(np.mean(per), abs=1e-12)


def test_planted_effect_found_and_null_not(spark, planted):
    hit = rs.paired_bootstrap(planted, "a", "b", 3, reps=100).first()
    assert hit["diff"] > 0.2 and hit["lo"] > 0 and hit["p_at_floor"] and hit["p"] == pytest.approx(0.01)
    null = rs.paired_bootstrap(_arms(spark, 0.6, 0.6), "a", "b", 3, reps=100).first()
    assert null["lo"] < 0 < null["hi"] and null["p"] > 0.01


def test_one_sided_seed_is_left_out(spark):
    rows = [(0, "c", g, arm, "a", "a") for g in range(4) for arm in ("a", "b")] + [(1, "c", 0, "a", "a", "a")]
    df = spark.createDataFrame(rows, "seed int, cond string, grp int, arm string, y_true string, y_pred string")
    p = rs.pack_arms(df, CLASSES, [], "arm", ("a", "b"))
    assert rs.paired_bootstrap(p, "a", "b", 3, reps=5).first()["n_seeds"] == 1


def test_unknown_method(planted):
    with pytest.raises(ValueError):
        rs.cluster_bootstrap(planted, "a", 3, reps=5, method="magic")


def test_item_routes_agree(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 600)
    p = np.where(rng.random(600) < 0.7, t, rng.integers(0, 3, 600))
    df = spark.createDataFrame([(0, int(i), CLASSES[a], CLASSES[b]) for i, (a, b) in enumerate(zip(t, p))], "k int, i int, y_true string, y_pred string")

    def macro(m):
        return float(np.mean(2 * np.diag(m) / (m.sum(0) + m.sum(1))))

    a = rs.item_bootstrap(df, CLASSES, ["k"], "i", 200).first()
    b = rs.metric_bootstrap(df, CLASSES, ["k"], macro, 2000).first()
    assert a["point"] == pytest.approx(b["point"])
    assert a["lo"] == pytest.approx(b["lo"], abs=0.02) and a["hi"] == pytest.approx(b["hi"], abs=0.02)
    assert b["n_resamples"] == 2000


def test_seed_interval_resolution(spark):
    df = spark.createDataFrame([("one", 1.0), ("two", 1.0), ("two", 3.0), ("bad", float("nan")), ("bad", None), ("bad", 2.0)], "k string, v double")
    got = {r.k: r for r in sm.seed_interval(df, ["k"], "v").collect()}
    assert got["one"]["lo"] is None and got["bad"]["n"] == 1
    assert got["two"]["hi"] - got["two"]["mean"] == pytest.approx(12.706)


def test_wilcoxon_exact(spark):
    d = [1.5, -0.5, 2.0, 3.0, 4.0, -1.0, 2.5, 0.0]
    df = spark.createDataFrame([("f", x, 0.0) for x in d], "f string, a double, b double")
    r = rs.wilcoxon(df, ["f"]).first()
    assert r["n_pairs"] == 8 and r["n_nonzero"] == 7 and r["statistic"] == 3.0
    # Sets of ranks from 1..7 with sum <= 3: {}, 1, 2, 3, 1+2.
    assert r["p_value"] == pytest.approx(2 * 5 / 128)
    same = spark.createDataFrame([("f", 1.0, 1.0)] * 3, "f string, a double, b double")
    assert rs.wilcoxon(same, ["f"]).first()["p_value"] == 1.0


def test_difference_counts_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {(r.x, r.excess) for r in rs.difference(a, b).collect()} == {(1, 1), (3, -1)}


def test_keys_with_other_seeds_and_groups_resample_alone(spark, planted):
    """A joint run over keys gives each key what it gets alone, with every replicate."""
    x = planted.withColumn("key", F.lit("x"))
    y = planted.where("seed < 2 AND grp > 3").withColumn("grp", F.col("grp") + 100).withColumn("key", F.lit("y"))
    for method in ("rows", "blocks"):
        joint = {r.key: r for r in rs.paired_bootstrap(x.unionByName(y), "a", "b", 3, ["key"], 40, method=method).collect()}
        for name, part in (("x", x), ("y", y)):
            (alone,) = rs.paired_bootstrap(part, "a", "b", 3, ["key"], 40, method=method).collect()
            got = joint[name]
            assert got.n_boot == 40 and got.n_seeds == alone.n_seeds
            assert [got[c] for c in ("diff", "lo", "hi", "p")] == pytest.approx([alone[c] for c in ("diff", "lo", "hi", "p")])
