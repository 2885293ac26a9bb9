import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomark.operators import floors, metrics, priors

CLASSES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(0)
    t = rng.integers(0, 3, 900)
    p = np.where(rng.random(900) < 0.7, t, rng.integers(0, 3, 900))
    rows = [(0, int(i % 9), CLASSES[a], CLASSES[b]) for i, (a, b) in enumerate(zip(t, p))]
    return spark.createDataFrame(rows, "k int, grp int, y_true string, y_pred string").cache()


def _brute(t, p, absent):
    out = []
    for c in CLASSES:
        tp, s, q = ((t == c) & (p == c)).sum(), (t == c).sum(), (p == c).sum()
        if s + q:
            out.append(2 * tp / (s + q))
        elif absent == "zero":
            out.append(0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("absent", ["zero", "drop"])
def test_macro_f1_both_rules(preds, absent):
    pdf = preds.toPandas()
    got = metrics.macro_f1(metrics.confusion_counts(preds, ["k"]), CLASSES, ["k"], absent).first()["macro_f1"]
    assert got == pytest.approx(_brute(pdf.y_true, pdf.y_pred, absent), abs=1e-12)


def test_unknown_rule_refused(preds):
    with pytest.raises(ValueError):
        metrics.macro_f1(metrics.confusion_counts(preds, ["k"]), CLASSES, ["k"], "maybe")


def test_group_counts_add_up(preds):
    whole = {(r.y_true, r.y_pred): r.n for r in metrics.confusion_counts(preds, ["k"]).collect()}
    parts = metrics.confusion_by_group(preds, ["k"], "grp").groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
    assert whole == {(r.y_true, r.y_pred): r.n for r in parts.collect()}


def test_pack_round_trip(preds):
    raw = metrics.confusion_by_group(preds, ["k"], "grp")
    back = metrics.unpack_confusion(metrics.pack_confusion(raw, CLASSES, ["k", "grp"]), CLASSES, ["k", "grp"])
    assert raw.exceptAll(back.select(*raw.columns)).count() == 0 == back.select(*raw.columns).exceptAll(raw).count()


def test_all_classes_in_frame(preds):
    conf = metrics.confusion(preds, CLASSES, ["k"])
    assert conf.count() == 16
    assert metrics.collapsed(metrics.confusion_counts(preds, ["k"]), CLASSES, ["k"]).first()["class"] == "d"


def test_closed_form_inside_simulation(preds):
    vec = priors.prior_vector(preds, CLASSES[:3], ["k"], "y_true")
    exact = floors.analytic_floors(vec, vec, ["k"], 3).first()
    sim = floors.multinomial_floor(vec.select("k", "counts"), ["k"], 2000).first()
    assert sim["lo"] < exact["chance_macro_f1"] < sim["hi"]
    # The closed form is F1 of expectations; the mean over draws lies within a percent of it here.
    assert sim["mean"] == pytest.approx(exact["chance_macro_f1"], rel=0.01)
    item = floors.empirical_floor(
        preds.withColumn("i", F.monotonically_increasing_id()), CLASSES[:3], ["k"], floors.uniform_prediction(CLASSES[:3]), "i", 60
    ).first()
    assert item["mean"] == pytest.approx(sim["mean"], rel=0.02)


def test_balanced_chance_is_one_over_k(spark):
    vec = spark.createDataFrame([(0, [5, 5, 5, 5], [0.25] * 4)], "k int, counts array<bigint>, p array<double>")
    r = floors.analytic_floors(vec, vec, ["k"], 4).first()
    assert r["chance_macro_f1"] == pytest.approx(0.25)
    assert r["majority_macro_f1"] == pytest.approx(0.1)


def test_majority_ties(spark):
    df = spark.createDataFrame([([3, 7, 7],)], "c array<bigint>")
    got = df.select(floors.majority_index(F.col("c"), "last").alias("l"), floors.majority_index(F.col("c"), "first").alias("f")).first()
    assert (got["l"], got["f"]) == (2, 1)


def test_divergences(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.5, 0.0, 0.5])], "p array<double>, q array<double>")
    r = df.select(
        priors.kl_vec(F.col("p"), F.col("q")).alias("inf"), priors.kl_vec(F.col("p"), F.col("p")).alias("zero"),
        priors.js_vec(F.col("p"), F.col("q")).alias("js"), priors.clipped_kl_vec(F.col("q"), F.col("p")).alias("clip"),
        priors.unsupported(F.col("p"), F.col("q"), ("x", "y", "z")).alias("u"),
    ).first()
    assert r["inf"] == float("inf") and r["zero"] == 0.0
    assert r["js"] == pytest.approx(np.sqrt(0.5 * np.log(2)))
    assert r["clip"] > 10 and r["u"] == ["z"]


def test_published_prior_shift(spark):
    """A six-class and a balanced-but-one-class corpus: KL of their counts by hand."""
    p, q = np.array([376, 192, 192, 192, 288, 192]), np.array([1271, 1271, 1271, 1271, 1087, 1271])
    rows = [("s", c, int(n)) for c, n in zip("abcdef", p)] + [("t", c, int(n)) for c, n in zip("abcdef", q)]
    df = spark.createDataFrame(rows, "corpus string, label string, n int").select("corpus", "label", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    got = priors.prior_shift_table(df, tuple("abcdef"), "corpus").where("source = 's'").first()
    a, b = p / p.sum(), q / q.sum()
    assert got["kl"] == pytest.approx((a * np.log(a / b)).sum(), abs=1e-12)
