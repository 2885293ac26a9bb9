import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomark.operators import align, heads, ledger, models, shift, splits

CLASSES = ("x", "y", "z")


def vecs(spark, n=240, seed=0, prior=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = int(rng.choice(3, p=prior)) if prior else i % 3
        v = rng.normal(size=4) * 0.6
        v[c] += 2.0
        rows.append((i, f"c{i % 2}", i % 16, CLASSES[c], [float(u) for u in v]))
    return spark.createDataFrame(rows, "item_id bigint, corpus string, grp bigint, label string, v array<double>")


@pytest.fixture(scope="module")
def data(spark):
    return vecs(spark).cache()


@pytest.fixture(scope="module")
def split_rows(data):
    return splits.pair_split(data.select("item_id", "corpus", "grp", "label"), ("c0", "c1"), (0,)).cache()


def test_candidates_shared_by_arms_and_bounded(spark):
    a, b = (models.candidate_list(spark, "svm_rbf", 3, 20) for _ in range(2))
    assert a == b and len({p["C"] for p in a}) == 20
    assert all(1e-3 <= p["C"] <= 1e4 and 1e-6 <= p["gamma"] <= 1 for p in a)
    assert models.candidate_list(spark, "svm_rbf", 4, 3) != a[:3]


def test_failed_trial_is_recorded_and_not_retried(data):
    train, val = data.where("item_id % 4 <> 0"), data.where("item_id % 4 = 0")
    params = [{"C": 1e4, "max_iter": 1}, {"C": 1.0}]
    sel = models.fit_select(train, val, "logreg", params, CLASSES)
    assert len(sel.trials) == 2 and sel.trials[0]["score"] is None and "stopped" in sel.trials[0]["error"]
    assert sel.params == params[1] and sel.score > 0.9
    with pytest.raises(RuntimeError):
        models.fit_select(train, val, "logreg", params[:1], CLASSES)


def test_every_family_learns(data):
    train, val = data.where("item_id % 4 <> 0").cache(), data.where("item_id % 4 = 0").cache()
    for family, p in (("svm_linear", {"C": 1.0}), ("svm_rbf", {"C": 10.0, "gamma": 0.1}), ("mlp", {"lr": 0.03, "hidden": 8})):
        fit = models.build(family, train, CLASSES, p, "label", train.count(), {})
        assert models.score_of(fit.predict(val), CLASSES, "label")["macro_f1"] > 0.85, family


def test_perceptrons_follow_their_parameters(data):
    """Two step sizes are two models; a cap that ends a fit refuses it; a batch draws part of the rows."""
    train, val = data.where("item_id % 4 <> 0"), data.where("item_id % 4 = 0")
    params = [{"lr": 0.03, "hidden": 8}, {"lr": 0.01, "hidden": 8, "depth": 2, "dropout": 0.1, "weight_decay": 0.01, "batch_size": 1}, {"lr": 1e-5, "hidden": 8, "max_iter": 15}]
    a, b, c = models.fit_heads(train, "mlp", CLASSES, params, "label")
    assert isinstance(c, models.NotConverged) and "stopped at 15" in str(c)
    pa, pb = ([r["p"] for r in m.predict(val).orderBy("item_id").collect()] for m in (a, b))
    assert np.abs(np.array(pa) - np.array(pb)).max() > 1e-3


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    counts = tuple(np.bincount(y, minlength=3).tolist())
    h = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    for family, p in (("logreg", {"class_weight": "balanced"}), ("svm_linear", {"class_weight": "balanced"}), ("mlp", {"hidden": 5, "depth": 2, "dropout": 0.3})):
        head = heads.Head("", family, p, 4, counts)
        theta = rng.normal(size=len(head.start()))
        f = lambda t: heads._loss(head, t, x, y, heads._dropout(head, 3, h))  # noqa: B023, E731
        _, g = f(theta)
        for i in rng.integers(0, len(theta), 8):
            e = np.zeros_like(theta)
            e[i] = 1e-6
            assert g[i] == pytest.approx((f(theta + e)[0] - f(theta - e)[0]) / 2e-6, rel=1e-4, abs=1e-6), family


def test_many_cells_in_step_equal_single_fits(spark, data):
    """Heads of two cells and two families share each job and end where they end alone."""
    rows = heads.training_rows(data.withColumn("c", F.concat(F.lit("c"), F.col("item_id") % 2)), CLASSES, "label", "c").cache()
    shape = heads.shapes(rows, 3)
    named = {f"{c}/{f}": heads.Head(c, f, {"C": 0.5, "class_weight": "balanced"}, *shape[c]) for c in shape for f in ("logreg", "svm_linear")}
    got = heads.fit_all(rows, named)
    assert all(s.converged for s in got.values())
    for name, head in named.items():
        alone = heads.fit_all(rows.where(F.col("cell") == head.cell), {name: head})[name]
        assert np.allclose(alone.x, got[name].x, atol=1e-6), name
        # A minimum: no step in any direction is lower.
        at = lambda t: heads.evaluate(rows, {name: head}, {name: t}, {name: 1})[name]  # noqa: B023, E731
        assert np.linalg.norm(at(got[name].x)[1]) <= 1e-4 * np.linalg.norm(at(head.start())[1])


def test_translation_leaves_kernel_decisions_unchanged(data):
    """Moving every vector by one offset rotates the random features and nothing else."""
    moved = data.withColumn("v", F.transform("v", lambda x: x + 3.0))
    a, b = (models.fit_kernel_ridge(models.kernel_stats(d, CLASSES, "label", 0.2, 64, 0), 1.0).predict(d) for d in (data, moved))
    j = a.select("item_id", F.col("p").alias("pa"), F.col("y_pred").alias("ya")).join(b.select("item_id", "p", "y_pred"), "item_id").collect()
    assert all(r["ya"] == r["y_pred"] for r in j)
    assert max(np.abs(np.array(r["pa"]) - np.array(r["p"])).max() for r in j) < 1e-9


def test_cell_reports_score_beside_floors(spark, data, split_rows):
    cells = [models.Cell("c0", "c1", 0, "svm_rbf", "zscore", budget=2), models.Cell("c0", "c1", 0, "svm_rbf", "magic")]
    ok, bad = models.run_cells(spark, data, split_rows, cells, CLASSES).collect()
    assert ok["status"] == "ok" and ok["macro_f1"] > ok["chance_macro_f1"] > ok["majority_macro_f1"]
    assert bad["status"] == "failed" and "magic" in bad["error"] and bad["macro_f1"] is None


def test_cell_rows_are_ledger_rows_and_scores_follow_from_stored_predictions(spark, data, split_rows, tmp_path):
    out = str(tmp_path / "predictions")
    cells = [
        models.Cell("c0", "c1", 0, "svm_rbf", "coral", (("eps", 0.1),), budget=2, blend_alpha=0.5),
        models.Cell("c0", "c1", 0, "logreg", "zscore", budget=2), models.Cell("c0", "c1", 0, "svm_rbf", "magic"),
    ]
    rows = models.run_cells(spark, data, split_rows, cells, CLASSES, predictions=out, workers=2).cache()
    constants = {f.name: {"string": "x", "bigint": 0, "boolean": False}[f.kind] for f in ledger.FIELDS if not f.nullable and f.name not in (*models.CELL_COLUMNS, "schema_version")}
    full = models.to_ledger(rows, **constants)
    assert ledger.schema_problems(full) == [] and ledger.violations(full, ledger.ledger_rules(), ["run_id"]).count() == 0
    got = {r.run_id: r for r in rows.collect()}
    assert [got[c.run_id].status for c in cells] == ["ok", "ok", "failed"] and "magic" in got[cells[2].run_id].error
    truth = {str(r.item_id): r.label for r in data.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE truth(item_id VARCHAR, y_true VARCHAR)")
    con.executemany("INSERT INTO truth VALUES (?, ?)", list(truth.items()))
    for cell in cells[:2]:
        row = got[cell.run_id]
        con.execute(f"""CREATE OR REPLACE VIEW p AS SELECT unnest(utterance_ids) AS item_id, unnest(predicted) AS y_pred
            FROM read_json('{row.predictions_path}/*.json.gz', columns = {{run_id: 'VARCHAR', utterance_ids: 'VARCHAR[]', predicted: 'VARCHAR[]'}})""")
        n, f1 = con.execute("""WITH j AS (SELECT * FROM p JOIN truth USING (item_id)), c AS (SELECT unnest(['x', 'y', 'z']) AS c),
            s AS (SELECT c, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true = c) + count(*) FILTER (y_pred = c) AS both_sides FROM j, c GROUP BY c)
            SELECT (SELECT count(*) FROM j), avg(CASE WHEN both_sides = 0 THEN 0 ELSE 2.0::DOUBLE * tp / both_sides END) FROM s""").fetchone()
        assert n == row.n_target_test > 0 and f1 == pytest.approx(row.macro_f1)
        matrix = np.array(json.loads(row.confusion_json))
        assert matrix.sum() == n and np.trace(matrix) / n == pytest.approx(row.accuracy)
        assert list(json.loads(row.per_class_support_json).values()) == matrix.sum(1).tolist()
        assert row.marginal_mmd_reference is not None and row.n_train + row.n_val + row.n_target_adapt + n > 200
    assert got[cells[0].run_id].cov_condition_number > 1 and got[cells[0].run_id].blending == "scalar"


def test_alignment_that_saw_the_test_rows_is_refused(spark, data, split_rows, monkeypatch):
    class Peeking(align.Identity):
        def _fit(self, source, adapt):
            self.seen = data

        @property
        def fit_ids(self):
            return data.select("item_id")

        @fit_ids.setter
        def fit_ids(self, value):
            pass

    monkeypatch.setitem(align.RUNGS, "peeking", Peeking)
    row = models.run_cells(spark, data, split_rows, [models.Cell("c0", "c1", 0, "svm_rbf", "peeking")], CLASSES).first()
    assert row.status == "failed" and "target_test" in row.error


def test_grid_resumes_and_shards(spark, data, split_rows, tmp_path):
    plan = spark.createDataFrame([(f"{i:08x}rest", a) for i, a in enumerate(("none", "zscore", "mean_shift", "magic"))], "run_id string, alignment string")
    done = plan.where("alignment = 'none'").select("run_id")
    out = str(tmp_path / "rows")
    cell = lambda r: models.Cell("c0", "c1", 0, "svm_rbf", r["alignment"], budget=1)
    sink = lambda df: df.write.mode("append").json(out)
    n = models.run_grid(spark, plan, done, cell, data, split_rows, CLASSES, sink, (1, 2))
    assert n == 2
    got = {r.run_id: r.status for r in spark.read.json(out).collect()}
    assert got == {"00000001rest": "ok", "00000003rest": "failed"}


def test_unequal_budgets_refused(spark, data, split_rows):
    with pytest.raises(ValueError):
        models.check_conditions(spark, data, split_rows, [models.Cell("c0", "c1", 0), models.Cell("c0", "c1", 0, budget=9)], CLASSES)


# ---- label shift -----------------------------------------------------------
def _posterior_frame(spark, n, prior, seed):
    """Exact posteriors of a three-class model with balanced training prior."""
    rng = np.random.default_rng(seed)
    y = rng.choice(3, size=n, p=prior)
    x = rng.normal(size=(n, 3)) + 1.5 * np.eye(3)[y]
    e = np.exp(1.5 * x)
    p = e / e.sum(1, keepdims=True)
    return spark.createDataFrame([(CLASSES[a], CLASSES[int(q.argmax())], [float(v) for v in q]) for a, q in zip(y, p)], "y_true string, y_pred string, p array<double>")


def test_bbse_and_em_recover_planted_prior(spark):
    want = [0.6, 0.3, 0.1]
    src, tgt = _posterior_frame(spark, 4000, [1 / 3] * 3, 0), _posterior_frame(spark, 4000, want, 1)
    em = shift.em_prior(tgt, [1 / 3] * 3)
    assert np.allclose(em, want, atol=0.04)
    p, est = np.array([r.p for r in tgt.collect()]), np.full(3, 1 / 3)
    for _ in range(1000):
        post = p * est * 3
        last, est = est, (post / post.sum(1, keepdims=True)).mean(0)
        if np.abs(est - last).max() < 1e-8:
            break
    assert np.allclose(em, est, atol=1e-9)
    assert shift.em_prior(tgt.limit(0), [0.5, 0.25, 0.25]) == [0.5, 0.25, 0.25]
    rows = src.withColumn("side", F.lit("s")).unionByName(tgt.withColumn("side", F.lit("t")))
    got = shift.bbse(rows, CLASSES, []).first()
    assert np.allclose(got["target_prior"], want, atol=0.05)
    raw = models.score_of(tgt, CLASSES, "y_true")["accuracy"]
    fixed = shift.prior_correct(tgt, [1 / 3] * 3, em, CLASSES)
    assert models.score_of(fixed.drop("y_pred").withColumnRenamed("y_corrected", "y_pred"), CLASSES, "y_true")["accuracy"] > raw


def test_unidentifiable_confusion_gives_null(spark):
    df = spark.createDataFrame([("s", "x", "x"), ("s", "y", "x"), ("s", "z", "x"), ("t", "x", "x")], "side string, y_true string, y_pred string")
    r = shift.bbse(df, CLASSES, []).first()
    assert r["weights"] is None and r["target_prior"] is None
