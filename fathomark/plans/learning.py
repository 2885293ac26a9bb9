"""Label-shift correction, candidate lists, and model fits on the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import align, metrics, mmd, models, priors, shift, splits
from .registry import query, r9, sql_r9, table
from .runs import rounded
from .views import EVENT_TYPES, PRED_SQL, predictions, sql_list, vectors

K = len(EVENT_TYPES)
LABELS = tuple(str(i) for i in range(10))
PRIOR = (0.1, 0.2, 0.3, 0.15, 0.25)
TARGET = (0.3, 0.1, 0.2, 0.2, 0.2)


# ---- posteriors planted on events ------------------------------------------
# The predicted class gets 0.4 .. 0.79, the others share the rest.
PROBA_SQL = f"""{PRED_SQL}, pr AS (SELECT item_id, domain, y_true, y_pred, 0.4::DOUBLE + (item_id % 40) / 101.0::DOUBLE AS top,
 list_position({sql_list(EVENT_TYPES)}, y_pred) - 1 AS pos FROM pred),
pl AS (SELECT item_id, domain, y_true, i, CASE WHEN i = pos THEN top ELSE (1 - top) / {K - 1} END AS p FROM pr, (SELECT unnest(range({K})) AS i))"""


def posteriors(spark, d):
    p = predictions(spark, d)
    top = F.lit(0.4) + (F.col("item_id") % 40) / F.lit(101.0)
    vec = F.array(*[F.when(F.col("y_pred") == c, top).otherwise((1 - top) / (K - 1)) for c in EVENT_TYPES])
    return p.withColumn("p", vec)


def _list(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


@query("prior_correct", f"""WITH {PROBA_SQL}, w AS (SELECT *, p * ({_list(np.array(TARGET) / np.array(PRIOR))})[i + 1] AS q FROM pl),
n AS (SELECT *, q / sum(q) OVER (PARTITION BY item_id) AS c FROM w)
SELECT item_id, {sql_r9('max(c)')} AS top, ({sql_list(EVENT_TYPES)})[CAST(arg_min(i, (-round(c, 12), i)) AS BIGINT) + 1] AS y_corrected FROM n GROUP BY item_id""")
def prior_correct(spark, d):
    out = shift.prior_correct(posteriors(spark, d), PRIOR, TARGET, EVENT_TYPES)
    return out.select("item_id", r9(F.array_max("p_corrected")).alias("top"), "y_corrected")


def _em_sql(step: int) -> str:
    return f"""e{step} AS (SELECT i, avg(x) AS e FROM (SELECT item_id, pl.i, p * e / p0 / sum(p * e / p0) OVER (PARTITION BY item_id) AS x
 FROM pl JOIN e{step - 1} ON e{step - 1}.i = pl.i JOIN prior0 ON prior0.i = pl.i) GROUP BY i)"""


@query("em_three_steps", f"""WITH {PROBA_SQL}, prior0 AS (SELECT i, ({_list(PRIOR)})[i + 1] AS p0 FROM (SELECT unnest(range({K})) AS i)),
e0 AS (SELECT i, p0 AS e FROM prior0), {_em_sql(1)}, {_em_sql(2)}, {_em_sql(3)}
SELECT CAST(i AS INTEGER) AS class_index, {sql_r9('e')} AS estimate FROM e3""")
def em_three_steps(spark, d):
    comp = shift.compress(posteriors(spark, d)).persist()
    est = list(PRIOR)
    for _ in range(3):
        est = shift.em_step(comp, PRIOR, est)
    comp.unpersist()
    out = spark.createDataFrame([(i, e) for i, e in enumerate(est)], "class_index int, estimate double")
    return rounded(out, "estimate")


_MIX = " + ".join(f"p[{i + 1}] * est[{i + 1}] / {q}::DOUBLE" for i, q in enumerate(PRIOR))
_NEXT = ", ".join(f"sum(w * p[{i + 1}] * est[{i + 1}] / {q}::DOUBLE / ({_MIX})) / sum(w)" for i, q in enumerate(PRIOR))


@query("em_prior", f"""WITH RECURSIVE {PROBA_SQL}, comp AS (SELECT p, count(*) AS w FROM (SELECT item_id, list(p ORDER BY i) AS p FROM pl GROUP BY item_id) GROUP BY p),
em AS (SELECT 0 AS step, {_list(PRIOR)} AS est, 1.0::DOUBLE AS moved
 UNION ALL SELECT step + 1, new, list_max(list_transform(list_zip(new, est), lambda x: abs(x[1] - x[2])))
 FROM (SELECT step, est, [{_NEXT}] AS new FROM em, comp WHERE step < 1000 AND moved >= 1e-8 GROUP BY step, est)),
fin AS (SELECT est FROM em ORDER BY step DESC LIMIT 1)
SELECT CAST(i AS INTEGER) AS class_index, {sql_r9('est[i + 1]')} AS estimate FROM fin, (SELECT unnest(range({K})) AS i)""")
def em_prior(spark, d):
    est = shift.em_prior(posteriors(spark, d), PRIOR)
    out = spark.createDataFrame([(i, e) for i, e in enumerate(est)], "class_index int, estimate double")
    return rounded(out, "estimate")


def _shift_rows(spark, d):
    p = predictions(spark, d)
    return p.withColumn("side", F.when(F.col("domain") == 0, "s").otherwise("t"))


@query("shift_counts", f"""WITH {PRED_SQL} SELECT seed, y_true, y_pred, count(*) FILTER (WHERE domain = 0) AS n_source, count(*) FILTER (WHERE domain = 1) AS n_target
FROM pred GROUP BY ALL HAVING count(*) FILTER (WHERE domain = 0) > 0""")
def shift_counts(spark, d):
    c = shift.shift_counts(_shift_rows(spark, d), EVENT_TYPES, ["seed"])
    names = F.array(*[F.lit(x) for x in EVENT_TYPES])
    e = c.select("seed", F.posexplode("joint").alias("pos", "n_source")).where("n_source > 0")
    long = e.select("seed", F.get(names, F.floor(F.col("pos") / K).cast("int")).alias("y_true"),
                    F.get(names, F.col("pos") % K).alias("y_pred"), "n_source")
    t = predictions(spark, d).where("domain = 1").groupBy("seed", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n_target"))
    return long.join(t, ["seed", "y_true", "y_pred"], "left").fillna(0, ["n_target"])


@query("bbse")
def bbse(spark, d):
    """Weights of domain 0 against domain 1, one row per event class."""
    w = shift.bbse(_shift_rows(spark, d), EVENT_TYPES, [])
    return w.select(F.posexplode(F.arrays_zip("weights", "target_prior")).alias("class_index", "z")).select(
        "class_index", r9("z.weights").alias("weight"), r9("z.target_prior").alias("target_prior"))


# ---- candidates ------------------------------------------------------------
def _u(name: str) -> str:
    return f"CAST('0x' || substr(sha256('cand|' || family || '|' || seed || '|' || candidate_index || '|{name}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _value(name: str) -> str:
    cases = []
    for family, space in models.SPACES.items():
        if name in models.LOG_SCALE and name in space:
            lo, hi = space[name]
            cases.append(f"WHEN '{family}' THEN {sql_r9(f'log10(power(10, {lo}::DOUBLE + ({_u(name)}) * {hi - lo}::DOUBLE))')}")
        elif name in space:
            items = ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::{'DOUBLE' if isinstance(x, float) else 'INTEGER'}" for x in space[name])
            cases.append(f"WHEN '{family}' THEN ([{items}])[CAST(floor(({_u(name)}) * {len(space[name])}) AS BIGINT) + 1]")
    return f"CASE family {' '.join(cases)} END AS {name}"


SEARCHED = tuple(dict.fromkeys(n for space in models.SPACES.values() for n in space))


@query("candidates", f"""WITH b AS (SELECT candidate_index, family, seed FROM (SELECT CAST(unnest(range(20)) AS BIGINT) AS candidate_index), (SELECT unnest({sql_list(models.SPACES)}) AS family),
 (SELECT DISTINCT user_id % 3 AS seed FROM events))
SELECT candidate_index, family, seed, {', '.join(_value(n) for n in SEARCHED)} FROM b""")
def candidates(spark, d):
    """Candidate lists of every family and dimension for the seeds present in the events; log-uniform ones as logarithms."""
    seeds = [r["s"] for r in table(spark, d, "events").select((F.col("user_id") % 3).alias("s")).distinct().collect()]
    c = models.candidates(spark, list(models.SPACES), sorted(seeds), 20)
    value = lambda n: r9(F.log10(n)).alias(n) if n in models.LOG_SCALE else F.col(n)
    return c.select("candidate_index", "family", F.col("seed").cast("long").alias("seed"), *[value(n) for n in SEARCHED])


# ---- models ----------------------------------------------------------------
def labelled_vectors(spark, d):
    """Embeddings as two corpora, with one coordinate moved by the label so that there is signal."""
    v = vectors(spark, d)
    lab = F.col("label").cast("string")
    plant = F.transform("v", lambda x, i: x + F.when(i == F.col("label"), 0.8).otherwise(0.0) + F.when(F.col("domain") == 1, 0.05).otherwise(0.0))
    return v.select("item_id", F.concat(F.lit("d"), F.col("domain").cast("string")).alias("corpus"), "grp", plant.alias("v"), lab.alias("label"))


def split_rows(spark, d):
    items = labelled_vectors(spark, d).select("item_id", "corpus", "grp", "label")
    return splits.pair_split(items, ("d0", "d1"), (0,))


@query("fit_select")
def fit_select(spark, d):
    """Trials of two families on one pair, selected on validation only."""
    roles = models._roles(labelled_vectors(spark, d), split_rows(spark, d), models.Cell("d0", "d1", 0))
    out = []
    for family in ("logreg", "svm_rbf"):
        params = [{**p, "max_iter": 50} for p in models.candidate_list(spark, family, 0, 3)]
        sel = models.fit_select(roles["source_train"], roles["source_val"], family, params, LABELS)
        out += [(family, t["candidate_index"], t["params_json"], t["score"], t["candidate_index"] == sel.index) for t in sel.trials]
    return spark.createDataFrame(out, "family string, candidate_index int, params_json string, score double, is_best boolean")


@query("run_cells")
def run_cells(spark, d):
    cells = [models.Cell("d0", "d1", 0, "svm_rbf", a, budget=2) for a in ("none", "zscore", "mean_shift")]
    return models.run_cells(spark, labelled_vectors(spark, d), split_rows(spark, d), cells, LABELS)


@query("check_conditions")
def check_conditions(spark, d):
    cells = [models.Cell("d0", "d1", 0, f, a, budget=2, max_iter=50) for f in ("svm_rbf", "logreg") for a in ("none", "zscore")]
    return models.check_conditions(spark, labelled_vectors(spark, d), split_rows(spark, d), cells, LABELS)


@query("alpha_sweep")
def alpha_sweep(spark, d):
    roles = models._roles(labelled_vectors(spark, d), split_rows(spark, d), models.Cell("d0", "d1", 0))
    m = align.fit_align(roles["source_train"], roles["target_adapt"], "mean_shift")
    got = models.alpha_sweep(roles["source_train"], roles["target_test"], m, (0.0, 0.5, 1.0), LABELS)
    return spark.createDataFrame(got, "alpha double, macro_f1 double")


@query("shift_report")
def shift_report(spark, d):
    """Label shift, marginal and conditional discrepancy, and corrected scores of one pair."""
    roles = models._roles(labelled_vectors(spark, d), split_rows(spark, d), models.Cell("d0", "d1", 0))
    train, val, test = roles["source_train"], roles["source_val"], roles["target_test"]
    head = models.fit_logreg(train, LABELS, {"C": 1.0}, "label", train.count())
    on = lambda df: head.predict(df).select("item_id", F.col("label").alias("y_true"), "y_pred", "p").persist()
    pv, pt = on(val), on(test)
    prior = priors.prior_vector(train.withColumn("k", F.lit(0)), LABELS, ["k"])
    tprior = priors.prior_vector(test.withColumn("k", F.lit(0)), LABELS, ["k"])
    both = prior.select("k", F.col("p").alias("s")).join(tprior.select("k", F.col("p").alias("t")), "k")
    labels = both.select(F.col("s").alias("source_prior"), *priors.label_shift_columns(F.col("s"), F.col("t"), LABELS)).collect()[0]
    p0 = labels["source_prior"]
    rows = pv.withColumn("side", F.lit("s")).unionByName(pt.withColumn("side", F.lit("t")))
    w = shift.bbse(rows, LABELS, []).collect()[0]
    em = shift.em_prior(pt, p0)
    score = lambda df: float(models.score_of(df, LABELS, "y_true")["macro_f1"])
    fixed = lambda q: shift.prior_correct(pt, p0, q, LABELS).select("y_true", F.col("y_corrected").alias("y_pred"))
    sided = mmd.two_sides(train, test, ["label"])
    marginal = mmd.effect_size(sided.drop("label"), [], 5).collect()[0]
    cond = mmd.conditional_mmd(sided, "label", 10, (), 5).orderBy("label").collect()
    return spark.createDataFrame([(
        "d0", "d1", 0, labels["kl_nats"], labels["total_variation"], marginal["effect_size"],
        [(r["label"], r["n_source"], r["n_target"], r["raw_mmd"], r["effect_size"], r["undefined_reason"]) for r in cond],
        score(pt), score(fixed(w["target_prior"])) if w["target_prior"] else None, score(fixed(em)),
    )], "source string, target string, seed int, kl_nats double, total_variation double, marginal_effect double, "
        "conditional array<struct<class:string,n_source:bigint,n_target:bigint,raw_mmd:double,effect_size:double,undefined_reason:string>>, "
        "uncorrected double, bbse double, em double")
