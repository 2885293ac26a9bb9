"""Bootstraps, paired contrasts, corrections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import metrics, ranking as rk, resample as rs
from .registry import query, r9, sql_r9
from .runs import rounded
from .views import CLASSES, FLAGS, LINE_SQL, OK_SQL, PRED_SQL, line_predictions, ok_rows, predictions, sql_list, values_sql

K = len(FLAGS)
B = 40


def _draw(expr: str, n: str) -> str:
    return f"CAST('0x' || substr(sha256({expr}), 1, 8) AS BIGINT) % {n}"


# Contrast: each condition is also its own family member in the by-keyed queries.
BOOT_SQL = f"""{LINE_SQL},
conf AS (SELECT arm, seed, cond, grp, y_true, y_pred, count(*) AS n FROM line GROUP BY ALL),
g AS (SELECT seed, grp, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || '|' || grp), grp) - 1 AS idx,
  count(*) OVER (PARTITION BY seed) AS gn FROM (SELECT DISTINCT seed, grp FROM conf)),
reps AS (SELECT unnest(range({B})) AS rep),
sl AS (SELECT list_sort(list(DISTINCT seed)) AS seeds FROM g),
sd AS (SELECT rep, pos, seeds[{_draw("'seed|' || rep || '|' || pos", "len(seeds)")} + 1] AS seed FROM reps, sl, (SELECT unnest(range(3)) AS pos)),
dr AS (SELECT rep, seed, {_draw("'boot|' || rep || '|' || seed || '|' || idx", "gn")} AS idx FROM g, reps),
w AS (SELECT rep, seed, idx, count(*) AS w FROM dr GROUP BY ALL),
wc AS (SELECT rep, w.seed, arm, cond, y_true, y_pred, sum(w * n) AS n FROM w JOIN g ON g.seed = w.seed AND g.idx = w.idx
  JOIN conf ON conf.seed = g.seed AND conf.grp = g.grp GROUP BY ALL
  UNION ALL SELECT -1, seed, arm, cond, y_true, y_pred, sum(n) FROM conf GROUP BY ALL),
sup AS (SELECT rep, seed, arm, cond, y_true AS class, sum(n) AS s, coalesce(sum(n) FILTER (WHERE y_true = y_pred), 0) AS tp FROM wc GROUP BY ALL),
pre AS (SELECT rep, seed, arm, cond, y_pred AS class, sum(n) AS p FROM wc GROUP BY ALL),
f AS (SELECT rep, seed, arm, cond, avg(2.0::DOUBLE * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(p, 0))) AS f1
  FROM sup FULL JOIN pre USING (rep, seed, arm, cond, class) GROUP BY ALL),
sd2 AS (SELECT rep, seed FROM sd UNION ALL SELECT -1, seed FROM (SELECT DISTINCT seed FROM g))"""
POOLED_SQL = f"""{BOOT_SQL}, m AS (SELECT rep, seed, arm, avg(f1) AS m FROM f GROUP BY ALL),
r AS (SELECT rep, arm, avg(m) AS s FROM sd2 JOIN m USING (rep, seed) GROUP BY ALL),
d AS (SELECT a.rep, a.s - b.s AS d FROM r a JOIN r b ON a.rep = b.rep WHERE a.arm = 'a' AND b.arm = 'b')"""
BY_COND_SQL = f"""{BOOT_SQL}, r AS (SELECT rep, cond, arm, avg(f1) AS s FROM sd2 JOIN f USING (rep, seed) GROUP BY ALL),
d AS (SELECT a.rep, a.cond AS contrast, a.s - b.s AS d FROM r a JOIN r b ON a.rep = b.rep AND a.cond = b.cond WHERE a.arm = 'a' AND b.arm = 'b')"""


def packed(spark, d, by=()):
    return rs.pack_arms(line_predictions(spark, d), FLAGS, by, "arm", ("a", "b"))


def packed_by_contrast(spark, d):
    p = line_predictions(spark, d).withColumn("contrast", F.col("cond"))
    return rs.pack_arms(p, FLAGS, ["contrast"], "arm", ("a", "b"))


@query("cluster_bootstrap", f"""WITH {POOLED_SQL} SELECT CAST(3 AS BIGINT) AS n_seeds, {sql_r9('max(s) FILTER (WHERE rep = -1)')} AS mean,
{sql_r9('quantile_cont(s, 0.025) FILTER (WHERE rep >= 0)')} AS lo, {sql_r9('quantile_cont(s, 0.975) FILTER (WHERE rep >= 0)')} AS hi FROM r WHERE arm = 'a'""")
def cluster_bootstrap(spark, d):
    return rounded(rs.cluster_bootstrap(packed(spark, d), "a", K, reps=B), "mean", "lo", "hi")


def _paired_sql(by: str = "", alpha: float = 0.05) -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {sel}CAST(3 AS BIGINT) AS n_seeds, {sql_r9('max(d) FILTER (WHERE rep = -1)')} AS diff,
{sql_r9(f'quantile_cont(d, {alpha / 2}) FILTER (WHERE rep >= 0)')} AS lo, {sql_r9(f'quantile_cont(d, {1 - alpha / 2}) FILTER (WHERE rep >= 0)')} AS hi,
{sql_r9(f"greatest(2 * least(avg(CAST(d <= 0 AS INT)) FILTER (WHERE rep >= 0), avg(CAST(d >= 0 AS INT)) FILTER (WHERE rep >= 0)), 1.0 / {B})")} AS p,
least(count(*) FILTER (WHERE rep >= 0 AND d <= 0), count(*) FILTER (WHERE rep >= 0 AND d >= 0)) = 0 AS p_at_floor, count(*) FILTER (WHERE rep >= 0) AS n_boot FROM d{grp}"""


@query("paired_bootstrap", f"WITH {POOLED_SQL} {_paired_sql()}")
def paired_bootstrap(spark, d):
    return rounded(rs.paired_bootstrap(packed(spark, d), "a", "b", K, reps=B), "diff", "lo", "hi", "p")


@query("paired_bootstrap_blocks", f"WITH {POOLED_SQL} {_paired_sql()}")
def paired_bootstrap_blocks(spark, d):
    """The same contrast by block matrix products: same draws, same numbers."""
    return rounded(rs.paired_bootstrap(packed(spark, d), "a", "b", K, reps=B, method="blocks"), "diff", "lo", "hi", "p")


@query("family_bounds", f"""WITH {BY_COND_SQL}, u AS (SELECT contrast, max(d) FILTER (WHERE rep = -1) AS diff, quantile_cont(d, {1 - 0.05 / 8}) FILTER (WHERE rep >= 0) AS ub FROM d GROUP BY contrast)
SELECT contrast, {sql_r9('diff')} AS diff, {sql_r9('ub')} AS upper_bound, ub = max(ub) OVER () AS limiting FROM u""")
def family_bounds(spark, d):
    return rounded(rs.family_bounds(packed_by_contrast(spark, d), "a", "b", K, ["contrast"], 8, B), "diff", "upper_bound")


@query("primary_family", f"""WITH {BY_COND_SQL}, t AS ({_paired_sql('contrast')}),
h AS (SELECT *, row_number() OVER (ORDER BY p, contrast) AS rn, count(*) OVER () AS m FROM t)
SELECT contrast, n_seeds, diff, lo, hi, p, p_at_floor, n_boot, {sql_r9('least(1, max((m - rn + 1) * p) OVER (ORDER BY rn))')} AS holm,
least(1, max((m - rn + 1) * p) OVER (ORDER BY rn)) <= 0.05 AS reject FROM h""")
def primary_family(spark, d):
    """Declared contrasts end to end: paired bootstrap, then Holm over the family."""
    t = rounded(rs.paired_bootstrap(packed_by_contrast(spark, d), "a", "b", K, ["contrast"], B), "diff", "lo", "hi", "p")
    return rounded(rk.holm(t, "p", order=["contrast"]), "holm")


@query("arm_table", f"""WITH {BY_COND_SQL} SELECT cond AS contrast, CAST(3 AS BIGINT) AS n_seeds, {sql_r9('max(s) FILTER (WHERE rep = -1)')} AS mean,
{sql_r9('quantile_cont(s, 0.025) FILTER (WHERE rep >= 0)')} AS lo, {sql_r9('quantile_cont(s, 0.975) FILTER (WHERE rep >= 0)')} AS hi FROM r WHERE arm = 'b' GROUP BY cond""")
def arm_table(spark, d):
    """One bootstrap interval per axis value."""
    return rounded(rs.cluster_bootstrap(packed_by_contrast(spark, d), "b", K, ["contrast"], B), "mean", "lo", "hi")


PC_SQL = f"""{BOOT_SQL}, pd AS (SELECT rep, sd.seed, {_draw("'class|' || rep || '|' || pos || '|' || idx", "gn")} AS idx FROM sd JOIN g ON g.seed = sd.seed),
pc AS (SELECT rep, y_true, y_pred, sum(n) AS n FROM pd JOIN g ON g.seed = pd.seed AND g.idx = pd.idx JOIN conf ON conf.seed = g.seed AND conf.grp = g.grp AND arm = 'a' GROUP BY ALL
 UNION ALL SELECT -1, y_true, y_pred, sum(n) FROM conf WHERE arm = 'a' GROUP BY ALL),
cs AS (SELECT rep, c.class, sum(n) FILTER (WHERE y_true = c.class) AS s, sum(n) FILTER (WHERE y_pred = c.class) AS p,
  sum(n) FILTER (WHERE y_true = c.class AND y_pred = c.class) AS tp FROM pc, (SELECT unnest({sql_list(FLAGS)}) AS class) c GROUP BY ALL),
sc AS (SELECT rep, class, CAST(s AS BIGINT) AS support, CAST(p AS BIGINT) AS predicted, tp / p::DOUBLE AS precision, tp / s::DOUBLE AS recall, 2 * tp / (s + p)::DOUBLE AS f1 FROM cs)
SELECT class, max(support) FILTER (WHERE rep = -1) AS support, max(predicted) FILTER (WHERE rep = -1) AS predicted, """ + ", ".join(
    f"{sql_r9(f'max({c}) FILTER (WHERE rep = -1)')} AS {c}, {sql_r9(f'quantile_cont({c}, 0.025) FILTER (WHERE rep >= 0)')} AS {c}_lo, "
    f"{sql_r9(f'quantile_cont({c}, 0.975) FILTER (WHERE rep >= 0)')} AS {c}_hi" for c in ("precision", "recall", "f1")) + " FROM sc GROUP BY class"


@query("per_class_bootstrap", f"WITH {PC_SQL}")
def per_class_bootstrap(spark, d):
    out = rs.per_class_bootstrap(packed(spark, d), "a", FLAGS, B)
    return rounded(out, *[f"{c}{s}" for c in ("precision", "recall", "f1") for s in ("", "_lo", "_hi")])


ITEM_B = 20
KC = len(CLASSES)


@query("bootstrap_ci", f"""WITH {PRED_SQL}, cell AS (SELECT d.domain, t.c AS t, p.c AS p, t.i * {KC} + p.i AS cell,
   (SELECT count(*) FROM pred x WHERE x.domain = d.domain AND x.y_true = t.c AND x.y_pred = p.c) AS n
  FROM (SELECT DISTINCT domain FROM pred) d, (SELECT unnest({sql_list(CLASSES)}) AS c, unnest(range({KC})) AS i) t, (SELECT unnest({sql_list(CLASSES)}) AS c, unnest(range({KC})) AS i) p),
cum AS (SELECT *, sum(n) OVER (PARTITION BY domain ORDER BY cell) AS hi, sum(n) OVER (PARTITION BY domain ORDER BY cell) - n AS lo FROM cell),
tot AS (SELECT domain, count(*) AS nn FROM pred GROUP BY domain),
dr AS (SELECT pred.domain, rep, {_draw("'item|' || rep || '|' || item_id", "nn")} AS idx FROM pred JOIN tot ON tot.domain = pred.domain, (SELECT unnest(range({ITEM_B})) AS rep)),
rc AS (SELECT dr.domain, rep, t, p, count(*) AS n FROM dr JOIN cum ON cum.domain = dr.domain AND idx >= lo AND idx < hi GROUP BY ALL
  UNION ALL SELECT domain, -1, t, p, n FROM cell WHERE n > 0),
cs AS (SELECT domain, rep, c.class, coalesce(sum(n) FILTER (WHERE t = c.class), 0) + coalesce(sum(n) FILTER (WHERE p = c.class), 0) AS den,
  coalesce(sum(n) FILTER (WHERE t = c.class AND p = c.class), 0) AS tp FROM rc, (SELECT unnest({sql_list(CLASSES)}) AS class) c GROUP BY ALL),
sc AS (SELECT domain, rep, avg(CASE WHEN den > 0 THEN 2.0::DOUBLE * tp / den ELSE 0 END) AS s FROM cs GROUP BY ALL)
SELECT domain, {sql_r9('max(s) FILTER (WHERE rep = -1)')} AS point, {sql_r9('quantile_cont(s, 0.025) FILTER (WHERE rep >= 0)')} AS lo,
{sql_r9('quantile_cont(s, 0.975) FILTER (WHERE rep >= 0)')} AS hi FROM sc GROUP BY domain""")
def bootstrap_ci(spark, d):
    out = rs.item_bootstrap(predictions(spark, d), CLASSES, ["domain"], "item_id", ITEM_B)
    return rounded(out, "point", "lo", "hi")


def kappa(conf: np.ndarray) -> float:
    """Cohen's kappa, as an example of a user metric."""
    n = conf.sum()
    chance = (conf.sum(axis=0) * conf.sum(axis=1)).sum() / n**2
    return (np.trace(conf) / n - chance) / (1 - chance)


@query("metric_bootstrap")
def metric_bootstrap(spark, d):
    return rounded(rs.metric_bootstrap(predictions(spark, d), CLASSES, ["domain"], kappa, 1000), "point", "lo", "hi")


WIL_SQL = f"""{OK_SQL}, p AS (SELECT backbone, val AS a, test AS b FROM ok_rows),
d AS (SELECT backbone, a - b AS d, abs(a - b) AS m FROM p),
r AS (SELECT *, rank() OVER (PARTITION BY backbone ORDER BY m) + (count(*) OVER (PARTITION BY backbone, m) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0),
s AS (SELECT backbone, sum(r) FILTER (WHERE d > 0) AS wp, sum(r) FILTER (WHERE d < 0) AS wm, count(*) AS nz FROM r GROUP BY backbone)"""


def _wil_pairs(spark, d):
    return ok_rows(spark, d).select("backbone", F.col("val").alias("a"), F.col("test").alias("b"))


@query("wilcoxon_stat", f"""WITH {WIL_SQL}, q AS (SELECT backbone, count(*) AS n_pairs, quantile_cont(d, 0.5) AS md FROM d GROUP BY backbone)
SELECT q.backbone, n_pairs, {sql_r9('md')} AS median_difference, {sql_r9('wp')} AS w_plus, {sql_r9('wm')} AS w_minus, CAST(nz AS BIGINT) AS n_nonzero, {sql_r9('least(wp, wm)')} AS statistic
FROM q JOIN s ON s.backbone = q.backbone""")
def wilcoxon_stat(spark, d):
    out = rs.wilcoxon_statistic(_wil_pairs(spark, d), ["backbone"])
    return rounded(out, "median_difference", "w_plus", "w_minus", "statistic").select(
        "backbone", "n_pairs", "median_difference", "w_plus", "w_minus", "n_nonzero", "statistic")


@query("wilcoxon")
def wilcoxon(spark, d):
    return rounded(rs.wilcoxon(_wil_pairs(spark, d), ["backbone"]), "statistic", "p_value", "median_difference")


@query("holm", f"""WITH {OK_SQL}, t AS (SELECT alignment, classifier, (count(*) FILTER (WHERE test > val) % 97) / 970.0::DOUBLE AS p FROM ok_rows GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY alignment ORDER BY p, classifier) AS rn, count(*) OVER (PARTITION BY alignment) AS m FROM t),
x AS (SELECT *, least(1, max((m - rn + 1) * p) OVER (PARTITION BY alignment ORDER BY rn)) AS hp FROM h)
SELECT alignment, classifier, {sql_r9('p')} AS p, {sql_r9('hp')} AS holm, hp <= 0.05 AS reject FROM x""")
def holm(spark, d):
    t = ok_rows(spark, d).groupBy("alignment", "classifier").agg(
        ((F.count_if(F.col("test") > F.col("val")) % 97) / F.lit(970.0)).alias("p"))
    return rounded(rk.holm(t, "p", ["alignment"], ["classifier"]), "p", "holm")


@query("route_difference", f"""WITH {LINE_SQL} SELECT arm, count(DISTINCT (grp, y_true, y_pred)) AS n_cells, CAST(0 AS BIGINT) AS n_different FROM line GROUP BY arm""")
def route_difference(spark, d):
    """Counts from raw predictions against counts unpacked from the compact form: no cell may differ."""
    raw = metrics.confusion_by_group(line_predictions(spark, d), ["arm"], "grp")
    back = metrics.unpack_confusion(metrics.pack_confusion(raw, FLAGS, ["arm", "grp"]), FLAGS, ["arm", "grp"])
    diff = rs.difference(raw, back.select(*raw.columns)).groupBy("arm").agg(F.count(F.lit(1)).alias("x"))
    cells = raw.groupBy("arm").agg(F.count(F.lit(1)).alias("n_cells"))
    return cells.join(diff, "arm", "left").select("arm", "n_cells", F.coalesce("x", F.lit(0)).alias("n_different"))
