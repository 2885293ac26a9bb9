"""Queries over the run ledger: selection, matching, merging, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import grid, ledger as led, matching as mt, ranking as rk, summaries as sm
from .registry import query, r9, sql_r9, table
from .views import (
    FAMILIES, ITEM_SQL, LEDGER_SQL, OK_SQL, PRED_SQL, RUNGS, ledger, items, ok_rows, predictions, sql_list,
)

DIR = ["source", "target"]


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, r9(c))
    return df


# ---- identity --------------------------------------------------------------
_COORDS = ["alignment", "alignment_eps", "backbone", "classifier", "layer_index", "seed", "source", "target"]
_ID_SQL = """substr(sha256(to_json(struct_pack(alignment := alignment, alignment_eps := alignment_eps, backbone := backbone,
 classifier := classifier, layer_index := layer_index, seed := seed, source := source, target := target))), 1, 16)"""


@query("run_id", f"WITH {LEDGER_SQL} SELECT o_orderkey, {_ID_SQL} AS coordinate_id FROM ledger")
def run_id(spark, d):
    return ledger(spark, d).select("o_orderkey", H.run_id(_COORDS).alias("coordinate_id"))


@query("verify_ids", f"""WITH {LEDGER_SQL}, s AS (SELECT o_orderkey, {_ID_SQL} AS expected_run_id FROM ledger)
SELECT o_orderkey, 'bad' || substr(expected_run_id, 4) AS run_id, expected_run_id FROM s
WHERE o_orderkey % 19 = 0 AND substr(expected_run_id, 1, 3) <> 'bad'""")
def verify_ids(spark, d):
    fresh = H.run_id(_COORDS)
    stored = F.when(F.col("o_orderkey") % 19 == 0, F.concat(F.lit("bad"), F.substring(fresh, 4, 13))).otherwise(fresh)
    rows = ledger(spark, d).withColumn("run_id", stored)
    return led.verify_ids(rows, _COORDS).select("o_orderkey", "run_id", "expected_run_id")


@query("shard_of", f"""WITH {LEDGER_SQL} SELECT run_id, CAST('0x' || substr(run_id, 1, 8) AS BIGINT) % 4 AS shard FROM ledger""")
def shard_of(spark, d):
    return ledger(spark, d).select("run_id", H.shard_of(F.col("run_id"), 4).alias("shard"))


def _digest_sql(src: str, t: str, by: str, entry: str) -> str:
    limbs = " || '|' || ".join(
        f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)" for i in range(4)
    )
    return f"""{src}, e AS (SELECT {by} AS k, sha256({entry}) AS h FROM {t})
SELECT k AS {by}, count(*) AS n_rows, sha256(count(*) || '|' || {limbs}) AS digest FROM e GROUP BY k"""


@query("rows_key", "WITH " + _digest_sql(LEDGER_SQL, "ledger", "freeze_tag", "run_id || '|' || o_orderkey"))
def rows_key(spark, d):
    entry = F.concat_ws("|", "run_id", F.col("o_orderkey").cast("string"))
    return H.digest_rows(ledger(spark, d), ["freeze_tag"], entry)


@query("label_digest", "WITH " + _digest_sql(PRED_SQL, "pred", "domain", "item_id || '|' || y_pred"))
def label_digest(spark, d):
    """Exact digest of predicted labels per domain, the item id standing for the position."""
    return H.digest_rows(predictions(spark, d), ["domain"], F.concat_ws("|", F.col("item_id").cast("string"), "y_pred"))


@query("decision_digest", "WITH " + _digest_sql("x AS (SELECT 1)", "events", "event_type", "event_id || '|' || CAST(round_even(value / 0.25::DOUBLE, 0) AS BIGINT)"))
def decision_digest(spark, d):
    """Digest of values quantised to a tolerance of 0.25."""
    q = F.bround(F.col("value") / F.lit(0.25), 0).cast("long")
    entry = F.concat_ws("|", F.col("event_id").cast("string"), q.cast("string"))
    return H.digest_rows(table(spark, d, "events"), ["event_type"], entry)


@query("content_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# ---- validation and filters ------------------------------------------------
def _rules():
    return [
        led.Rule("null test", F.col("test").isNull()),
        led.Rule("status", ~F.col("status").isin("ok", "failed")),
        led.Rule("failed without error", (F.col("status") == "failed") & (F.col("o_orderkey") % 2 == 0)),
        led.Rule("version", F.col("schema_version") != 9),
    ]


@query("violations", f"""WITH {LEDGER_SQL} SELECT run_id, 'null test' AS rule FROM ledger WHERE test IS NULL
UNION ALL SELECT run_id, 'failed without error' FROM ledger WHERE status = 'failed' AND o_orderkey % 2 = 0
UNION ALL SELECT run_id, 'version' FROM ledger WHERE schema_version <> 9""")
def violations(spark, d):
    return led.violations(ledger(spark, d), _rules(), ["run_id"])


@query("select_tag", f"WITH {LEDGER_SQL} SELECT run_id, freeze_tag FROM ledger WHERE freeze_tag = 'freeze-v1'")
def select_tag(spark, d):
    return led.select_tag(ledger(spark, d), "freeze-v1").select("run_id", "freeze_tag")


@query("main_rows", f"""WITH {LEDGER_SQL} SELECT run_id FROM ledger
WHERE status = 'ok' AND NOT (o_orderkey % 7 = 0) AND classifier <> 'mlp'""")
def main_rows(spark, d):
    rows = ledger(spark, d).withColumn("source", F.when(F.col("o_orderkey") % 7 == 0, "synthetic").otherwise(F.col("source")))
    rows = rows.withColumn("classifier", F.when(F.col("classifier") == "mlp", "baseline_mlp").otherwise(F.col("classifier")))
    return led.main_rows(rows).select("run_id")


@query("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return led.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- enumeration and resume ------------------------------------------------
_EPS, _LAM = (0.001, 0.01, 0.1), (0.5, 1.0)
_ALPHAS = (0.25, 0.5, 0.75)
GRID_SQL = f"""base AS (SELECT r_name AS source, c_mktsegment AS segment FROM region, (SELECT DISTINCT c_mktsegment FROM customer)),
ax AS (SELECT * FROM base, (SELECT unnest([0, 1]) AS seed), (SELECT unnest({sql_list(RUNGS)}) AS alignment),
  (SELECT unnest(['last', 'layer', 'weighted']) AS layer_agg), (SELECT unnest({sql_list(FAMILIES)}) AS classifier)),
av(alignment, alignment_eps, ledoit_wolf, alignment_lambda) AS (VALUES ('none', NULL::DOUBLE, NULL::BOOLEAN, NULL::DOUBLE), ('zscore', NULL, NULL, NULL),
  ('mean_shift', NULL, NULL, NULL), ('coral', 0.001, false, NULL), ('coral', 0.01, false, NULL), ('coral', 0.1, false, NULL),
  ('coral', NULL, true, NULL), ('mkmmd_diag', NULL, NULL, 0.5), ('mkmmd_diag', NULL, NULL, 1.0)),
bv(blending, blend_alpha, n_groups) AS (VALUES ('none', NULL::DOUBLE, NULL::BIGINT), ('scalar', 0.25, NULL), ('scalar', 0.5, NULL), ('scalar', 0.75, NULL), ('gaa', NULL, 8)),
grid AS (SELECT ax.*, av.alignment_eps, av.ledoit_wolf, av.alignment_lambda, bv.* FROM ax JOIN av ON av.alignment = ax.alignment
  JOIN bv ON bv.blending = 'none' OR ax.alignment IN ('mean_shift', 'coral', 'mkmmd_diag')
  WHERE NOT (layer_agg = 'weighted' AND classifier LIKE 'svm%'))"""


def build_grid(spark, d):
    """Region x segment directions times the experiment axes."""
    names = table(spark, d, "region").select(F.col("r_name").alias("r"), F.lit(None).cast("string").alias("s")).union(
        table(spark, d, "customer").select(F.lit(None).cast("string"), "c_mktsegment"))
    # Both axes are distinct value sets of one aggregate; exploding them is the product.
    base = names.agg(F.collect_set("r").alias("r"), F.collect_set("s").alias("s")).select(
        F.explode("r").alias("source"), "s"
    ).select("source", F.explode("s").alias("segment"))
    blends = {r: grid.blend_variants(r, ("none", "scalar", "gaa"), _ALPHAS, 8) for r in RUNGS}
    return grid.enumerate_grid(
        base,
        {"seed": ((0, 1), "int"), "alignment": (RUNGS, "string"), "layer_agg": (("last", "layer", "weighted"), "string"),
         "classifier": (FAMILIES, "string")},
        [("alignment", grid.alignment_variants(_EPS, _LAM), {"alignment_eps": "double", "ledoit_wolf": "boolean", "alignment_lambda": "double"}),
         ("alignment", blends, {"blending": "string", "blend_alpha": "double", "n_groups": "bigint"})],
        (F.col("layer_agg") == "weighted") & F.col("classifier").startswith("svm"),
    )


_GRID_COLS = "source, segment, seed, alignment, layer_agg, classifier, alignment_eps, ledoit_wolf, alignment_lambda, blending, blend_alpha, n_groups"


@query("enumerate_grid", f"WITH {GRID_SQL} SELECT {_GRID_COLS} FROM grid")
def enumerate_grid(spark, d):
    return build_grid(spark, d).select(*_GRID_COLS.split(", "))


_PLAN_ID = "sha256(concat_ws('|', source, segment, CAST(seed AS VARCHAR), alignment, layer_agg, classifier, coalesce(CAST(alignment_eps AS VARCHAR), 'lw'), blending, coalesce(CAST(blend_alpha AS VARCHAR), '-'), coalesce(CAST(alignment_lambda AS VARCHAR), '-')))"


def _with_plan_id(df):
    t = lambda c, e: F.coalesce(F.col(c).cast("string"), F.lit(e))
    return df.withColumn("run_id", F.sha2(F.concat_ws(
        "|", "source", "segment", F.col("seed").cast("string"), "alignment", "layer_agg", "classifier",
        t("alignment_eps", "lw"), "blending", t("blend_alpha", "-"), t("alignment_lambda", "-")), 256))


@query("todo", f"""WITH {GRID_SQL}, p AS (SELECT *, {_PLAN_ID} AS run_id FROM grid)
SELECT run_id, source, segment FROM p WHERE '0' <= substr(run_id, 1, 1) AND substr(run_id, 1, 1) >= '6'""")
def todo(spark, d):
    """The plan minus two ledgers that hold the ids starting 0-2 and 2-5."""
    plan = _with_plan_id(build_grid(spark, d)).select("run_id", "source", "segment")
    head = F.substring("run_id", 1, 1)
    return led.todo(plan, [plan.where(head <= "2"), plan.where((head >= "2") & (head <= "5"))]).select("run_id", "source", "segment")


@query("plan_shard", f"""WITH {GRID_SQL}, p AS (SELECT {_PLAN_ID} AS run_id FROM grid)
SELECT run_id FROM p WHERE CAST('0x' || substr(run_id, 1, 8) AS BIGINT) % 4 = 1""")
def plan_shard(spark, d):
    return led.shard(_with_plan_id(build_grid(spark, d)), 1, 4).select("run_id")


@query("check_complete", f"""WITH {LEDGER_SQL}, plan AS (SELECT s AS seed, l AS layer_index, a AS alignment
  FROM (SELECT unnest(range(5)) AS s), (SELECT unnest(range(14)) AS l), (SELECT unnest({sql_list(RUNGS)}) AS a)),
h AS (SELECT seed, layer_index, alignment, count(*) AS n, count(*) FILTER (WHERE status <> 'ok') AS nb FROM ledger GROUP BY ALL)
SELECT p.seed, p.layer_index, p.alignment, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'failed' END AS problem
FROM plan p LEFT JOIN h ON h.seed = p.seed AND h.layer_index = p.layer_index AND h.alignment = p.alignment WHERE n IS NULL OR n > 1 OR nb > 0""")
def check_complete(spark, d):
    plan = grid.enumerate_grid(spark.range(1).drop("id"), {
        "seed": (range(5), "bigint"), "layer_index": (range(14), "bigint"), "alignment": (RUNGS, "string")})
    return grid.check_complete(plan, ledger(spark, d), ["seed", "layer_index", "alignment"])


@query("complete_groups", f"""WITH {OK_SQL} SELECT alignment, seed, count(*) AS cells, count(*) >= 400 AS included FROM ok_rows GROUP BY ALL""")
def complete_groups(spark, d):
    return sm.complete_groups(ok_rows(spark, d), ["alignment", "seed"], 400)


# ---- selection -------------------------------------------------------------
_COND = ["source", "target", "seed", "backbone", "classifier"]
_CONDS = ", ".join(_COND)


@query("best_by", f"""WITH {OK_SQL} SELECT {_CONDS}, run_id, val, test FROM (SELECT *, row_number() OVER
(PARTITION BY {_CONDS} ORDER BY val DESC, run_id) AS rn FROM ok_rows) WHERE rn = 1""")
def best_by(spark, d):
    return sm.best_runs(ok_rows(spark, d), _COND).select(*_COND, "run_id", "val", "test")


VO_SQL = f"""{OK_SQL}, vo AS (SELECT source, target, seed, arg_min(test, (-val, run_id)) AS validated, max(test) AS oracle,
 max(test) - arg_min(test, (-val, run_id)) AS gap FROM ok_rows GROUP BY ALL)"""


@query("validated_oracle", f"WITH {VO_SQL} SELECT source, target, seed, validated, oracle, {sql_r9('gap')} AS gap FROM vo")
def validated_oracle(spark, d):
    return rounded(sm.validated_oracle(ok_rows(spark, d), DIR, ["run_id"]), "gap")


def interval_sql(src: str, by: str, v: str) -> str:
    crit = "CASE count({v}) WHEN 2 THEN 12.706 WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 WHEN 5 THEN 2.776 ELSE 1.96 END".format(v=v)
    half = f"CASE WHEN count({v}) > 1 THEN ({crit})::DOUBLE * stddev_samp({v}) / sqrt(count({v})) END"
    return f"""SELECT {by}, count({v}) AS n, {sql_r9(f'avg({v})')} AS mean, {sql_r9(f'avg({v}) - {half}')} AS lo,
{sql_r9(f'avg({v}) + {half}')} AS hi FROM {src} GROUP BY {by}"""


@query("validated_oracle_intervals", f"""WITH {VO_SQL}, l AS (SELECT source, target, 'validated' AS quantity, validated AS v FROM vo
UNION ALL SELECT source, target, 'oracle', oracle FROM vo UNION ALL SELECT source, target, 'gap', gap FROM vo)
{interval_sql('l', 'source, target, quantity', 'v')}""")
def validated_oracle_intervals(spark, d):
    vo = sm.validated_oracle(ok_rows(spark, d), DIR, ["run_id"])
    return rounded(sm.intervals(vo, DIR, ["validated", "oracle", "gap"]), "mean", "lo", "hi")


@query("seed_interval", f"WITH {LEDGER_SQL} {interval_sql('ledger', 'alignment', 'val')}")
def seed_interval(spark, d):
    return rounded(sm.seed_interval(ledger(spark, d), ["alignment"], "val"), "mean", "lo", "hi")


@query("per_seed", f"WITH {OK_SQL}, s AS (SELECT alignment, seed, avg(val) AS v FROM ok_rows GROUP BY ALL) {interval_sql('s', 'alignment', 'v')}")
def per_seed(spark, d):
    return rounded(sm.per_seed(ok_rows(spark, d), ["alignment"], "val"), "mean", "lo", "hi")


@query("axis_summary", f"""WITH {OK_SQL} SELECT alignment, count(*) AS n, {sql_r9('avg(val)')} AS mean, min(val) AS min, max(val) AS max
FROM ok_rows GROUP BY alignment""")
def axis_summary(spark, d):
    return rounded(sm.axis_summary(ok_rows(spark, d), "alignment", "val"), "mean")


@query("solver_summary", f"""WITH {OK_SQL} SELECT classifier, count(*) AS n, min(solver_n_iter) AS min, {sql_r9('quantile_cont(solver_n_iter, 0.5)')} AS median,
max(solver_n_iter) AS max, count(*) FILTER (WHERE solver_n_iter >= 1000) AS n_at_cap,
CAST(sum(CAST(json_extract(hyperparams_json, '$.n_failed') AS BIGINT)) AS BIGINT) AS n_failed FROM ok_rows WHERE solver_n_iter IS NOT NULL GROUP BY classifier""")
def solver_summary(spark, d):
    return rounded(sm.solver_summary(ok_rows(spark, d), "classifier", 1000), "median")


@query("rate", f"""WITH {OK_SQL} SELECT alignment, alignment_lambda, count(*) AS n, count(*) FILTER (WHERE fallback) AS n_true,
{sql_r9('count(*) FILTER (WHERE fallback)::DOUBLE / count(*)')} AS rate FROM ok_rows GROUP BY alignment, alignment_lambda""")
def rate(spark, d):
    return rounded(sm.rate(ok_rows(spark, d), "fallback", ["alignment", "alignment_lambda"]), "rate")


@query("cost_shares", f"""WITH {OK_SQL}, g AS (SELECT classifier, count(*) AS n, sum(wall_seconds) AS s FROM ok_rows GROUP BY classifier)
SELECT classifier, n, {sql_r9('s / 3600')} AS hours, {sql_r9('s / sum(s) OVER ()')} AS share FROM g""")
def cost_shares(spark, d):
    return rounded(sm.cost_shares(ok_rows(spark, d), "classifier"), "hours", "share")


@query("project_cost", f"""WITH {LEDGER_SQL}, fine AS (SELECT classifier, layer_index, quantile_cont(wall_seconds, 0.5) AS m FROM ledger WHERE layer_index < 9 GROUP BY ALL),
coarse AS (SELECT classifier, quantile_cont(wall_seconds, 0.5) AS m FROM ledger WHERE layer_index < 9 GROUP BY ALL),
r(classifier, ratio) AS (VALUES ('mlp', 1.5::DOUBLE), ('logreg', 0.5::DOUBLE)),
runs AS (SELECT classifier, layer_index, count(*) AS runs FROM ledger GROUP BY ALL)
SELECT runs.classifier, runs.layer_index, runs, {sql_r9('coalesce(fine.m, coarse.m)')} AS median_seconds, fine.m IS NULL AS used_fallback,
{sql_r9('runs * (coalesce(fine.m, coarse.m) * coalesce(ratio, 1.0::DOUBLE)) / 3600::DOUBLE')} AS hours FROM runs
LEFT JOIN fine ON fine.classifier = runs.classifier AND fine.layer_index = runs.layer_index
LEFT JOIN coarse ON coarse.classifier = runs.classifier LEFT JOIN r ON r.classifier = runs.classifier""")
def project_cost(spark, d):
    rows = ledger(spark, d)
    ratios = spark.createDataFrame([("mlp", 1.5), ("logreg", 0.5)], "classifier string, ratio double")
    out = sm.project_cost(rows, rows.where("layer_index < 9"), ratios, ["classifier", "layer_index"], ["classifier"])
    return rounded(out, "median_seconds", "hours")


@query("integrity", f"""WITH {LEDGER_SQL} SELECT count(*) AS n_rows, count(DISTINCT run_id) AS n_ids, count(*) FILTER (WHERE status = 'ok') AS n_ok,
count(*) FILTER (WHERE status <> 'ok') AS n_failed, (SELECT string_agg(v, ',' ORDER BY len(v), v) FROM (SELECT DISTINCT CAST(schema_version AS VARCHAR) AS v FROM ledger)) AS versions FROM ledger""")
def integrity(spark, d):
    return sm.integrity(ledger(spark, d))


@query("with_total", f"""WITH {OK_SQL} SELECT classifier, count(*) AS n, {sql_r9('avg(test)')} AS mean, grouping(classifier) = 1 AS is_total
FROM ok_rows GROUP BY ROLLUP (classifier)""")
def with_total(spark, d):
    return sm.with_total(ok_rows(spark, d), "classifier", [F.count(F.lit(1)).alias("n"), r9(F.avg("test")).alias("mean")])


@query("reduction_ratio", f"""WITH {OK_SQL}, p AS (SELECT source, alignment, seed, avg(mmd_own) AS a, avg(mmd_ref) AS b FROM ok_rows GROUP BY ALL),
m AS (SELECT source, alignment, avg(a) AS num, avg(b) AS den, avg(a) / avg(b) AS ratio FROM p GROUP BY ALL)
SELECT source, alignment, {sql_r9('num')} AS num, {sql_r9('den')} AS den, {sql_r9('ratio')} AS ratio,
{sql_r9("ratio / max(ratio) FILTER (WHERE alignment = 'none') OVER (PARTITION BY source)")} AS relative FROM m""")
def reduction_ratio(spark, d):
    out = sm.reduction_ratio(ok_rows(spark, d), ["source"], "alignment", "none", "mmd_own", "mmd_ref")
    return rounded(out, "num", "den", "ratio", "relative")


@query("gain", f"""WITH {OK_SQL}, g AS (SELECT source, backbone, avg(test) FILTER (WHERE alignment = 'none') AS u, avg(test) FILTER (WHERE alignment <> 'none') AS a FROM ok_rows GROUP BY ALL)
SELECT source, backbone, {sql_r9('u')} AS unaligned, {sql_r9('a')} AS aligned, {sql_r9('a - u')} AS gain FROM g""")
def gain(spark, d):
    return rounded(sm.gain(ok_rows(spark, d), ["source", "backbone"]), "unaligned", "aligned", "gain")


@query("gate", f"WITH {LEDGER_SQL} SELECT run_id, test FROM ledger WHERE status = 'ok' AND test <= 0.2")
def gate(spark, d):
    return sm.gate(ledger(spark, d).withColumn("chance", F.lit(0.2))).select("run_id", "test")


# ---- windows and ranks -----------------------------------------------------
@query("tolerant_rank", f"""WITH {OK_SQL}, m AS (SELECT source, backbone, alignment, avg(mmd_own) AS v FROM ok_rows GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lag(v) OVER w AS p FROM m WINDOW w AS (PARTITION BY source, backbone ORDER BY v, alignment)),
s AS (SELECT *, CASE WHEN p IS NULL OR abs(v - p) > greatest(1e-9, abs(p) * 0.01) THEN rn END AS st FROM r)
SELECT source, backbone, alignment, {sql_r9('v')} AS v, max(st) OVER (PARTITION BY source, backbone ORDER BY rn) AS rank FROM s""")
def tolerant_rank(spark, d):
    m = ok_rows(spark, d).groupBy("source", "backbone", "alignment").agg(F.avg("mmd_own").alias("v"))
    out = rk.tolerant_rank(m, ["source", "backbone"], "v", ["alignment"])
    return rounded(out, "v").withColumn("rank", F.col("rank").cast("long"))


CELL_SQL = f"""{OK_SQL}, cell AS (SELECT source, alignment, seed, layer_index, avg(mmd_own) AS own, avg(mmd_ref) AS ref, avg(val) AS val, avg(test) AS test
  FROM ok_rows GROUP BY ALL)"""


def _rho_sql(x: str) -> str:
    return f"""SELECT source, alignment, seed, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho FROM (
 SELECT *, row_number() OVER (PARTITION BY source, alignment, seed ORDER BY {x}, layer_index)::DOUBLE AS rx,
 row_number() OVER (PARTITION BY source, alignment, seed ORDER BY test, layer_index)::DOUBLE AS ry FROM cell) GROUP BY source, alignment, seed"""


def _cells(spark, d):
    return ok_rows(spark, d).groupBy("source", "alignment", "seed", "layer_index").agg(
        F.avg("mmd_own").alias("own"), F.avg("mmd_ref").alias("ref"), F.avg("val").alias("val"), F.avg("test").alias("test"))


_BY3 = ["source", "alignment", "seed"]


@query("spearman", f"WITH {CELL_SQL}, q AS ({_rho_sql('own')}) SELECT source, alignment, seed, n, {sql_r9('rho')} AS rho FROM q")
def spearman(spark, d):
    return rounded(rk.spearman(_cells(spark, d), _BY3, "own", "test", ["layer_index"]), "rho")


@query("sign_disagree", f"""WITH {CELL_SQL}, qa AS ({_rho_sql('own')}), qb AS ({_rho_sql('ref')}),
a AS ({interval_sql('qa', 'source, alignment', 'rho')}), b AS ({interval_sql('qb', 'source, alignment', 'rho')})
SELECT a.source, a.alignment, a.mean AS a_mean, b.mean AS b_mean, a.lo * a.hi > 0 AND b.lo * b.hi > 0 AND a.mean * b.mean < 0 AS disagree
FROM a JOIN b ON a.source = b.source AND a.alignment = b.alignment""")
def sign_disagree(spark, d):
    c = _cells(spark, d)
    iv = lambda x: sm.seed_interval(rk.spearman(c, _BY3, x, "test", ["layer_index"]), ["source", "alignment"], "rho")
    return rounded(sm.sign_disagree(iv("own"), iv("ref"), ["source", "alignment"]), "a_mean", "b_mean")


@query("depth_gap", f"""WITH {CELL_SQL}, g AS (SELECT source, alignment, seed, count(*) AS n_cells, arg_min(layer_index, (-val, layer_index)) AS at_val,
 arg_min(layer_index, (-test, layer_index)) AS at_test, max(test) - arg_min(test, (-val, layer_index)) AS cost, max(test) - avg(test) AS rc FROM cell GROUP BY ALL)
SELECT source, alignment, seed, n_cells, at_val, at_test, at_test - at_val AS gap, {sql_r9('cost')} AS cost, {sql_r9('rc')} AS random_cost,
{sql_r9('cost - rc')} AS paired_difference FROM g WHERE n_cells >= 3""")
def depth_gap(spark, d):
    return rounded(sm.depth_gap(ok_rows(spark, d), _BY3, "layer_index"), "cost", "random_cost", "paired_difference")


@query("axis_argmax", f"""WITH {OK_SQL}, m AS (SELECT source, alignment, alignment_eps AS e, avg(val) AS m FROM ok_rows WHERE alignment_eps IS NOT NULL GROUP BY ALL),
g AS (SELECT source, alignment, arg_min(e, (-m, e)) AS best, min(e) AS lowest, max(e) AS highest, max(m) - min(m) AS spread FROM m GROUP BY ALL)
SELECT source, alignment, best, lowest, highest, {sql_r9('spread')} AS spread, best = lowest OR best = highest AS at_edge FROM g""")
def axis_argmax(spark, d):
    return rounded(sm.axis_argmax(ok_rows(spark, d), ["source", "alignment"], "alignment_eps", "val"), "spread")


_CC = "source, seed, backbone, classifier, layer_index"
CONTRAST_SQL = f"""{OK_SQL}, m AS (SELECT {_CC}, alignment, avg(test) AS t FROM ok_rows GROUP BY ALL),
pos AS (SELECT unnest({sql_list(RUNGS)}) AS r, unnest(range({len(RUNGS)})) AS i),
c AS (SELECT x.alignment AS a, y.alignment AS b, count(*) AS n_conditions, avg(y.t - x.t) AS difference FROM m x
 JOIN m y ON {' AND '.join(f'x.{c} = y.{c}' for c in _CC.split(', '))} JOIN pos p ON p.r = x.alignment JOIN pos q ON q.r = y.alignment WHERE p.i < q.i GROUP BY x.alignment, y.alignment)"""


def _contrasts(spark, d):
    return sm.contrasts(ok_rows(spark, d), _CC.split(", "), "alignment", RUNGS, "test")


@query("contrasts", f"WITH {CONTRAST_SQL} SELECT a, b, n_conditions, {sql_r9('difference')} AS difference FROM c")
def contrasts(spark, d):
    return rounded(_contrasts(spark, d), "difference")


@query("widest_contrast", f"""WITH {CONTRAST_SQL} SELECT a, b, n_conditions, {sql_r9('difference')} AS difference,
{sql_r9('100 * abs(difference) / 0.131')} AS percent_of_step FROM c ORDER BY abs(difference) DESC, a, b LIMIT 1""")
def widest_contrast(spark, d):
    return rounded(sm.widest_contrast(_contrasts(spark, d), 0.131), "difference", "percent_of_step")


@query("class_order", f"""WITH {OK_SQL}, m AS (SELECT source, alignment AS class, avg(test) AS f FROM ok_rows GROUP BY ALL),
w AS (SELECT source, class, f, row_number() OVER (PARTITION BY source ORDER BY f, class) AS position, f < avg(f) OVER (PARTITION BY source) AS below FROM m)
SELECT source, class, {sql_r9('f')} AS f1, position, below, bool_and(below) OVER (PARTITION BY class) AS below_in_all FROM w""")
def class_order(spark, d):
    m = ok_rows(spark, d).groupBy("source", F.col("alignment").alias("class")).agg(F.avg("test").alias("f1"))
    return rounded(sm.class_order(m, ["source"]), "f1").withColumn("position", F.col("position").cast("long"))


# ---- matching --------------------------------------------------------------
@query("paired_arms", f"""WITH {OK_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY {_CONDS}, alignment ORDER BY val DESC, run_id) AS rn
 FROM ok_rows WHERE alignment IN ('none', 'coral'))
SELECT {', '.join('x.' + c for c in _COND)}, x.run_id AS a_run_id, x.val AS a_val, x.test AS a_test, y.run_id AS b_run_id, y.val AS b_val, y.test AS b_test
FROM b x JOIN b y ON {' AND '.join(f'x.{c} = y.{c}' for c in _COND)} WHERE x.rn = 1 AND y.rn = 1 AND x.alignment = 'none' AND y.alignment = 'coral'""")
def paired_arms(spark, d):
    return mt.paired_arms(ok_rows(spark, d), "alignment", "none", "coral", _COND, "val", ["run_id"], ["run_id", "val", "test"])


_MK = ["source", "seed", "backbone", "classifier", "layer_index", "alignment_eps", "freeze_tag"]
_MKS = ", ".join(_MK)
MATCH_SQL = f"""{LEDGER_SQL}, l AS (SELECT * FROM ledger WHERE alignment IN ('none', 'mean_shift')),
g AS (SELECT {_MKS}, count(*) FILTER (WHERE alignment = 'none') AS n_a, count(*) FILTER (WHERE alignment = 'mean_shift') AS n_b,
  count(*) FILTER (WHERE status <> 'ok') AS nf, min(run_id) FILTER (WHERE alignment = 'none') AS a, min(run_id) FILTER (WHERE alignment = 'mean_shift') AS b
  FROM l GROUP BY ALL),
mm AS (SELECT g.*, CASE WHEN nf > 0 THEN 'incomplete' WHEN n_a = 0 OR n_b = 0 THEN 'missing arm' WHEN n_a > 1 OR n_b > 1 THEN 'duplicate arm' END AS problem FROM g)"""
_MCOLS = ["run_id", "val", "test", "hyperparams_json"]


def _matched(spark, d):
    return mt.match_arms(ledger(spark, d), _MK, "alignment", "none", "mean_shift", _MCOLS)


@query("match_arms", f"WITH {MATCH_SQL} SELECT {_MKS}, n_a, n_b, problem, a AS a_run_id, b AS b_run_id FROM mm")
def match_arms(spark, d):
    return _matched(spark, d).select(*_MK, "n_a", "n_b", "problem", "a_run_id", "b_run_id")


@query("audit_summary", f"""WITH {MATCH_SQL}, p AS (SELECT mm.source, x.val = y.val AS ve, json_extract(x.hyperparams_json, '$.selected') IS NOT DISTINCT FROM json_extract(y.hyperparams_json, '$.selected') AS pe,
  y.test - x.test AS df FROM mm JOIN ledger x ON x.run_id = mm.a JOIN ledger y ON y.run_id = mm.b WHERE problem IS NULL)
SELECT source, count(*) AS n_pairs, count(*) FILTER (WHERE ve) AS n_score_equal, count(*) FILTER (WHERE pe) AS n_params_equal, count(*) FILTER (WHERE ve AND pe) AS n_both_equal,
count(*) FILTER (WHERE df > 0) AS n_positive, {sql_r9('avg(df)')} AS mean_difference FROM p GROUP BY source""")
def audit_summary(spark, d):
    return rounded(mt.audit_summary(mt.equality_flags(_matched(spark, d)), ["source"]), "mean_difference")


@query("translation_audit", f"""WITH {MATCH_SQL} SELECT coalesce(problem, 'clean') AS outcome, count(*) AS n_cells, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b
FROM mm GROUP BY ALL""")
def translation_audit(spark, d):
    m = _matched(spark, d)
    return m.groupBy(F.coalesce("problem", F.lit("clean")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


# Orders are the runs and their line items the candidates; the supplier pair sets the arm.
TRIAL_SQL = """runs AS (SELECT 'r' || o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE 'mean_shift' END AS arm, o_orderkey // 2 AS cell FROM orders),
trials AS (SELECT 'r' || l_orderkey AS run_id, l_linenumber AS candidate_index, CAST(l_linenumber % 4 AS VARCHAR) AS params, l_returnflag AS pd, l_linestatus AS dd, round(l_quantity / 25, 0) AS score FROM lineitem),
t AS (SELECT * FROM trials JOIN runs USING (run_id)),
g AS (SELECT cell, candidate_index, count(*) FILTER (WHERE arm = 'none') AS na, count(*) FILTER (WHERE arm <> 'none') AS nb,
 max(params) FILTER (WHERE arm = 'none') IS NOT DISTINCT FROM max(params) FILTER (WHERE arm <> 'none') AS ep,
 max(pd) FILTER (WHERE arm = 'none') IS NOT DISTINCT FROM max(pd) FILTER (WHERE arm <> 'none') AS epd,
 max(dd) FILTER (WHERE arm = 'none') IS NOT DISTINCT FROM max(dd) FILTER (WHERE arm <> 'none') AS edd,
 max(score) FILTER (WHERE arm = 'none') IS NOT DISTINCT FROM max(score) FILTER (WHERE arm <> 'none') AS es FROM t GROUP BY ALL)
SELECT cell, count(*) AS candidates, count(*) FILTER (WHERE NOT (na = 1 AND nb = 1) OR NOT ep) AS n_unmatched,
count(*) FILTER (WHERE na = 1 AND nb = 1 AND epd) AS n_prediction_equal, count(*) FILTER (WHERE na = 1 AND nb = 1 AND es) AS n_score_equal,
count(*) FILTER (WHERE na = 1 AND nb = 1 AND edd) AS n_decision_equal FROM g GROUP BY cell"""


@query("match_trials", f"WITH {TRIAL_SQL}")
def match_trials(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
                    F.when(F.col("o_orderkey") % 2 == 0, "none").otherwise("mean_shift").alias("arm"),
                    F.floor(F.col("o_orderkey") / 2).cast("long").alias("cell"))
    li = table(spark, d, "lineitem")
    trials = li.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"),
                       F.col("l_linenumber").alias("candidate_index"), (F.col("l_linenumber") % 4).cast("string").alias("params_json"),
                       F.col("l_returnflag").alias("prediction_digest"), F.col("l_linestatus").alias("decision_digest"),
                       F.round(F.col("l_quantity") / 25, 0).alias("score"))
    return mt.match_trials(runs, trials, ["cell"], "arm", "none", "mean_shift")


@query("matched_pool", f"""WITH {LEDGER_SQL}, p AS (SELECT * FROM ledger WHERE alignment = 'coral' AND o_orderkey % 4 = 1)
SELECT run_id FROM ledger WHERE alignment = 'none' AND source IN (SELECT source FROM p) AND seed IN (SELECT seed FROM p) AND backbone IN (SELECT backbone FROM p)""")
def matched_pool(spark, d):
    rows = ledger(spark, d)
    probe = rows.where((F.col("alignment") == "coral") & (F.col("o_orderkey") % 4 == 1))
    return mt.matched_pool(rows.where("alignment = 'none'"), probe, ["source", "seed", "backbone"]).select("run_id")


@query("vs_baseline", f"""WITH {OK_SQL}, r AS (SELECT source, seed, layer_index, alignment, avg(test) AS v FROM ok_rows WHERE NOT (alignment = 'none' AND seed = 4) AND seed < 5 GROUP BY ALL),
b AS (SELECT * FROM r WHERE alignment = 'none'), o AS (SELECT * FROM r WHERE alignment <> 'none')
SELECT coalesce(o.source, b.source) AS source, coalesce(o.seed, b.seed) AS seed, coalesce(o.layer_index, b.layer_index) AS layer_index, o.alignment, {sql_r9('o.v - b.v')} AS difference,
CASE WHEN o.v IS NULL THEN 'baseline only' WHEN b.v IS NULL THEN 'variant only' END AS problem
FROM o FULL JOIN b ON o.source = b.source AND o.seed = b.seed AND o.layer_index = b.layer_index""")
def vs_baseline(spark, d):
    rows = ok_rows(spark, d).where("NOT (alignment = 'none' AND seed = 4)")
    return rounded(mt.vs_baseline(rows, "alignment", "none", ["source", "seed", "layer_index"], "test"), "difference")


@query("attach", """SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def attach(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return mt.attach(mt.attach(o, c, ["c_custkey"]), n, ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("missing_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, d):
    return mt.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


ANN_SQL = """notes AS (SELECT doc_id, CAST(quality AS VARCHAR) AS raw FROM labels UNION ALL SELECT doc_id, CAST(toxic AS VARCHAR) FROM labels WHERE doc_id % 10 = 0
 UNION ALL SELECT doc_id, CAST(quality AS VARCHAR) FROM labels WHERE doc_id % 10 = 1),
f AS (SELECT doc_id, min(raw) AS raw, max(raw) AS other, count(*) AS n FROM notes GROUP BY doc_id)"""


def _annotations(spark, d):
    lab = table(spark, d, "labels")
    q, t = F.col("quality").cast("string").alias("raw"), F.col("toxic").cast("string").alias("raw")
    notes = lab.select("doc_id", q).union(lab.where("doc_id % 10 = 0").select("doc_id", t)).union(
        lab.where("doc_id % 10 = 1").select("doc_id", q))
    return mt.join_annotations(table(spark, d, "documents").select("doc_id", "lang"), notes, "doc_id")


@query("join_annotations", f"WITH {ANN_SQL} SELECT d.doc_id, lang, raw FROM documents d JOIN f ON f.doc_id = d.doc_id WHERE n = 1")
def join_annotations(spark, d):
    return _annotations(spark, d)[0].select("doc_id", "lang", "raw")


@query("annotation_problems", f"""WITH {ANN_SQL} SELECT d.doc_id, CASE WHEN n IS NULL THEN 'no annotation' WHEN raw <> other THEN 'contradictory' ELSE 'repeated' END AS problem
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id WHERE n IS NULL OR n > 1""")
def annotation_problems(spark, d):
    return _annotations(spark, d)[1]


# ---- shards ----------------------------------------------------------------
SHARD_SQL = """shards AS (
  SELECT *, 'shard0' AS file, p_partkey % 7 AS wall_seconds FROM part
  UNION ALL SELECT *, 'shard1', 100 + p_partkey % 5 FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, p_name, p_brand, p_type, p_size + 1, p_retailprice, 'shard2', 200 FROM part WHERE p_partkey % 50 = 3),
conf AS (SELECT p_partkey FROM shards GROUP BY p_partkey HAVING count(DISTINCT (p_name, p_brand, p_type, p_size, p_retailprice)) > 1)"""
_VOL = ("file", "wall_seconds")


def shards(spark, d):
    """Shard 0 holds every row, shard 1 repeats a quarter, shard 2 contradicts some."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    s0 = p.withColumn("file", F.lit("shard0")).withColumn("wall_seconds", k % 7)
    s1 = p.where(k % 4 == 0).withColumn("file", F.lit("shard1")).withColumn("wall_seconds", k % 5 + 100)
    s2 = p.where(k % 50 == 3).withColumn("p_size", F.col("p_size") + 1).withColumn("file", F.lit("shard2")).withColumn("wall_seconds", F.lit(200).cast("long"))
    return s0.unionByName(s1).unionByName(s2)


@query("merge_shards", f"""WITH {SHARD_SQL} SELECT p_partkey, arg_min(p_name, file) AS p_name, arg_min(p_size, file)::BIGINT AS p_size, min(file) AS file, arg_min(wall_seconds, file)::BIGINT AS wall_seconds, count(*) AS n_rows
FROM shards WHERE p_partkey NOT IN (SELECT p_partkey FROM conf) AND p_partkey % 9 <> 0 GROUP BY p_partkey""")
def merge_shards(spark, d):
    target = table(spark, d, "part").where("p_partkey % 9 = 0")
    out = led.merge_shards(shards(spark, d), ["p_partkey"], ["file"], _VOL, target)
    return out.select("p_partkey", "p_name", F.col("p_size").cast("long"), "file", "wall_seconds", "n_rows")


@query("merge_conflicts", f"WITH {SHARD_SQL} SELECT p_partkey, count(*) AS n_rows FROM shards WHERE p_partkey IN (SELECT p_partkey FROM conf) GROUP BY p_partkey")
def merge_conflicts(spark, d):
    return led.merge_conflicts(shards(spark, d), ["p_partkey"], _VOL)


@query("agreement", """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_name END AS p_name, p_size + (CASE WHEN p_partkey % 33 = 0 THEN 1 ELSE 0 END) AS p_size,
 p_retailprice + (CASE WHEN p_partkey % 21 = 0 THEN 0.5 WHEN p_partkey % 2 = 0 THEN 1e-11 ELSE 0 END)::DOUBLE AS p_retailprice FROM part WHERE p_partkey % 3 <> 1)
SELECT p.p_partkey, 'p_name' AS field, p.p_name AS "left", b.p_name AS "right" FROM part p JOIN b ON b.p_partkey = p.p_partkey WHERE p.p_name IS DISTINCT FROM b.p_name
UNION ALL SELECT p.p_partkey, 'p_size', CAST(p.p_size AS VARCHAR), CAST(b.p_size AS VARCHAR) FROM part p JOIN b ON b.p_partkey = p.p_partkey WHERE p.p_size <> b.p_size
UNION ALL SELECT p.p_partkey, 'p_retailprice', CAST(p.p_retailprice AS VARCHAR), CAST(b.p_retailprice AS VARCHAR) FROM part p JOIN b ON b.p_partkey = p.p_partkey
 WHERE abs(p.p_retailprice - b.p_retailprice) > 1e-12 * greatest(1, abs(p.p_retailprice))""")
def agreement(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    bump = F.when(k % 21 == 0, 0.5).when(k % 2 == 0, 1e-11).otherwise(0.0)
    b = p.where(k % 3 != 1).select(
        "p_partkey", F.when(k % 40 != 0, F.col("p_name")).alias("p_name"),
        (F.col("p_size") + F.when(k % 33 == 0, 1).otherwise(0)).alias("p_size"), (F.col("p_retailprice") + bump).alias("p_retailprice"))
    return led.agreement(p, b, ["p_partkey"])


# ---- corpora ---------------------------------------------------------------
STAT_SQL = f"""{ITEM_SQL}, st AS (SELECT corpus, count(DISTINCT grp) AS n_groups, count(*) AS n_items, sum(duration_s) AS s, count(raw) AS kept FROM item GROUP BY corpus)"""


def _stats(spark, d):
    return sm.corpus_stats(items(spark, d).withColumnRenamed("raw", "label"))


@query("corpus_stats", f"""WITH {STAT_SQL} SELECT corpus, n_groups, n_items, {sql_r9('s / 3600')} AS hours, {sql_r9('s / n_items')} AS mean_duration,
kept AS n_kept, n_items - kept AS n_excluded FROM st""")
def corpus_stats(spark, d):
    return rounded(_stats(spark, d).withColumn("n_items", F.col("n_items").cast("long")), "hours", "mean_duration")


@query("check_counts", f"""WITH {STAT_SQL}, e(corpus, ei, eg) AS (VALUES ('en', 615::BIGINT, 20::BIGINT), ('de', 140::BIGINT, 20::BIGINT), ('es', 106::BIGINT, 19::BIGINT), ('it', 5::BIGINT, 1::BIGINT))
SELECT e.corpus, n_items, ei AS expected_items, n_groups, eg AS expected_groups, coalesce(abs(n_items - ei) <= 0.01 * ei, false) AS items_ok, coalesce(n_groups = eg, false) AS groups_ok
FROM e LEFT JOIN st ON st.corpus = e.corpus""")
def check_counts(spark, d):
    want = spark.createDataFrame([("en", 615, 20), ("de", 140, 20), ("es", 106, 19), ("it", 5, 1)],
                                 "corpus string, expected_items bigint, expected_groups bigint")
    return sm.check_counts(_stats(spark, d), want)


SUBSET_SQL = """sub AS (SELECT CASE WHEN turn % 2 = 0 THEN 'free' ELSE 'scripted' END AS subset, role AS label, 's' || (conv_id % 5) AS session FROM conversations)"""


def _subset(spark, d):
    return table(spark, d, "conversations").select(
        F.when(F.col("turn") % 2 == 0, "free").otherwise("scripted").alias("subset"), F.col("role").alias("label"),
        F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("session"))


@query("subset_counts", f"WITH {SUBSET_SQL} SELECT subset, label, session, count(*) AS n FROM sub GROUP BY ALL")
def subset_counts(spark, d):
    return sm.subset_counts(_subset(spark, d), "subset", "label", "session")


@query("subset_decision", f"""WITH {SUBSET_SQL}, c AS (SELECT label, session, count(*) AS n FROM sub WHERE subset = 'free' GROUP BY ALL),
fr AS (SELECT l AS label, s AS session FROM (SELECT unnest(['assistant', 'user']) AS l), (SELECT unnest(['s0', 's1', 's2', 's3', 's4']) AS s)),
x AS (SELECT fr.label, sum(coalesce(n, 0)) AS total, count(n) AS present, count(*) FILTER (WHERE coalesce(n, 0) < 50) AS thin FROM fr LEFT JOIN c ON c.label = fr.label AND c.session = fr.session GROUP BY fr.label),
r AS (SELECT label || ': ' || total || ' items < 100' AS r FROM x WHERE total < 100 UNION ALL SELECT label || ': in ' || present || ' sessions < 4' FROM x WHERE present < 4
 UNION ALL SELECT label || ': below 50 in ' || thin || ' sessions' FROM x WHERE thin > 0)
SELECT CASE WHEN count(*) = 0 THEN 'free' ELSE 'both' END AS chosen, coalesce(string_agg(r, '; ' ORDER BY r), '') AS failed_checks FROM r""")
def subset_decision(spark, d):
    counts = sm.subset_counts(_subset(spark, d), "subset", "label", "session")
    out = sm.subset_decision(counts, "free", "both", ("assistant", "user"), tuple(f"s{i}" for i in range(5)), 100, 4, 50)
    return out.select("chosen", F.array_join("failed_checks", "; ").alias("failed_checks"))
