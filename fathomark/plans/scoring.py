"""Scores, floors, priors: queries over predictions and labelled items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.small import small_side
from ..operators import floors, metrics, priors
from .registry import query, r9, sql_r9
from .views import (
    CLASSES, FLAGS, ITEM_SQL, LABELLED_SQL, LANGS, LINE_SQL, PRED_SQL, QUALITY, items, line_predictions,
    predictions, rules, sql_list, values_sql,
)
from ..operators import labels as lab

K = len(CLASSES)

COUNTS_SQL = f"{PRED_SQL}, counts AS (SELECT domain, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL)"
MARGIN_SQL = f"""{COUNTS_SQL}, {values_sql('cls', 'class', CLASSES)},
keyed AS (SELECT DISTINCT domain FROM pred),
margin AS (
  SELECT k.domain, c.class,
    CAST(coalesce((SELECT sum(n) FROM counts x WHERE x.domain = k.domain AND y_true = c.class AND y_pred = c.class), 0) AS BIGINT) AS tp,
    CAST(coalesce((SELECT sum(n) FROM counts x WHERE x.domain = k.domain AND y_true = c.class), 0) AS BIGINT) AS support,
    CAST(coalesce((SELECT sum(n) FROM counts x WHERE x.domain = k.domain AND y_pred = c.class), 0) AS BIGINT) AS predicted
  FROM keyed k, cls c),
scored AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END AS f1,
    CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) END AS f1_or_null
  FROM margin)"""


def event_counts(spark, d):
    return metrics.confusion_counts(predictions(spark, d), ["domain"])


@query("confusion", f"""WITH {COUNTS_SQL}, {values_sql('a', 'y_true', CLASSES)}, {values_sql('b', 'y_pred', CLASSES)}
SELECT k.domain, a.y_true, b.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT domain FROM pred) k CROSS JOIN a CROSS JOIN b
LEFT JOIN counts c ON c.domain = k.domain AND c.y_true = a.y_true AND c.y_pred = b.y_pred""")
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d), CLASSES, ["domain"])


@query("confusion_by_group", f"WITH {PRED_SQL} SELECT domain, grp, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion_by_group(spark, d):
    return metrics.confusion_by_group(predictions(spark, d), ["domain"], "grp")


@query("conf_rate", f"""WITH {LINE_SQL} SELECT arm, y_true, y_pred, count(*) AS n,
{sql_r9("count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY arm, y_true)")} AS rate FROM line GROUP BY arm, y_true, y_pred""")
def conf_rate(spark, d):
    conf = metrics.confusion_counts(line_predictions(spark, d), ["arm"])
    return metrics.conf_rate(conf, ["arm"]).withColumn("rate", r9("rate"))


@query("per_class", f"""WITH {MARGIN_SQL} SELECT domain, class, tp, support, predicted,
{sql_r9('precision')} AS precision, {sql_r9('recall')} AS recall, {sql_r9('f1')} AS f1 FROM scored""")
def per_class(spark, d):
    out = metrics.per_class(event_counts(spark, d), CLASSES, ["domain"]).drop("f1_or_null")
    return out.select("domain", "class", "tp", "support", "predicted", *[r9(c).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1_zero", f"WITH {MARGIN_SQL} SELECT domain, {sql_r9('avg(f1)')} AS macro_f1 FROM scored GROUP BY domain")
def macro_f1_zero(spark, d):
    return metrics.macro_f1(event_counts(spark, d), CLASSES, ["domain"]).withColumn("macro_f1", r9("macro_f1"))


@query("macro_f1_drop", f"WITH {MARGIN_SQL} SELECT domain, {sql_r9('avg(f1_or_null)')} AS macro_f1 FROM scored GROUP BY domain")
def macro_f1_drop(spark, d):
    return metrics.macro_f1(event_counts(spark, d), CLASSES, ["domain"], "drop").withColumn("macro_f1", r9("macro_f1"))


@query("accuracy_uar", f"""WITH {MARGIN_SQL} SELECT domain, {sql_r9('sum(tp) / sum(support)')} AS accuracy,
{sql_r9('avg(recall) FILTER (WHERE support > 0)')} AS uar FROM scored GROUP BY domain""")
def accuracy_uar(spark, d):
    m = metrics.all_metrics(event_counts(spark, d), CLASSES, ["domain"])
    return m.select("domain", r9("accuracy").alias("accuracy"), r9("uar").alias("uar"))


@query("collapsed", f"WITH {MARGIN_SQL} SELECT domain, class, support FROM margin WHERE predicted = 0")
def collapsed(spark, d):
    return metrics.collapsed(event_counts(spark, d), CLASSES, ["domain"])


@query("all_metrics", f"""WITH {MARGIN_SQL} SELECT domain, CAST(sum(support) AS BIGINT) AS n, {sql_r9('avg(f1)')} AS macro_f1,
{sql_r9('avg(f1_or_null)')} AS macro_f1_present, {sql_r9('sum(tp) / sum(support)')} AS accuracy,
{sql_r9('avg(recall) FILTER (WHERE support > 0)')} AS uar,
count(*) FILTER (WHERE predicted = 0) AS n_collapsed FROM scored GROUP BY domain""")
def all_metrics(spark, d):
    m = metrics.all_metrics(event_counts(spark, d), CLASSES, ["domain"])
    return m.select("domain", "n", *[r9(c).alias(c) for c in ("macro_f1", "macro_f1_present", "accuracy", "uar")], "n_collapsed")


@query("conf_pack", f"""WITH {LINE_SQL}, {values_sql('a', 't', FLAGS)}, {values_sql('b', 'p', FLAGS)},
c AS (SELECT arm, grp, y_true, y_pred, count(*) AS n FROM line GROUP BY ALL)
SELECT k.arm, k.grp, string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY t, p) AS cells
FROM (SELECT DISTINCT arm, grp FROM line) k CROSS JOIN a CROSS JOIN b
LEFT JOIN c ON c.arm = k.arm AND c.grp = k.grp AND c.y_true = t AND c.y_pred = p GROUP BY k.arm, k.grp""")
def conf_pack(spark, d):
    counts = metrics.confusion_by_group(line_predictions(spark, d), ["arm"], "grp")
    packed = metrics.pack_confusion(counts, FLAGS, ["arm", "grp"])
    return packed.withColumn("cells", F.concat_ws(",", F.col("cells").cast("array<string>")))


@query("conf_unpack", f"WITH {LINE_SQL} SELECT arm, grp, y_true, y_pred, count(*) AS n FROM line GROUP BY ALL")
def conf_unpack(spark, d):
    counts = metrics.confusion_by_group(line_predictions(spark, d), ["arm"], "grp")
    return metrics.unpack_confusion(metrics.pack_confusion(counts, FLAGS, ["arm", "grp"]), FLAGS, ["arm", "grp"])


# ---- floors ----------------------------------------------------------------
# Source labels of a domain are the labels of the other one.
FLOOR_SQL = f"""{PRED_SQL}, {values_sql('cls', 'class', CLASSES)},
prior AS (SELECT k.domain, c.class, count(p.item_id) AS n,
    count(p.item_id)::DOUBLE / sum(count(p.item_id)) OVER (PARTITION BY k.domain) AS p
  FROM (SELECT DISTINCT domain FROM pred) k CROSS JOIN cls c
  LEFT JOIN pred p ON p.domain = k.domain AND p.y_true = c.class GROUP BY k.domain, c.class),
both_sides AS (SELECT t.domain, t.class, t.p, s.p AS q, s.n AS sn
  FROM prior t JOIN prior s ON s.domain = 1 - t.domain AND s.class = t.class),
top AS (SELECT domain, arg_max(p, (sn, class)) AS pm FROM both_sides GROUP BY domain)"""


def _small_counts(spark, d):
    """Confusion counts of the whole table as a local relation: it is read once, K*K rows per domain stay."""
    return small_side(event_counts(spark, d))


def _sides(counts):
    vec = priors.prior_vector(counts, CLASSES, ["domain"], "y_true", "n")
    return vec, vec.withColumn("domain", 1 - F.col("domain"))


@query("floors_analytic", f"""WITH {FLOOR_SQL}
SELECT b.domain, {sql_r9(f"avg(2 * p * (1.0::DOUBLE / {K}) / (p + 1.0::DOUBLE / {K}))")} AS chance_macro_f1,
{sql_r9(f"max(2 * t.pm / (t.pm + 1)) / {K}")} AS majority_macro_f1,
{sql_r9("avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END)")} AS prior_matched_macro_f1
FROM both_sides b JOIN top t ON t.domain = b.domain GROUP BY b.domain""")
def floors_analytic(spark, d):
    target, source = _sides(_small_counts(spark, d))
    out = floors.analytic_floors(target, source, ["domain"], K)
    return out.select("domain", *[r9(c).alias(c) for c in ("chance_macro_f1", "majority_macro_f1", "prior_matched_macro_f1")])


FLAGSHIP_SQL = f"""WITH {MARGIN_SQL}, prior AS (
  SELECT domain, class, support AS n, support / sum(support) OVER (PARTITION BY domain) AS p FROM margin),
both_sides AS (SELECT t.domain, t.class, t.p, s.p AS q, s.n AS sn
  FROM prior t JOIN prior s ON s.domain = 1 - t.domain AND s.class = t.class),
top AS (SELECT domain, arg_max(p, (sn, class)) AS pm FROM both_sides GROUP BY domain),
fl AS (SELECT b.domain, avg(2 * p * (1.0::DOUBLE / {K}) / (p + 1.0::DOUBLE / {K})) AS chance,
  max(2 * t.pm / (t.pm + 1)) / {K} AS majority, avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END) AS matched
  FROM both_sides b JOIN top t ON t.domain = b.domain GROUP BY b.domain)
SELECT s.domain, {sql_r9('avg(f1)')} AS macro_f1, {sql_r9('max(chance)')} AS chance_macro_f1,
{sql_r9('max(majority)')} AS majority_macro_f1, {sql_r9('max(matched)')} AS prior_matched_macro_f1
FROM scored s JOIN fl ON fl.domain = s.domain GROUP BY s.domain"""


@query("macro_f1_with_floors", FLAGSHIP_SQL)
def macro_f1_with_floors(spark, d):
    """Macro-F1 per domain beside its chance, majority and prior-matched floors."""
    counts = _small_counts(spark, d)
    scores = metrics.macro_f1(counts, CLASSES, ["domain"])
    target, source = _sides(counts)
    out = scores.join(floors.analytic_floors(target, source, ["domain"], K), "domain")
    return out.select("domain", *[r9(c).alias(c) for c in out.columns if c != "domain"])


REPS = 10
_U = "CAST('0x' || substr(h, 1, 8) AS BIGINT)"


def _floor_sql(guess: str, extra: str = "") -> str:
    return f"""WITH {FLOOR_SQL}{extra},
drawn AS (SELECT p.domain, rep, y_true, sha256('0|' || rep || '|' || item_id) AS h FROM pred p, (SELECT unnest(range({REPS})) AS rep)),
guessed AS (SELECT d.domain, rep, y_true, {guess} AS y_pred FROM drawn d),
cc AS (SELECT domain, rep, y_true, y_pred, count(*) AS n FROM guessed GROUP BY ALL),
m AS (SELECT k.domain, k.rep, c.class,
   sum(n) FILTER (WHERE y_true = c.class AND y_pred = c.class) AS tp,
   sum(n) FILTER (WHERE y_true = c.class) AS sup, sum(n) FILTER (WHERE y_pred = c.class) AS pre
  FROM (SELECT DISTINCT domain, rep FROM cc) k CROSS JOIN cls c JOIN cc ON cc.domain = k.domain AND cc.rep = k.rep GROUP BY ALL),
f AS (SELECT domain, rep, avg(coalesce(2.0::DOUBLE * coalesce(tp, 0) / nullif(coalesce(sup, 0) + coalesce(pre, 0), 0), 0)) AS s FROM m GROUP BY ALL)
SELECT domain, count(*) AS n_draws, {sql_r9('avg(s)')} AS mean, {sql_r9('quantile_cont(s, 0.025)')} AS lo,
{sql_r9('quantile_cont(s, 0.975)')} AS hi FROM f GROUP BY domain"""


def _rounded(df):
    return df.select("domain", "n_draws", r9("mean").alias("mean"), r9("lo").alias("lo"), r9("hi").alias("hi"))


@query("floors_uniform_draws", _floor_sql(f"({sql_list(CLASSES)})[{_U} % {K} + 1]"))
def floors_uniform_draws(spark, d):
    p = predictions(spark, d)
    return _rounded(floors.empirical_floor(p, CLASSES, ["domain"], floors.uniform_prediction(CLASSES), "item_id", REPS))


@query("floors_prior_draws", _floor_sql(
    f"({sql_list(CLASSES)})[least({K - 1}, (SELECT count(*) FROM cum c WHERE c.domain = d.domain AND c.cq <= {_U} / 4294967296.0::DOUBLE)) + 1]",
    ", cum AS (SELECT domain, class, sum(q) OVER (PARTITION BY domain ORDER BY class) AS cq FROM both_sides)"))
def floors_prior_draws(spark, d):
    _, source = _sides(_small_counts(spark, d))
    cum = source.select("domain", floors.cumulative(F.col("p")).alias("cum"))
    p = predictions(spark, d).join(small_side(cum), "domain")
    return _rounded(floors.empirical_floor(p, CLASSES, ["domain"], floors.prior_prediction(CLASSES, "cum"), "item_id", REPS))


@query("floors_multinomial")
def floors_multinomial(spark, d):
    """1,000 draws per domain from the class counts; cost does not grow with items."""
    target, source = _sides(_small_counts(spark, d))
    both = target.select("domain", "counts").join(source.select("domain", F.col("p").alias("q")), "domain")
    return _rounded(floors.multinomial_floor(both, ["domain"], 1000, q="q"))


# ---- priors ----------------------------------------------------------------
@query("class_counts", f"WITH {ITEM_SQL} SELECT corpus, raw AS label, count(*) AS n FROM item WHERE raw IS NOT NULL GROUP BY ALL")
def class_counts(spark, d):
    return priors.class_counts(items(spark, d).withColumnRenamed("raw", "label"), ["corpus"])


PRIOR_SQL = f"""{ITEM_SQL}, {values_sql('cls', 'label', QUALITY)},
prior AS (SELECT k.corpus, c.label, count(i.item_id) AS n,
   count(i.item_id)::DOUBLE / nullif(sum(count(i.item_id)) OVER (PARTITION BY k.corpus), 0) AS p
  FROM (SELECT DISTINCT corpus FROM item) k CROSS JOIN cls c
  LEFT JOIN item i ON i.corpus = k.corpus AND i.raw = c.label GROUP BY k.corpus, c.label),
pair AS (SELECT s.corpus AS source, t.corpus AS target, s.label, s.n AS sn, t.n AS tn, s.p AS sp, t.p AS tp, (s.p + t.p) / 2 AS m
  FROM prior s JOIN prior t ON s.corpus <> t.corpus AND s.label = t.label)"""
_KL = "sum(CASE WHEN {a} <= 0 THEN 0 WHEN {b} <= 0 THEN 'Infinity'::DOUBLE ELSE {a} * ln({a} / {b}) END)"


def _raw(spark, d):
    return items(spark, d).withColumnRenamed("raw", "label")


@query("priors", f"WITH {PRIOR_SQL} SELECT corpus, label, n, {sql_r9('p')} AS prior FROM prior")
def priors_q(spark, d):
    return priors.priors(_raw(spark, d), QUALITY, ["corpus"]).select("corpus", "label", "n", r9("prior").alias("prior"))


@query("kl", f"WITH {PRIOR_SQL} SELECT source, target, {sql_r9(_KL.format(a='sp', b='tp'))} AS kl FROM pair GROUP BY ALL")
def kl(spark, d):
    return priors.prior_shift_table(_raw(spark, d), QUALITY, "corpus").select("source", "target", r9("kl").alias("kl"))


@query("js", f"""WITH {PRIOR_SQL} SELECT source, target,
{sql_r9("sqrt(greatest(0, (" + _KL.format(a='sp', b='m') + " + " + _KL.format(a='tp', b='m') + ") / 2))")} AS js FROM pair GROUP BY ALL""")
def js(spark, d):
    return priors.prior_shift_table(_raw(spark, d), QUALITY, "corpus").select("source", "target", r9("js").alias("js"))


@query("prior_shift_table", f"""WITH {PRIOR_SQL} SELECT source, target, CAST(sum(sn) AS BIGINT) AS n_source, CAST(sum(tn) AS BIGINT) AS n_target,
{sql_r9(_KL.format(a='sp', b='tp'))} AS kl,
{sql_r9("sqrt(greatest(0, (" + _KL.format(a='sp', b='m') + " + " + _KL.format(a='tp', b='m') + ") / 2))")} AS js FROM pair GROUP BY ALL""")
def prior_shift_table(spark, d):
    t = priors.prior_shift_table(_raw(spark, d), QUALITY, "corpus")
    return t.withColumn("kl", r9("kl")).withColumn("js", r9("js"))


@query("prior_drift", f"""WITH {PRIOR_SQL}, e(source, target, expected) AS (VALUES ('en', 'fr', 0.01::DOUBLE), ('de', 'en', 0.5::DOUBLE)),
o AS (SELECT source, target, {_KL.format(a='sp', b='tp')} AS kl FROM pair GROUP BY ALL)
SELECT o.source, o.target, {sql_r9('kl')} AS kl, expected, {sql_r9('abs(kl - expected)')} AS drift, abs(kl - expected) > 0.05 AS drifted
FROM o JOIN e ON o.source = e.source AND o.target = e.target""")
def prior_drift(spark, d):
    t = priors.prior_shift_table(_raw(spark, d), QUALITY, "corpus").select("source", "target", "kl")
    want = spark.createDataFrame([("en", "fr", 0.01), ("de", "en", 0.5)], "source string, target string, kl double")
    out = priors.drift(t, want, ["source", "target"], "kl", 0.05)
    return out.withColumn("kl", r9("kl")).withColumn("drift", r9("drift"))


@query("label_shift", f"""WITH {PRIOR_SQL}, s AS (SELECT source, target,
 sum(CASE WHEN tp <= 0 THEN 0 ELSE tp * ln(tp / greatest(sp, 1e-12)) END) AS kl, sum(abs(tp - sp)) / 2 AS tv,
 coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE sp <= 0 AND tp > 0), '') AS unsupported FROM pair GROUP BY ALL)
SELECT source, target, {sql_r9('kl')} AS kl_nats, {sql_r9('kl / ln(2)')} AS kl_bits, {sql_r9('tv')} AS total_variation, unsupported FROM s""")
def label_shift(spark, d):
    vec = priors.prior_vector(_raw(spark, d).where("label IS NOT NULL"), QUALITY, ["corpus"]).select("corpus", "p")
    pairs = priors.ordered_pairs(vec, "corpus")
    out = pairs.select(
        F.col("s_corpus").alias("source"), F.col("t_corpus").alias("target"),
        *priors.label_shift_columns(F.col("s_p"), F.col("t_p"), QUALITY),
    )
    return out.select(
        "source", "target", r9("kl_nats").alias("kl_nats"), r9("kl_bits").alias("kl_bits"),
        r9("total_variation").alias("total_variation"), F.concat_ws(",", "unsupported").alias("unsupported"),
    )


@query("ordered_pairs", f"""WITH {ITEM_SQL}, k AS (SELECT corpus, count(*) AS n FROM item GROUP BY corpus)
SELECT a.corpus AS s_corpus, a.n AS s_n, b.corpus AS t_corpus, b.n AS t_n FROM k a JOIN k b ON a.corpus <> b.corpus""")
def ordered_pairs(spark, d):
    k = items(spark, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    return priors.ordered_pairs(k, "corpus")


# ---- labels ----------------------------------------------------------------
@query("map_labels", f"WITH {LABELLED_SQL} SELECT item_id, corpus, raw, label, known FROM labelled")
def map_labels(spark, d):
    return lab.map_labels(items(spark, d), rules(spark), "three").select("item_id", "corpus", "raw", "label", "known")


@query("remap", f"""WITH {LABELLED_SQL}
SELECT l.item_id, l.corpus, l.label AS before, r.mapped AS after FROM labelled l
LEFT JOIN rules r ON r.corpus = l.corpus AND r.raw = l.raw AND r.space = 'two'""")
def remap(spark, d):
    three = lab.map_labels(items(spark, d), rules(spark), "three").withColumn("before", F.col("label"))
    return lab.remap(three, rules(spark), "two").select("item_id", "corpus", "before", F.col("label").alias("after"))


@query("unknown_labels", f"""WITH {LABELLED_SQL}
SELECT corpus, raw, count(*) AS n FROM labelled WHERE raw IS NOT NULL AND NOT known GROUP BY ALL""")
def unknown_labels(spark, d):
    return lab.unknown_labels(items(spark, d), rules(spark))


_STORED = "CASE WHEN item_id % 9 = 0 THEN 'good' ELSE label END"


@query("verify_labels", f"""WITH {LABELLED_SQL} SELECT item_id, {_STORED} AS stored, label FROM labelled
WHERE ({_STORED}) IS DISTINCT FROM label""")
def verify_labels(spark, d):
    fresh = lab.map_labels(items(spark, d), rules(spark), "three")
    stored = fresh.withColumn("stored", F.when(F.col("item_id") % 9 == 0, "good").otherwise(F.col("label")))
    return lab.verify_labels(stored.drop("label", "known"), rules(spark), "three", "stored").select("item_id", "stored", "label")


@query("seen_only", f"""WITH {ITEM_SQL} SELECT item_id, corpus, raw AS label FROM item
WHERE corpus <> 'es' AND raw IN (SELECT raw FROM item WHERE corpus = 'es')""")
def seen_only(spark, d):
    raw = _raw(spark, d)
    train = raw.where(F.col("corpus") == "es")
    return lab.seen_only(raw.where(F.col("corpus") != "es"), train).select("item_id", "corpus", "label")


@query("label_set_difference", f"""WITH {ITEM_SQL}, a AS (SELECT DISTINCT raw AS label FROM item WHERE corpus = 'en' AND raw IS NOT NULL),
b AS (SELECT DISTINCT raw AS label FROM item WHERE corpus = 'es' AND raw <> '1-1')
SELECT coalesce(a.label, b.label) AS label, CASE WHEN b.label IS NULL THEN 'left' ELSE 'right' END AS only_in
FROM a FULL JOIN b ON a.label = b.label WHERE a.label IS NULL OR b.label IS NULL""")
def label_set_difference(spark, d):
    raw = _raw(spark, d).where("label IS NOT NULL")
    b = raw.where((F.col("corpus") == "es") & (F.col("label") != "1-1"))
    return lab.label_set_difference(raw.where(F.col("corpus") == "en"), b)


@query("support_guard", f"""WITH {ITEM_SQL} SELECT corpus, count(*) AS n,
CASE WHEN count(*) >= 120 THEN {sql_r9('avg(duration_s)')} END AS value,
CASE WHEN count(*) < 120 THEN 'support below 120 (' || count(*) || ')' END AS undefined_reason FROM item GROUP BY corpus""")
def support_guard(spark, d):
    g = items(spark, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("m"))
    return g.select("corpus", "n", *lab.support_guard(r9("m"), F.col("n"), 120))
