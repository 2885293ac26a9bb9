"""Vectors: moments, pooling, alignment maps and discrepancy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..operators import align, mkmmd, mmd, vectors as ov
from .registry import query, r9, sql_r9, table
from .runs import rounded
from .views import DIM_SQL, VEC_SQL, vectors

D = 64
CAP = 60


def sides(spark, d):
    v = vectors(spark, d)
    return v.where("domain = 0"), v.where("domain = 1")


def probe(df, *keys):
    """Three coordinates and the norm of each vector: enough to compare whole vectors row by row."""
    return df.select(
        *keys, r9(F.col("v")[0]).alias("x0"), r9(F.col("v")[31]).alias("x31"), r9(F.col("v")[63]).alias("x63"),
        F.round(fv.norm(F.col("v")), 7).alias("norm"))


def sql_probe(keys: str) -> str:
    return f"""SELECT {keys}, {sql_r9('max(x) FILTER (WHERE dim = 0)')} AS x0, {sql_r9('max(x) FILTER (WHERE dim = 31)')} AS x31,
{sql_r9('max(x) FILTER (WHERE dim = 63)')} AS x63, round(sqrt(sum(x * x)), 7) AS norm FROM out GROUP BY {keys}"""


STAT_SQL = f"{DIM_SQL}, st AS (SELECT domain, dim, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM dims GROUP BY ALL)"
CROSS_SQL = f"{STAT_SQL}, g AS (SELECT a.dim, a.m AS ms, a.s AS ss, b.m AS mt, b.s AS sd FROM st a JOIN st b ON a.dim = b.dim WHERE a.domain = 0 AND b.domain = 1)"


# ---- moments ---------------------------------------------------------------
@query("dim_stats", f"WITH {STAT_SQL} SELECT domain, CAST(dim AS INTEGER) AS dim, n, {sql_r9('m')} AS mean, {sql_r9('s')} AS std FROM st")
def dim_stats(spark, d):
    s = ov.dim_stats(vectors(spark, d), ["domain"])
    e = s.select("domain", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "z"))
    return e.select("domain", "dim", "n", r9("z.mean").alias("mean"), r9("z.std").alias("std"))


@query("covariance_pairs", f"""WITH {DIM_SQL} SELECT a.domain, CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, {sql_r9('covar_samp(a.x, b.x)')} AS cov
FROM dims a JOIN dims b ON a.item_id = b.item_id GROUP BY a.domain, a.dim, b.dim""")
def covariance_pairs(spark, d):
    c = ov.covariance(vectors(spark, d), ["domain"])
    e = c.select("domain", "i", F.posexplode("row").alias("j", "cov"))
    return e.select("domain", "i", "j", r9("cov").alias("cov"))


@query("nonfinite", f"""WITH {VEC_SQL}, p AS (SELECT item_id, CASE WHEN item_id % 40 = 0 THEN list_append(v, 'nan'::DOUBLE) WHEN item_id % 41 = 0 THEN list_append(v, 'inf'::DOUBLE) ELSE v END AS v FROM vec)
SELECT item_id FROM p WHERE len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0""")
def nonfinite(spark, d):
    k = F.col("item_id")
    bad = F.when(k % 40 == 0, F.array(F.lit(float("nan")))).when(k % 41 == 0, F.array(F.lit(float("inf")))).otherwise(F.array().cast("array<double>"))
    v = vectors(spark, d).withColumn("v", F.concat("v", bad))
    return v.where(fv.nonfinite(F.col("v"))).select("item_id")


@query("verify_vectors", f"""WITH {VEC_SQL} SELECT (SELECT count(*) FROM vec WHERE item_id % 10 <> 3) AS n_items,
(SELECT count(*) FROM vec WHERE item_id % 10 <> 5) + (SELECT count(*) FROM vec WHERE item_id % 50 = 0) AS n_vectors,
(SELECT count(*) FROM vec WHERE item_id % 10 = 5) AS missing, (SELECT count(*) FROM vec WHERE item_id % 10 = 3) AS extra,
(SELECT count(*) FROM vec WHERE item_id % 50 = 0) AS repeated, (SELECT count(*) FROM vec WHERE item_id % 20 = 7) AS wrong_shape, CAST(0 AS BIGINT) AS nonfinite""")
def verify_vectors(spark, d):
    v = vectors(spark, d)
    k = F.col("item_id")
    items = v.where(k % 10 != 3).select("item_id")
    vecs = v.where(k % 10 != 5).unionByName(v.where(k % 50 == 0))
    vecs = vecs.withColumn("v", F.when(k % 20 == 7, F.slice("v", 1, 10)).otherwise(F.col("v")))
    return ov.verify_vectors(items, vecs, "item_id", D)


@query("first_order_difference", """WITH a AS (SELECT event_id AS pos, user_id AS k FROM events), b AS (SELECT event_id AS pos, user_id + (CASE WHEN event_id % 977 = 976 THEN 1 ELSE 0 END) AS k FROM events)
SELECT min(a.pos) AS first_difference, count(*) AS n_differences FROM a JOIN b ON a.pos = b.pos WHERE a.k <> b.k""")
def first_order_difference(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("k"))
    b = a.withColumn("k", F.col("k") + F.when(F.col("pos") % 977 == 976, 1).otherwise(0))
    return ov.first_order_difference(a, b, "pos", "k")


# ---- pooling ---------------------------------------------------------------
@query("segment_pool", f"""WITH f AS (SELECT user_id, value, event_id % 7 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT *, unnest(range(8)) AS i FROM f)
SELECT user_id, CAST(i AS INTEGER) AS segment, {sql_r9('avg(value)')} AS value, {sql_r9('avg(y)')} AS y FROM s
WHERE least(i * n // 8, n - 1) <= t AND t < least(greatest((i + 1) * n // 8, i * n // 8 + 1), n) GROUP BY user_id, i""")
def segment_pool(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", (F.col("event_id") % 7).alias("y"))
    out = ov.segment_pool(e, "user_id", F.date_trunc("day", "ts"), ["ts", "event_id"], ["value", "y"], 8)
    return rounded(out, "value", "y")


@query("pool_frames", f"""SELECT user_id, {sql_r9('avg(value)')} AS value_mean, {sql_r9('stddev_pop(value)')} AS value_std, max(value) AS value_max FROM events GROUP BY user_id""")
def pool_frames(spark, d):
    return rounded(ov.pool(table(spark, d, "events"), "user_id", ["value"]), "value_mean", "value_std")


LAYER_SQL = f"{DIM_SQL}, layers AS (SELECT item_id // 5 AS item, item_id % 5 AS layer, dim, x FROM dims)"


def layered(spark, d):
    return vectors(spark, d).select(F.floor(F.col("item_id") / 5).cast("long").alias("item"), (F.col("item_id") % 5).alias("layer"), "v")


@query("aggregate_layers", f"""WITH {LAYER_SQL}, u AS (SELECT 'last' AS spec, item, dim, x FROM layers WHERE layer = 4 UNION ALL SELECT 'layer:2', item, dim, x FROM layers WHERE layer = 2
UNION ALL SELECT 'mean:1-3', item, dim, avg(x) FROM layers WHERE layer BETWEEN 1 AND 3 GROUP BY item, dim), out AS (SELECT * FROM u) {sql_probe('spec, item')}""")
def aggregate_layers(spark, d):
    out = None
    for spec in ("last", "layer:2", "mean:1-3"):
        one = ov.aggregate_layers(layered(spark, d), spec, 5, ["item"]).select(F.lit(spec).alias("spec"), "item", "v")
        out = one if out is None else out.unionByName(one)
    return probe(out, "spec", "item")


@query("item_view", f"WITH {LAYER_SQL}, out AS (SELECT item, dim, avg(x) AS x FROM layers GROUP BY ALL) {sql_probe('item')}")
def item_view(spark, d):
    return probe(ov.mean_vector(layered(spark, d), ["item"]), "item")


# ---- element-wise functions ------------------------------------------------
def pairs(spark, d):
    """Each vector as original, its reverse as the aligned version."""
    return vectors(spark, d).select("item_id", F.col("v").alias("original"), F.reverse("v").alias("aligned"))


PAIR_SQL = f"{VEC_SQL}, p AS (SELECT item_id, unnest(v) AS o, unnest(list_reverse(v)) AS a, unnest(range(64)) AS dim FROM vec)"


@query("blend", f"WITH {PAIR_SQL}, out AS (SELECT item_id, dim, 0.3::DOUBLE * a + 0.7::DOUBLE * o AS x FROM p) {sql_probe('item_id')}")
def blend(spark, d):
    p = pairs(spark, d)
    return probe(p.withColumn("v", fv.blend(F.col("original"), F.col("aligned"), 0.3)), "item_id")


@query("blend_groups", f"WITH {PAIR_SQL}, out AS (SELECT item_id, dim, o + (a - o) * ([0.1, 0.5, 0.9])[dim % 3 + 1]::DOUBLE AS x FROM p) {sql_probe('item_id')}")
def blend_groups(spark, d):
    groups = [j % 3 for j in range(D)]
    v = fv.blend_groups(F.col("original"), F.col("aligned"), groups, [0.1, 0.5, 0.9])
    return probe(pairs(spark, d).withColumn("v", v), "item_id")


@query("alpha_elementwise", f"""WITH {PAIR_SQL}, m AS (SELECT dim, max(abs(a - o)) + 1e-8 AS m FROM p GROUP BY dim),
out AS (SELECT item_id, p.dim, o + (a - o) * least(1, abs(a - o) / m) AS x FROM p JOIN m ON m.dim = p.dim) {sql_probe('item_id')}""")
def alpha_elementwise(spark, d):
    w = ov.alpha_elementwise(pairs(spark, d))
    return probe(w.withColumn("v", fv.blend_vector(F.col("original"), F.col("aligned"), F.col("alpha"))), "item_id")


def _alpha_rows(df):
    return df.select(F.posexplode("alpha").alias("dim", "alpha")).select("dim", r9("alpha").alias("alpha"))


@query("alpha_contiguous", f"""WITH {PAIR_SQL}, g AS (SELECT dim // 4 AS g, avg(abs(a - o)) AS m FROM p GROUP BY ALL)
SELECT CAST(d AS INTEGER) AS dim, {sql_r9('least(1, m / ((SELECT max(m) FROM g) + 1e-8))')} AS alpha FROM (SELECT unnest(range(64)) AS d) JOIN g ON g.g = d // 4""")
def alpha_contiguous(spark, d):
    return _alpha_rows(ov.alpha_contiguous(pairs(spark, d), D, 16))


@query("alpha_mean_gap", f"WITH {CROSS_SQL} SELECT CAST(dim AS INTEGER) AS dim, {sql_r9('least(1, abs(ms - mt) / (ss + sd + 1e-6))')} AS alpha FROM g")
def alpha_mean_gap(spark, d):
    return _alpha_rows(ov.alpha_mean_gap(*sides(spark, d)))


@query("alpha_group_norm", f"""WITH {CROSS_SQL}, n AS (SELECT dim % 5 AS k, sqrt(sum((ms - mt) * (ms - mt))) AS q FROM g GROUP BY ALL)
SELECT CAST(dim AS INTEGER) AS dim, {sql_r9('q / (q + 1e-6)')} AS alpha FROM g JOIN n ON n.k = g.dim % 5""")
def alpha_group_norm(spark, d):
    return _alpha_rows(ov.alpha_group_norm(*sides(spark, d), [j % 5 for j in range(D)]))


@query("fuse", f"""WITH {VEC_SQL}, p AS (SELECT item_id, list_concat(v, list_reverse(v)) AS f FROM vec)
SELECT item_id, CAST(len(f) AS INTEGER) AS size, {sql_r9('f[1]')} AS first, {sql_r9('f[65]')} AS middle, {sql_r9('list_sum(f[33:64])')} AS half FROM p""")
def fuse(spark, d):
    p = pairs(spark, d).withColumn("f", fv.fuse(F.col("original"), F.col("aligned")))
    return p.select("item_id", F.size("f").alias("size"), r9(F.col("f")[0]).alias("first"), r9(F.col("f")[64]).alias("middle"),
                    r9(fv.total(fv.part(F.col("original"), 1, 2))).alias("half"))


@query("peak_norm", f"""WITH {VEC_SQL}, q AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE v END AS v FROM vec),
e AS (SELECT item_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM q),
out AS (SELECT item_id, dim, CASE WHEN max(abs(x)) OVER (PARTITION BY item_id) > 0 THEN x / max(abs(x)) OVER (PARTITION BY item_id) ELSE x END AS x FROM e) {sql_probe('item_id')}""")
def peak_norm(spark, d):
    v = vectors(spark, d).withColumn("v", F.when(F.col("item_id") % 9 == 0, F.transform("v", lambda x: F.lit(0.0))).otherwise(F.col("v")))
    return probe(v.withColumn("v", fv.peak_norm(F.col("v"))), "item_id")


# ---- alignment -------------------------------------------------------------
def _aligned(spark, d, rung, **kw):
    s, t = sides(spark, d)
    m = align.fit_align(s, t, rung, **kw)
    return m.transform(s, "source").unionByName(m.transform(t, "target"))


@query("zscore", f"""WITH {STAT_SQL}, out AS (SELECT item_id, d.domain, d.dim, (x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END AS x
FROM dims d JOIN st ON st.domain = d.domain AND st.dim = d.dim) {sql_probe('item_id, domain')}""")
def zscore(spark, d):
    return probe(_aligned(spark, d, "zscore"), "item_id", "domain")


@query("zscore_by_class", f"""WITH {DIM_SQL}, st AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) AS s FROM dims GROUP BY ALL),
out AS (SELECT item_id, d.label, d.dim, (x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END AS x FROM dims d JOIN st ON st.label = d.label AND st.dim = d.dim) {sql_probe('item_id, label')}""")
def zscore_by_class(spark, d):
    return probe(align.zscore_by(vectors(spark, d), ["label"]), "item_id", "label")


@query("mean_shift", f"""WITH {CROSS_SQL}, out AS (SELECT item_id, domain, d.dim, CASE WHEN domain = 0 THEN x + (mt - ms) ELSE x END AS x FROM dims d JOIN g ON g.dim = d.dim) {sql_probe('item_id, domain')}""")
def mean_shift(spark, d):
    return probe(_aligned(spark, d, "mean_shift"), "item_id", "domain")


@query("diag_match", f"""WITH {CROSS_SQL}, out AS (SELECT item_id, domain, d.dim, CASE WHEN domain = 0 THEN x * (sd / ss) + (mt - ms * (sd / ss)) ELSE x END AS x FROM dims d JOIN g ON g.dim = d.dim) {sql_probe('item_id, domain')}""")
def diag_match(spark, d):
    return probe(_aligned(spark, d, "diag_match"), "item_id", "domain")


@query("coral")
def coral(spark, d):
    return probe(_aligned(spark, d, "coral", eps=0.01), "item_id", "domain")


@query("coral_ledoit_wolf")
def coral_ledoit_wolf(spark, d):
    return probe(_aligned(spark, d, "coral", lw=True), "item_id", "domain")


@query("subspace")
def subspace(spark, d):
    return probe(_aligned(spark, d, "subspace", k=16), "item_id", "domain")


@query("mkmmd_diag")
def mkmmd_diag(spark, d):
    return probe(_aligned(spark, d, "mkmmd_diag", lam=0.1, steps=20, features=24), "item_id", "domain")


FREQ, LAM, WIDTH = 8, 0.1, 6.0


def _unit(name: str) -> str:
    return f"((CAST('0x' || substr(sha256('rff|0|' || k || '|' || j || '|' || dim || '|{name}'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


# The map x -> 0.9 x + 0.05 of domain 0 against domain 1.
@query("mkmmd_objective", f"""WITH {DIM_SQL}, f AS (SELECT k, j, dim, sqrt(-2 * ln({_unit('u')})) * cos(2 * pi() * {_unit('v')}) / (([{', '.join(f"{m}::DOUBLE" for m in mmd.MULTIPLIERS)}])[k + 1] * {WIDTH}::DOUBLE) AS w
 FROM (SELECT unnest(range({len(mmd.MULTIPLIERS)})) AS k), (SELECT unnest(range({FREQ})) AS j), (SELECT unnest(range({D})) AS dim)),
z AS (SELECT domain, item_id, k, j, sum(w * CASE WHEN domain = 0 THEN 0.9::DOUBLE * x + 0.05::DOUBLE ELSE x END) AS z FROM dims JOIN f ON f.dim = dims.dim GROUP BY ALL),
m AS (SELECT domain, k, j, count(*) AS n, avg(cos(z)) AS c, avg(sin(z)) AS s FROM z GROUP BY ALL),
p AS (SELECT a.k, any_value(a.n) AS na, any_value(b.n) AS nb, avg(a.c * a.c + a.s * a.s) AS aa, avg(b.c * b.c + b.s * b.s) AS bb, avg(a.c * b.c + a.s * b.s) AS ab
 FROM m a JOIN m b ON a.k = b.k AND a.j = b.j WHERE a.domain = 0 AND b.domain = 1 GROUP BY a.k)
SELECT CAST(k AS INTEGER) AS kernel, {sql_r9('(na * aa - 1) / (na - 1) + (nb * bb - 1) / (nb - 1) - 2 * ab')} AS mmd2, {sql_r9(f'{LAM}::DOUBLE * {D} * 0.01')} AS penalty FROM p""")
def mkmmd_objective(spark, d):
    """What the map's fit minimises, at a given map: the discrepancy of each kernel over all rows, and the penalty."""
    s, t = sides(spark, d)
    omega = mkmmd.frequencies(D, FREQ, WIDTH)
    w, b = 0.9 * np.eye(D), np.full(D, 0.05)
    moved, fixed = mkmmd.feature_sums(s, omega, w, b, outer=False), mkmmd.feature_sums(t, omega, np.eye(D), np.zeros(D), outer=False)
    each = mkmmd.discrepancy(moved, fixed, len(mmd.MULTIPLIERS))
    away = LAM * float(((w - np.eye(D)) ** 2).sum())
    out = spark.createDataFrame([(k, float(x), away) for k, x in enumerate(each)], "kernel int, mmd2 double, penalty double")
    return rounded(out, "mmd2", "penalty")


@query("group_scatter", f"""WITH {DIM_SQL}, g AS (SELECT item_id, dim % 8 AS grp, avg(x) AS m FROM dims GROUP BY ALL)
SELECT CAST(dim % 8 AS INTEGER) AS "group", count(DISTINCT dim) AS n_dims, round(sum((x - m) * (x - m)), 6) AS scatter
FROM dims JOIN g ON g.item_id = dims.item_id AND g.grp = dims.dim % 8 GROUP BY dim % 8""")
def group_scatter(spark, d):
    """Within-group scatter of the dimensions' profiles over all items, for groups of every eighth dimension."""
    rows = ov.scatter(ov.inner_products(vectors(spark, d)), [i % 8 for i in range(D)])
    return spark.createDataFrame(rows, "group int, n_dims bigint, scatter double").withColumn("scatter", F.round("scatter", 6))


@query("cov_diag")
def cov_diag(spark, d):
    return align.cov_diag(vectors(spark, d), ["domain"])


@query("shrinkage_path")
def shrinkage_path(spark, d):
    return align.shrinkage_path(*sides(spark, d), [1e-2, 1e-1, 1.0, 10.0, 100.0])


@query("group_dims")
def group_dims(spark, d):
    return ov.group_dims(vectors(spark, d), 8)


# ---- discrepancy -----------------------------------------------------------
def rows(spark, d, *keys):
    return mmd.two_sides(*sides(spark, d), keys)


def _rank(salt: str, cells: str, order: str) -> str:
    return f"row_number() OVER (PARTITION BY {cells} ORDER BY sha256({salt}), {order})"


SIDE_SQL = f"{VEC_SQL}, sd AS (SELECT CASE WHEN domain = 0 THEN 'a' ELSE 'b' END AS side, item_id, v, label FROM vec)"
CAP_SQL = f"""{SIDE_SQL}, cs AS (SELECT * FROM (SELECT *, {_rank("'cap|0|' || side || '|' || item_id", "side", "item_id")} AS k FROM sd) WHERE k <= {CAP}),
bs AS (SELECT * FROM (SELECT *, {_rank("'bw|0|' || side || '|' || item_id", "1", "side, item_id")} AS k FROM sd) WHERE k <= {CAP}),
bw AS (SELECT sqrt(quantile_cont(power(list_distance(x.v, y.v), 2), 0.5)) AS h FROM bs x JOIN bs y ON (x.side, x.item_id) < (y.side, y.item_id))"""
_KERNEL = "(" + " + ".join(f"exp(-power(list_distance(x.v, y.v), 2) / (2 * power({m} * h, 2)))" for m in mmd.MULTIPLIERS) + ")"


def _mmd_sql(src: str, keys: str = "") -> str:
    k = f"x.{keys} = y.{keys} AND " if keys else ""
    sel = f"x.{keys}, " if keys else ""
    return f"""SELECT {sel}x.side AS sx, y.side AS sy, sum({_KERNEL}) AS s, count(*) AS n FROM {src} x JOIN {src} y ON {k}(x.side < y.side OR (x.side = y.side AND x.item_id <> y.item_id)), bw GROUP BY ALL"""


_COMBINE = "sum(CASE WHEN sx = sy THEN s / n ELSE -2 * s / n END)"


@query("cap_sample", f"WITH {CAP_SQL} SELECT side, item_id FROM cs")
def cap_sample(spark, d):
    return mmd.capped(rows(spark, d), [], CAP).select("side", "item_id")


@query("median_bandwidth", f"WITH {CAP_SQL} SELECT {sql_r9('h')} AS bandwidth FROM bw")
def median_bandwidth(spark, d):
    return mmd.median_bandwidth(rows(spark, d), [], CAP).select(r9("bandwidth").alias("bandwidth"))


@query("mmd2", f"""WITH {CAP_SQL}, m AS ({_mmd_sql('cs')}) SELECT {sql_r9(_COMBINE)} AS mmd2,
{sql_r9("(SELECT avg(exp(-power(list_distance(x.v, y.v), 2) / (2 * power(4 * h, 2)))) FROM cs x JOIN cs y ON x.side < y.side, bw)")} AS saturation FROM m""")
def mmd2(spark, d):
    r = rows(spark, d).withColumn("cell", F.lit(0))
    bw = mmd.median_bandwidth(r, ["cell"], CAP)
    return mmd.measure(r, ["cell"], bw, CAP).select(r9("mmd2").alias("mmd2"), r9("saturation").alias("saturation"))


REPS = 3
HALF_SQL = f"""{CAP_SQL}, hr AS (SELECT s.*, rep, {_rank("'half|0|' || rep || '|' || item_id", "rep", "item_id")} AS k, least(count(*) OVER (PARTITION BY rep) // 2, {CAP}) AS h2
  FROM sd s, (SELECT unnest(range({REPS})) AS rep) WHERE side = 'a'),
hs AS (SELECT rep, item_id, v, CASE WHEN k <= h2 THEN 'a' ELSE 'b' END AS side FROM hr WHERE k <= 2 * h2),
nm AS ({_mmd_sql('hs', 'rep')}), nr AS (SELECT rep, {_COMBINE} AS m FROM nm GROUP BY rep)"""


@query("half_splits", f"WITH {HALF_SQL} SELECT CAST(rep AS INTEGER) AS rep, item_id, side FROM hs")
def half_splits(spark, d):
    r = rows(spark, d).where("side = 'a'")
    return mmd.half_splits(r, [], REPS, CAP).select("rep", "item_id", "side")


@query("null_scale", f"WITH {HALF_SQL} SELECT {sql_r9('avg(abs(m))')} AS scale, {sql_r9('avg(m)')} AS signed_mean, {sql_r9('stddev_pop(m)')} AS spread, count(*) AS n_repeats FROM nr")
def null_scale(spark, d):
    r = rows(spark, d).withColumn("cell", F.lit(0))
    bw = mmd.median_bandwidth(r, ["cell"], CAP)
    out = mmd.null_scale(r.where("side = 'a'"), ["cell"], bw, REPS, CAP)
    return rounded(out, "scale", "signed_mean", "spread").select("scale", "signed_mean", "spread", "n_repeats")


@query("effect_size", f"""WITH {HALF_SQL}, m AS ({_mmd_sql('cs')}) SELECT {sql_r9(_COMBINE)} AS mmd2, round({_COMBINE} / (SELECT avg(abs(m)) FROM nr), 6) AS effect_size FROM m""")
def effect_size(spark, d):
    out = mmd.effect_size(rows(spark, d), [], REPS, CAP)
    return out.select(r9("mmd2").alias("mmd2"), F.round("effect_size", 6).alias("effect_size"))


COND_SQL = f"""{SIDE_SQL}, sp AS (SELECT label, count(*) FILTER (WHERE side = 'a') AS n_source, count(*) FILTER (WHERE side = 'b') AS n_target FROM sd GROUP BY label),
dd AS (SELECT sd.* FROM sd JOIN sp ON sp.label = sd.label WHERE n_source >= 24 AND n_target >= 24),
cs AS (SELECT * FROM (SELECT *, {_rank("'cap|0|' || side || '|' || item_id", "label, side", "item_id")} AS k FROM dd) WHERE k <= {CAP}),
bs AS (SELECT * FROM (SELECT *, {_rank("'bw|0|' || side || '|' || item_id", "label", "side, item_id")} AS k FROM dd) WHERE k <= {CAP}),
bw AS (SELECT x.label AS bl, sqrt(quantile_cont(power(list_distance(x.v, y.v), 2), 0.5)) AS h FROM bs x JOIN bs y ON x.label = y.label AND (x.side, x.item_id) < (y.side, y.item_id) GROUP BY x.label),
m AS (SELECT x.label, x.side AS sx, y.side AS sy, sum({_KERNEL}) AS s, count(*) AS n FROM cs x JOIN cs y ON x.label = y.label AND (x.side < y.side OR (x.side = y.side AND x.item_id <> y.item_id)) JOIN bw ON bl = x.label GROUP BY ALL),
mm AS (SELECT label, {_COMBINE} AS raw FROM m GROUP BY label),
hr AS (SELECT s.*, rep, {_rank("'half|0|' || rep || '|' || item_id", "label, rep", "item_id")} AS k, least(count(*) OVER (PARTITION BY label, rep) // 2, {CAP}) AS h2
  FROM dd s, (SELECT unnest(range({REPS})) AS rep) WHERE side = 'a'),
hs AS (SELECT label, rep, item_id, v, CASE WHEN k <= h2 THEN 'a' ELSE 'b' END AS side FROM hr WHERE k <= 2 * h2),
nm AS (SELECT x.label, x.rep, x.side AS sx, y.side AS sy, sum({_KERNEL}) AS s, count(*) AS n FROM hs x JOIN hs y ON x.label = y.label AND x.rep = y.rep AND (x.side < y.side OR (x.side = y.side AND x.item_id <> y.item_id)) JOIN bw ON bl = x.label GROUP BY ALL),
nr AS (SELECT label, avg(abs(m)) AS sc FROM (SELECT label, rep, {_COMBINE} AS m FROM nm GROUP BY label, rep) GROUP BY label),
cond AS (SELECT sp.label, n_source, n_target, raw, raw / sc AS e, CASE WHEN raw IS NULL THEN 'support below 24 (source ' || n_source || ', target ' || n_target || ')' END AS undefined_reason
  FROM sp LEFT JOIN mm ON mm.label = sp.label LEFT JOIN nr ON nr.label = sp.label)"""


@query("conditional_mmd", f"WITH {COND_SQL} SELECT label, n_source, n_target, {sql_r9('raw')} AS raw_mmd, round(e, 6) AS effect_size, undefined_reason FROM cond")
def conditional_mmd(spark, d):
    out = mmd.conditional_mmd(rows(spark, d, "label"), "label", 24, (), REPS, CAP)
    return rounded(out, "raw_mmd").withColumn("effect_size", F.round("effect_size", 6))


@query("conditional_summary", f"WITH {COND_SQL} SELECT round(avg(e), 6) AS mean_effect, {sql_r9('avg(n_source)')} AS mean_n_source, {sql_r9('avg(n_target)')} AS mean_n_target, count(*) FILTER (WHERE e IS NULL) AS n_undefined FROM cond")
def conditional_summary(spark, d):
    out = mmd.conditional_summary(mmd.conditional_mmd(rows(spark, d, "label"), "label", 24, (), REPS, CAP), [])
    return rounded(out, "mean_n_source", "mean_n_target").withColumn("mean_effect", F.round("mean_effect", 6))


@query("reference_effect")
def reference_effect(spark, d):
    """Effect of every rung measured in one frame fixed on the unaligned source."""
    s, t = sides(spark, d)
    frame = align.ReferenceFrame().fit(s, t)
    parts = None
    for rung, kw in (("none", {}), ("zscore", {}), ("mean_shift", {}), ("coral", {"eps": 0.01})):
        m = align.fit_align(s, t, rung, **kw)
        r = mmd.two_sides(frame.transform(m.transform(s, "source"), "source"), frame.transform(m.transform(t, "target"), "target"))
        r = r.withColumn("rung", F.lit(rung))
        parts = r if parts is None else parts.unionByName(r)
    return mmd.effect_size(parts, ["rung"], 5, 512)


LADDER = {
    "none": ("none", {}), "zscore": ("zscore", {}), "mean_shift": ("mean_shift", {}), "coral(eps=0.01)": ("coral", {"eps": 0.01}),
    "coral(ledoit-wolf)": ("coral", {"lw": True}), "mkmmd_diag": ("mkmmd_diag", {"lam": 0.1, "steps": 12, "features": 16}),
    "mkmmd_full": ("mkmmd_full", {"lam": 0.1, "steps": 8, "features": 16, "eps": 0.01}),
}


@query("ladder_table")
def ladder_table(spark, d):
    """All seven rungs at three bandwidths, with notes on the rungs that start warm."""
    s, t = sides(spark, d)
    rungs, reverted = {}, {}
    for name, (rung, settings) in LADDER.items():
        m = align.fit_align(s, t, rung, **settings)
        rungs[name] = mmd.two_sides(m.transform(s, "source"), m.transform(t, "target"))
        if "reverted" in m.diagnostics:
            reverted[name] = m.diagnostics["reverted"]
    return mmd.ladder_table(rungs, (0.5, 1.0, 2.0), reverted=reverted)
