"""Splits, caps and leakage checks over the document manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leakage as leak
from ..operators import priors, splits
from .registry import query, r9, sql_r9
from .views import LANGS, SEEDS, SPACE, SPLIT_ITEM_SQL, split_items, sql_list

_SEEDS = ", ".join(str(s) for s in SEEDS)
GROUPS_SQL = f"""{SPLIT_ITEM_SQL},
grps AS (SELECT DISTINCT corpus, grp FROM split_item WHERE label IS NOT NULL),
seeds AS (SELECT unnest([{_SEEDS}]) AS seed)"""


def _cut(ratio: str) -> str:
    return f"greatest(1, least(n - 1, round_even(n * CAST({ratio} AS DOUBLE), 0)))"


ROLE_CASE = f"""CASE WHEN side = 'source' THEN CASE WHEN rk <= {_cut('0.8')} THEN 'source_train' ELSE 'source_val' END
  ELSE CASE WHEN rk <= {_cut('0.5')} THEN 'target_adapt' ELSE 'target_test' END END AS role"""
ASSIGN_SQL = f"""{GROUPS_SQL},
ranked AS (SELECT corpus, seed, side, grp,
   row_number() OVER (PARTITION BY corpus, seed, side ORDER BY sha256(seed || '|' || corpus || '|' || side || '|' || grp), grp) AS rk,
   count(*) OVER (PARTITION BY corpus, seed, side) AS n
  FROM grps, seeds, (SELECT unnest(['source', 'target']) AS side)),
asg AS (SELECT corpus, seed, grp, {ROLE_CASE} FROM ranked)"""
PAIR_SQL = f"""{ASSIGN_SQL},
roles AS (SELECT i.*, a.seed, a.role FROM split_item i JOIN asg a ON a.corpus = i.corpus AND a.grp = i.grp WHERE i.label IS NOT NULL),
pairs AS (SELECT r.*, CASE WHEN role LIKE 'source%' THEN corpus ELSE p END AS source,
   CASE WHEN role LIKE 'source%' THEN p ELSE corpus END AS target FROM roles r, (SELECT unnest({sql_list(LANGS)}) AS p) WHERE p <> corpus),
rows_ AS (SELECT *, source || '-' || target || '-s' || seed AS split_id FROM pairs)"""


@query("partition_groups", f"""WITH {GROUPS_SQL},
r AS (SELECT corpus, seed, grp, count(*) OVER (PARTITION BY corpus, seed) AS n,
  row_number() OVER (PARTITION BY corpus, seed ORDER BY sha256(seed || '|' || corpus || '|plain|' || grp), grp) AS rk FROM grps, seeds)
SELECT corpus, seed, grp, rk <= {_cut('0.7')} AS "first" FROM r""")
def partition_groups(spark, d):
    groups = splits.with_seeds(split_items(spark, d).where("label IS NOT NULL").select("corpus", "grp").distinct(), SEEDS)
    out = splits.partition_groups(groups, ["corpus", "seed"], 0.7, [F.col("seed"), F.col("corpus"), "plain"])
    return out.select("corpus", F.col("seed"), "grp", "first")


@query("side_assignments", f"WITH {ASSIGN_SQL} SELECT * FROM asg")
def side_assignments(spark, d):
    return splits.side_assignments(split_items(spark, d), SEEDS)


IN_DOMAIN_SQL = f"""{GROUPS_SQL},
r0 AS (SELECT corpus, seed, grp, count(*) OVER (PARTITION BY corpus, seed) AS n,
  row_number() OVER (PARTITION BY corpus, seed ORDER BY sha256(seed || '|' || corpus || '|in_domain|' || grp), grp) AS rk FROM grps, seeds),
s0 AS (SELECT corpus, seed, grp, CASE WHEN rk <= {_cut('0.5')} THEN 'source' ELSE 'target' END AS side FROM r0),
r1 AS (SELECT corpus, seed, side, grp, count(*) OVER (PARTITION BY corpus, seed, side) AS n,
  row_number() OVER (PARTITION BY corpus, seed, side ORDER BY sha256(seed || '|' || corpus || '|in_domain_' || side || '|' || grp), grp) AS rk FROM s0)
SELECT corpus, seed, grp, {ROLE_CASE} FROM r1"""


@query("in_domain_split", f"WITH {IN_DOMAIN_SQL}")
def in_domain_split(spark, d):
    return splits.in_domain_assignments(split_items(spark, d), SEEDS)


@query("assign_roles", f"""WITH {ASSIGN_SQL} SELECT i.item_id, i.corpus, i.grp, i.label, a.seed, a.role
FROM split_item i JOIN asg a ON a.corpus = i.corpus AND a.grp = i.grp WHERE i.label IS NOT NULL""")
def assign_roles(spark, d):
    it = split_items(spark, d)
    return splits.assign_roles(it, splits.side_assignments(it, SEEDS)).select("item_id", "corpus", "grp", "label", "seed", "role")


def _rows(spark, d):
    return splits.pair_split(split_items(spark, d), LANGS, SEEDS)


@query("pair_split", f"WITH {PAIR_SQL} SELECT split_id, source, target, seed, role, item_id, grp FROM rows_")
def pair_split(spark, d):
    return _rows(spark, d).select("split_id", "source", "target", "seed", "role", "item_id", "grp")


@query("split_sizes", f"""WITH {PAIR_SQL} SELECT source, target, seed, role, count(*) AS n_items, count(DISTINCT grp) AS n_groups
FROM rows_ GROUP BY ALL""")
def split_sizes(spark, d):
    return splits.split_summary(_rows(spark, d))


@query("split_ranges", f"""WITH {PAIR_SQL}, s AS (SELECT source, target, seed, role, count(*) AS n FROM rows_ GROUP BY ALL)
SELECT source, target, role, min(n) AS min_items, max(n) AS max_items FROM s GROUP BY ALL""")
def split_ranges(spark, d):
    s = splits.split_summary(_rows(spark, d))
    return s.groupBy("source", "target", "role").agg(F.min("n_items").alias("min_items"), F.max("n_items").alias("max_items"))


SIZE_SQL = """size AS (SELECT source, target, seed, count(*) AS n FROM rows_ WHERE role = 'source_train' GROUP BY ALL),
caps AS (SELECT a.*, least(a.n, b.n) AS cap FROM size a JOIN size b ON b.source = a.target AND b.target = a.source AND b.seed = a.seed)"""
QUOTA_SQL = f"""{SIZE_SQL},
cc AS (SELECT r.source, r.target, r.seed, label, count(*) AS n, any_value(cap) AS cap FROM rows_ r
  JOIN caps c ON c.source = r.source AND c.target = r.target AND c.seed = r.seed
  WHERE role = 'source_train' GROUP BY r.source, r.target, r.seed, label),
ex AS (SELECT *, CAST(n * cap AS DOUBLE) / sum(n) OVER (PARTITION BY source, target, seed) AS e FROM cc),
fl AS (SELECT *, floor(e) AS f FROM ex),
q AS (SELECT *, CAST(f + CASE WHEN row_number() OVER (PARTITION BY source, target, seed ORDER BY e - f DESC, label)
    <= cap - sum(f) OVER (PARTITION BY source, target, seed) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)"""


@query("matched_caps", f"WITH {PAIR_SQL}, {SIZE_SQL} SELECT source, target, seed, n, cap FROM caps")
def matched_caps(spark, d):
    return splits.matched_caps(_rows(spark, d))


@query("quota", f"WITH {PAIR_SQL}, {QUOTA_SQL} SELECT source, target, seed, label, n, cap, quota FROM q")
def quota(spark, d):
    rows = _rows(spark, d)
    keys = ["source", "target", "seed"]
    counts = rows.where("role = 'source_train'").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    caps = splits.matched_caps(rows).select(*keys, "cap")
    return splits.quota(counts.join(caps, keys), keys, "label", "cap").select(*keys, "label", "n", "cap", "quota")


@query("match_n", f"""WITH {PAIR_SQL}, {QUOTA_SQL},
rk AS (SELECT r.*, row_number() OVER (PARTITION BY r.source, r.target, r.seed, r.label
   ORDER BY sha256(r.seed || '|' || r.source || '|' || r.target || '|matched_source_train|' || r.item_id), r.item_id) AS k
  FROM rows_ r WHERE role = 'source_train')
SELECT rk.source, rk.target, rk.seed, role, item_id, rk.label FROM rk
JOIN q ON q.source = rk.source AND q.target = rk.target AND q.seed = rk.seed AND q.label = rk.label WHERE k <= quota
UNION ALL SELECT source, target, seed, role, item_id, label FROM rows_ WHERE role <> 'source_train'""")
def match_n(spark, d):
    return splits.match_n(_rows(spark, d)).select("source", "target", "seed", "role", "item_id", "label")


@query("too_few_groups", f"""WITH {SPLIT_ITEM_SQL} SELECT corpus, count(DISTINCT grp) AS n_groups FROM split_item
WHERE label IS NOT NULL GROUP BY corpus HAVING count(DISTINCT grp) < 1000""")
def too_few_groups(spark, d):
    return splits.too_few_groups(split_items(spark, d), 1000)


# ---- leakage ---------------------------------------------------------------
PLANTED_SQL = f"""{PAIR_SQL},
bad AS (SELECT split_id, role, corpus, grp, item_id FROM rows_ WHERE NOT (split_id = 'de-es-s0' AND role = 'source_val')
  UNION ALL SELECT split_id, 'target_test', corpus, grp, item_id FROM rows_ WHERE role = 'source_train' AND item_id % 97 = 0),
fit AS (SELECT split_id, item_id FROM rows_ WHERE item_id % 101 = 0 UNION SELECT 'de-en-s0', -1),
v AS (
  SELECT split_id, 'group_in_two_roles' AS kind, corpus || '/' || grp AS subject FROM bad GROUP BY split_id, corpus, grp HAVING count(DISTINCT role) > 1
  UNION ALL SELECT split_id, 'item_on_both_sides', CAST(item_id AS VARCHAR) FROM bad GROUP BY split_id, item_id
    HAVING count(DISTINCT role LIKE 'source%') > 1
  UNION ALL SELECT s.split_id, 'empty_role', r FROM (SELECT DISTINCT split_id FROM bad) s,
    (SELECT unnest({sql_list(splits.ROLES)}) AS r) WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.split_id = s.split_id AND b.role = r)
  UNION ALL SELECT f.split_id, 'fit_on_held_out', CAST(f.item_id AS VARCHAR) FROM fit f
    WHERE EXISTS (SELECT 1 FROM bad b WHERE b.split_id = f.split_id AND b.item_id = f.item_id AND role = 'target_test')
  UNION ALL SELECT f.split_id, 'fit_outside_split', CAST(f.item_id AS VARCHAR) FROM fit f
    WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.split_id = f.split_id AND b.item_id = f.item_id))"""


def planted(rows):
    """A dropped role and source items copied to the held-out role."""
    keep = rows.where(~((F.col("split_id") == "de-es-s0") & (F.col("role") == "source_val")))
    moved = rows.where((F.col("role") == "source_train") & (F.col("item_id") % 97 == 0)).withColumn("role", F.lit("target_test"))
    return keep.unionByName(moved)


@query("leakage_planted", f"WITH {PLANTED_SQL} SELECT * FROM v")
def leakage_planted(spark, d):
    rows = _rows(spark, d)
    fit = rows.where(F.col("item_id") % 101 == 0).select("split_id", "item_id").distinct()
    fit = fit.union(spark.createDataFrame([("de-en-s0", -1)], "split_id string, item_id bigint"))
    return leak.leakage(planted(rows), fit)


@query("leakage_clean", f"""WITH {PAIR_SQL} SELECT split_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM rows_ GROUP BY split_id""")
def leakage_clean(spark, d):
    rows = _rows(spark, d)
    bad = leak.leakage(rows).groupBy("split_id").agg(F.count(F.lit(1)).alias("v"))
    sizes = rows.groupBy("split_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.join(bad, "split_id", "left").select("split_id", "n_rows", F.coalesce("v", F.lit(0)).alias("n_violations"))


@query("offenders", f"WITH {PLANTED_SQL} SELECT * FROM v ORDER BY split_id, kind, subject LIMIT 5")
def offenders(spark, d):
    return leak.offenders(leakage_planted(spark, d), ["split_id", "kind", "subject"], 5)


@query("unassigned", f"""WITH {PAIR_SQL} SELECT item_id, corpus FROM split_item WHERE label IS NOT NULL
AND item_id NOT IN (SELECT item_id FROM rows_ WHERE role = 'source_train' AND seed = 0)""")
def unassigned(spark, d):
    rows = _rows(spark, d).where("role = 'source_train' AND seed = 0")
    return leak.unassigned(split_items(spark, d), rows).select("item_id", "corpus")


_TERM = "sum(CASE WHEN tp <= 0 THEN 0 WHEN sp <= 0 THEN 'Infinity'::DOUBLE ELSE sp * ln(sp / tp) END)"


@query("split_report", f"""WITH {PAIR_SQL}, cls AS (SELECT unnest({sql_list(SPACE)}) AS label),
p AS (SELECT k.source, k.target, k.seed, c.label,
   (SELECT count(*) FROM rows_ r WHERE r.split_id = k.split_id AND r.role = 'source_train' AND r.label = c.label)::DOUBLE
    / (SELECT count(*) FROM rows_ r WHERE r.split_id = k.split_id AND r.role = 'source_train') AS sp,
   (SELECT count(*) FROM rows_ r WHERE r.split_id = k.split_id AND r.role = 'target_test' AND r.label = c.label)::DOUBLE
    / (SELECT count(*) FROM rows_ r WHERE r.split_id = k.split_id AND r.role = 'target_test') AS tp
  FROM (SELECT DISTINCT split_id, source, target, seed FROM rows_) k, cls c),
kl AS (SELECT source, target, seed, sum(CASE WHEN sp <= 0 THEN 0 WHEN tp <= 0 THEN 'Infinity'::DOUBLE ELSE sp * ln(sp / tp) END) AS kl FROM p GROUP BY ALL)
SELECT source, target, count(*) AS n_seeds, {sql_r9('avg(kl)')} AS kl_mean, {sql_r9('min(kl)')} AS kl_min,
{sql_r9('max(kl)')} AS kl_max, {sql_r9('max(kl) - min(kl)')} AS kl_spread FROM kl GROUP BY ALL""")
def split_report(spark, d):
    """Realised prior shift of every pair, with its spread over seeds."""
    keys = ["source", "target", "seed"]
    vec = priors.prior_vector(_rows(spark, d), SPACE, [*keys, "role"])
    # The role is pivoted inside one aggregate: no join between the two sides.
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("p")))
    both = vec.groupBy(*keys).agg(side("source_train").alias("sp"), side("target_test").alias("tp"))
    kl = both.select(*keys, priors.kl_vec(F.col("sp"), F.col("tp")).alias("kl"))
    return kl.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n_seeds"), r9(F.avg("kl")).alias("kl_mean"), r9(F.min("kl")).alias("kl_min"),
        r9(F.max("kl")).alias("kl_max"), r9(F.max("kl") - F.min("kl")).alias("kl_spread"),
    )


@query("coverage_split", f"""WITH {SPLIT_ITEM_SQL}, cells AS (SELECT DISTINCT corpus, grp, label FROM split_item WHERE label IS NOT NULL),
g AS (SELECT DISTINCT corpus, grp FROM cells), s AS (SELECT unnest(range(64)) AS seed),
r AS (SELECT corpus, seed, grp, count(*) OVER (PARTITION BY corpus, seed) AS n,
  row_number() OVER (PARTITION BY corpus, seed ORDER BY sha256(seed || '|' || corpus || '|coverage|' || grp), grp) AS rk FROM g, s),
parts AS (SELECT corpus, seed, grp, rk <= {_cut('0.9')} AS f FROM r),
cov AS (SELECT p.corpus, seed, count(DISTINCT label) AS nl FROM parts p JOIN cells c ON c.corpus = p.corpus AND c.grp = p.grp WHERE NOT f GROUP BY ALL),
pick AS (SELECT corpus, arg_min(seed, (-nl, seed)) AS seed FROM cov GROUP BY corpus)
SELECT p.corpus, p.seed, p.grp, CASE WHEN f THEN 'train' ELSE 'test' END AS role FROM parts p JOIN pick k ON k.corpus = p.corpus AND k.seed = p.seed""")
def coverage_split(spark, d):
    return splits.coverage_split(split_items(spark, d), 0.9).withColumn("seed", F.col("seed").cast("long"))


@query("group_key", """SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE role END AS grp FROM conversations""")
def group_key(spark, d):
    from .registry import table

    t = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "iemocap").otherwise("other").alias("corpus"),
        F.when(F.col("conv_id") % 3 != 0, F.col("conv_id").cast("string")).otherwise("").alias("session_id"),
        F.col("role").alias("speaker_id"),
    )
    return t.select("conv_id", "turn", splits.group_key().alias("grp"))
