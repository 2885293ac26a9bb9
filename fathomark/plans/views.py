"""The given tables seen as predictions, items, ledger rows and vectors.

Each view exists twice, as a DataFrame and as a SQL common table expression, with
the same expressions. The data holds no signal, so hit rates are planted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
# "refund" never occurs: it separates the two macro-F1 variants.
CLASSES = ("click", "error", "purchase", "refund", "signup", "view")
FLAGS = ("A", "N", "R")
LANGS = ("de", "en", "es", "fr")
QUALITY = ("0-0", "0-1", "1-0", "1-1")
SPACE = ("bad", "good", "toxic")
SEEDS = (0, 1, 2)
RUNGS = ("none", "zscore", "mean_shift", "coral", "mkmmd_diag")
FAMILIES = ("logreg", "svm_linear", "svm_rbf", "mlp")


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def values_sql(name: str, column: str, values) -> str:
    return f"{name} AS (SELECT unnest({sql_list(values)}) AS {column})"


def lookup(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# ---- events as predictions -------------------------------------------------
PRED_SQL = f"""pred AS (
  SELECT event_id AS item_id, user_id AS grp, user_id % 2 AS domain, event_id % 5 AS seed, event_type AS y_true,
         CASE WHEN event_id % 10 < 6 THEN event_type
              ELSE ({sql_list(EVENT_TYPES)})[event_id % 5 + 1] END AS y_pred
  FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    guess = lookup(EVENT_TYPES, F.col("event_id") % 5)
    return e.select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("grp"),
        (F.col("user_id") % 2).alias("domain"),
        (F.col("event_id") % 5).alias("seed"),
        F.col("event_type").alias("y_true"),
        F.when(F.col("event_id") % 10 < 6, F.col("event_type")).otherwise(guess).alias("y_pred"),
    )


# ---- line items as predictions of two arms ---------------------------------
LINE_SQL = f"""line AS (
  SELECT l_orderkey * 10 + l_linenumber AS item_id, l_suppkey AS grp, l_orderkey % 3 AS seed,
         l_linestatus AS cond, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS arm,
         l_returnflag AS y_true,
         CASE WHEN (l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 10
                   < (CASE WHEN l_linenumber % 2 = 0 THEN 7 ELSE 6 END) THEN l_returnflag
              ELSE ({sql_list(FLAGS)})[(l_orderkey + l_partkey) % 3 + 1] END AS y_pred
  FROM lineitem)"""


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    arm_a = F.col("l_linenumber") % 2 == 0
    hit = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber")) % 10 < F.when(
        arm_a, F.lit(7)
    ).otherwise(F.lit(6))
    guess = lookup(FLAGS, (F.col("l_orderkey") + F.col("l_partkey")) % 3)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_suppkey").alias("grp"),
        (F.col("l_orderkey") % 3).alias("seed"),
        F.col("l_linestatus").alias("cond"),
        F.when(arm_a, "a").otherwise("b").alias("arm"),
        F.col("l_returnflag").alias("y_true"),
        F.when(hit, F.col("l_returnflag")).otherwise(guess).alias("y_pred"),
    )


# ---- documents as the item manifest ----------------------------------------
ITEM_SQL = """item AS (
  SELECT d.doc_id AS item_id, d.lang AS corpus, d.source AS grp, d.n_chars / 100.0::DOUBLE AS duration_s,
         CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality || '-' || l.toxic END AS raw
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.concat_ws("-", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("raw"),
    )
    base = d.select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("corpus"), F.col("source").alias("grp"),
        (F.col("n_chars") / F.lit(100.0)).alias("duration_s"),
    )
    return base.join(lab, "item_id", "left")


# Rules: 1-0 is good, 0-0 bad, toxic rows excluded in 'two' and kept in 'three';
# en/0-1 is left out on purpose, so one raw label has no rule.
RULES = tuple(
    (lang, raw, space, mapped)
    for lang in LANGS
    for raw, in_two, in_three in (("0-0", "bad", "bad"), ("0-1", None, "toxic"), ("1-0", "good", "good"), ("1-1", None, "toxic"))
    for space, mapped in (("two", in_two), ("three", in_three))
    if not (lang == "en" and raw == "0-1")
)
RULES_SQL = "rules(corpus, raw, space, mapped) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}', {})".format(c, r, s, f"'{m}'" if m else "NULL") for c, r, s, m in RULES
) + ")"
LABELLED_SQL = f"""{ITEM_SQL}, {RULES_SQL}, labelled AS (
  SELECT item.*, r.mapped AS label, r.raw IS NOT NULL AS known
  FROM item LEFT JOIN rules r ON r.corpus = item.corpus AND r.raw = item.raw AND r.space = 'three')"""


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "corpus string, raw string, space string, mapped string")


# Splits need every group of every corpus labelled, so their label comes from the key.
SPLIT_ITEM_SQL = """split_item AS (
  SELECT doc_id AS item_id, lang AS corpus, source AS grp,
         CASE WHEN doc_id % 7 = 6 THEN NULL ELSE ['bad', 'good', 'toxic'][n_chars % 3 + 1] END AS label
  FROM documents)"""


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("corpus"), F.col("source").alias("grp"),
        F.when(F.col("doc_id") % 7 != 6, lookup(SPACE, F.col("n_chars") % 3)).alias("label"),
    )


# ---- orders as the run ledger ----------------------------------------------
LEDGER_SQL = f"""ledger AS (
  SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS run_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'north' ELSE 'south' END AS source,
    CASE WHEN o_orderkey % 2 = 0 THEN 'south' ELSE 'north' END AS target,
    ({sql_list(RUNGS)})[CAST(substr(o_orderpriority, 1, 1) AS BIGINT)] AS alignment,
    ({sql_list(FAMILIES)})[o_custkey % 4 + 1] AS classifier,
    'bb' || (o_orderkey % 3) AS backbone, o_orderkey % 13 AS layer_index, o_custkey % 5 AS seed,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 4) / 10.0::DOUBLE END AS alignment_eps,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey % 5) / 5.0::DOUBLE END AS alignment_lambda,
    CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'ok' END AS status,
    'freeze-v' || (o_orderkey % 3) AS freeze_tag, 7 + o_orderkey % 3 AS schema_version,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0::DOUBLE END AS val,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE END AS test,
    (CAST(floor(o_totalprice) AS BIGINT) % 97) / 10.0::DOUBLE AS mmd_own, ((o_orderkey * 104729) % 89) / 10.0::DOUBLE AS mmd_ref,
    o_totalprice / 1000 AS wall_seconds,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1001 END AS solver_n_iter,
    o_custkey % 3 = 0 AS fallback, '{{"selected":{{"C":' || (o_custkey % 3) || '}},"n_failed":' || (o_orderkey % 4) || '}}' AS hyperparams_json
  FROM orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = F.floor("o_totalprice").cast("long")
    failed = F.col("o_orderstatus") == "P"
    even = k % 2 == 0
    ints = lambda e: e.cast("double")
    return o.select(
        k, F.substring(F.sha2(k.cast("string"), 256), 1, 16).alias("run_id"),
        F.when(even, "north").otherwise("south").alias("source"),
        F.when(even, "south").otherwise("north").alias("target"),
        lookup(RUNGS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("alignment"),
        lookup(FAMILIES, c % 4).alias("classifier"),
        F.concat(F.lit("bb"), (k % 3).cast("string")).alias("backbone"),
        (k % 13).alias("layer_index"), (c % 5).alias("seed"),
        F.when(k % 11 != 0, ints(k % 4) / 10.0).alias("alignment_eps"),
        F.when(k % 17 != 0, ints(c % 5) / 5.0).alias("alignment_lambda"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("freeze-v"), (k % 3).cast("string")).alias("freeze_tag"),
        (k % 3 + 7).alias("schema_version"),
        F.when(~failed, ints(price % 1000) / 1000.0).alias("val"),
        F.when(~failed, ints((k * 7919) % 1000) / 1000.0).alias("test"),
        (ints(price % 97) / 10.0).alias("mmd_own"), (ints((k * 104729) % 89) / 10.0).alias("mmd_ref"),
        (F.col("o_totalprice") / 1000).alias("wall_seconds"),
        F.when(k % 5 != 0, k % 1001).alias("solver_n_iter"),
        (c % 3 == 0).alias("fallback"),
        F.concat(
            F.lit('{"selected":{"C":'), (c % 3).cast("string"), F.lit('},"n_failed":'),
            (k % 4).cast("string"), F.lit("}"),
        ).alias("hyperparams_json"),
    )


def ok_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where(F.col("status") == "ok")


OK_SQL = f"{LEDGER_SQL}, ok_rows AS (SELECT * FROM ledger WHERE status = 'ok')"


# ---- embeddings as feature vectors -----------------------------------------
VEC_SQL = """vec AS (
  SELECT vec_id AS item_id, vec_id % 2 AS domain, vec_id % 20 AS grp, label,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
DIM_SQL = f"""{VEC_SQL}, dims AS (
  SELECT item_id, domain, grp, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM vec)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item_id"), (F.col("vec_id") % 2).alias("domain"),
        (F.col("vec_id") % 20).alias("grp"), F.col("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
