import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomark.functions.hashing import digest_rows, draw_hash
from fathomark.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, and one value with a third of the values."""
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 3 == 1, 7.5).otherwise((F.col("id") * 7919 % 1013) / 10.0).alias("x"),
    ).cache()


def test_hash_rank_is_row_number(skewed):
    h = skewed.withColumn("h", draw_hash("t", F.col("id")))
    got = rk.hash_rank(h, ["k"], "h", ["id"], "r")
    want = h.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("h", "id"))).select("id", "w")
    assert got.join(want, "id").where("r <> w").count() == 0
    assert got.count() == 6000


def test_hash_top_both_routes(skewed):
    h = skewed.withColumn("h", draw_hash("t", F.col("id")))
    big = {r.id for r in rk.hash_top(h, ["k"], "h", 1500, ["id"]).collect()}
    want = h.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("h", "id"))).where("w <= 1500")
    assert big == {r.id for r in want.collect()}
    assert rk.hash_top(h, [], "h", 17, ["id"]).count() == 17


def test_exact_quantiles(skewed):
    got = {r.k: r for r in rk.exact_quantiles(skewed, ["k"], "x", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()}
    pdf = skewed.toPandas()
    for k, part in pdf.groupby("k"):
        want = np.quantile(part["x"], [0.025, 0.5, 0.975])
        assert np.allclose([got[k].lo, got[k].mid, got[k].hi], want)


def test_ordered_rank(skewed):
    got = rk.ordered_rank(skewed, ["k"], F.floor(F.col("id") / 500), ["id"], "r")
    want = skewed.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("id"))).select("id", "w")
    assert got.join(want, "id").where("r <> w").count() == 0


def test_holm_known_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double")
    got = {r.n: (round(r.holm, 9), r.reject) for r in rk.holm(df, "p").collect()}
    assert got == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}


def test_tolerant_rank_shares_rank(spark):
    df = spark.createDataFrame([(1.0,), (1.005,), (1.5,), (1.6,)], "v double")
    assert [r["rank"] for r in rk.tolerant_rank(df, [], "v").orderBy("v").collect()] == [1, 1, 3, 4]


def test_spearman_ordinal_and_short(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 2.0), (2, 3.0, 3.0)], "o int, x double, y double")
    assert rk.spearman(df, [], "x", "y", ["o"]).first()["rho"] == pytest.approx(1.0)
    assert rk.spearman(df.where("o < 2"), [], "x", "y", ["o"]).first()["rho"] is None


def test_digest_ignores_partitioning_but_not_content(spark):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("v"))
    one = lambda d: digest_rows(d, [], F.concat_ws("|", F.col("id").cast("string"), "v")).first()["digest"]
    assert one(df) == one(df.repartition(13, "v"))
    assert one(df) != one(df.where("id <> 3"))
    assert one(df) != one(df.withColumn("v", F.when(F.col("id") == 3, "x").otherwise(F.col("v"))))
