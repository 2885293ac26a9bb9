import pytest
from pyspark.sql import functions as F

from fathomark.operators import leakage, splits

CORPORA, SEEDS = ("p", "q"), (0, 1, 2)


@pytest.fixture(scope="module")
def items(spark):
    """Corpus p is three times corpus q, and one group of p holds a third of its rows."""
    base = spark.range(4000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 4 < 3, "p").otherwise("q").alias("corpus"))
    grp = F.when(F.col("item_id") % 3 == 0, "g0").otherwise(F.concat(F.lit("g"), (F.col("item_id") % 17).cast("string")))
    lab = F.when(F.col("item_id") % 10 == 9, None).otherwise(F.get(F.array(*map(F.lit, "xyz")), (F.floor(F.col("item_id") / 7) % 3).cast("int")))
    return base.withColumn("grp", grp).withColumn("label", lab).cache()


@pytest.fixture(scope="module")
def rows(items):
    return splits.pair_split(items, CORPORA, SEEDS).cache()


def test_clean_split_has_no_violation(rows):
    assert leakage.leakage(rows).count() == 0
    leakage.assert_clean(leakage.leakage(rows))


def test_deterministic_under_repartition(items, rows):
    again = splits.pair_split(items.repartition(7, "item_id"), CORPORA, SEEDS)
    cols = ["split_id", "role", "item_id"]
    assert rows.select(*cols).exceptAll(again.select(*cols)).count() == 0


def test_in_domain_is_disjoint(items):
    a = splits.in_domain_assignments(items, SEEDS)
    r = splits.assign_roles(items, a).withColumn("split_id", F.concat_ws("-", "corpus", F.col("seed").cast("string")))
    assert leakage.leakage(r).count() == 0
    assert a.groupBy("corpus", "seed").agg(F.countDistinct("role").alias("n")).where("n <> 4").count() == 0


@pytest.mark.parametrize("kind", ["group_in_two_roles", "item_on_both_sides", "empty_role", "fit_on_held_out", "fit_outside_split"])
def test_each_check_is_alive(spark, rows, kind):
    fit = None
    if kind == "empty_role":
        bad = rows.where("NOT (split_id = 'p-q-s0' AND role = 'target_adapt')")
    elif kind.startswith("fit"):
        bad = rows
        held = rows.where("split_id = 'p-q-s0' AND role = 'target_test'").limit(1).select("split_id", "item_id")
        fit = held if kind == "fit_on_held_out" else spark.createDataFrame([("p-q-s0", -5)], "split_id string, item_id bigint")
    else:
        extra = rows.where("role = 'source_train'").orderBy("item_id").limit(1)
        to = "source_val" if kind == "group_in_two_roles" else "target_test"
        bad = rows.unionByName(extra.withColumn("role", F.lit(to)))
    got = {r.kind for r in leakage.leakage(bad, fit).collect()}
    assert kind in got
    with pytest.raises(leakage.LeakageError):
        leakage.assert_clean(leakage.leakage(bad, fit))


def test_matched_directions_and_proportions(rows):
    m = splits.match_n(rows)
    train = m.where("role = 'source_train'")
    sizes = {(r.source, r.seed): r["count"] for r in train.groupBy("source", "seed").count().collect()}
    assert all(sizes[("p", s)] == sizes[("q", s)] for s in SEEDS)
    share = lambda df: {(r.seed, r.label): r.n / r.t for r in df.where("source = 'p' AND role = 'source_train'").groupBy("seed", "label").agg(
        F.count("*").alias("n")).join(df.where("source = 'p' AND role = 'source_train'").groupBy("seed").agg(F.count("*").alias("t")), "seed").collect()}
    before, after = share(rows), share(m)
    assert all(abs(before[k] - after[k]) < 0.01 for k in before)
    assert leakage.group_in_two_roles(m).count() == 0
    other = lambda df: df.where("role <> 'source_train'").count()
    assert other(m) == other(rows)


def test_quota_hands_out_all(spark):
    c = spark.createDataFrame([(1, "a", 5, 7), (1, "b", 5, 7), (1, "c", 3, 7)], "k int, label string, n bigint, cap bigint")
    got = {r.label: r.quota for r in splits.quota(c, ["k"], "label", "cap").collect()}
    assert got == {"a": 3, "b": 3, "c": 1} or sum(got.values()) == 7
    assert sum(got.values()) == 7


def test_single_group_is_reported(spark):
    one = spark.createDataFrame([(1, "z", "g", "x")], "item_id bigint, corpus string, grp string, label string")
    assert splits.too_few_groups(one).first()["corpus"] == "z"
