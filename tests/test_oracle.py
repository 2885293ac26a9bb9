"""Every query with an SQL statement gives the same rows as DuckDB; the others give rows."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Model fits take minutes on every scale; tests/test_models.py covers them on fixtures.
SLOW = {"fit_select", "run_cells", "check_conditions", "shift_report", "alpha_sweep"}
# Legitimately empty on the smallest scale.
MAY_BE_EMPTY = {"label_set_difference", "duplicates", "dup_slots", "collapsed", "verify_ids", "dup_titles", "axis_argmax"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert got in ("", "EMPTY") if name in MAY_BE_EMPTY else got == "", got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_an_adequate_subset_has_no_failed_check(spark, tmp_path):
    import duckdb

    rows = [(i, 0, ("assistant", "user")[i % 2]) for i in range(600)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = QUERIES["subset_decision"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("free", "")]
    assert compare(got, own, SQL["subset_decision"]) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 2 and all(r["macro_f1"] > r["chance_macro_f1"] for r in rows)
