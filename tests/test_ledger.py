import gzip
import json

import pytest
from pyspark.sql import functions as F

from fathomark.functions.hashing import run_id
from fathomark.operators import grid, ledger as led, matching as mt
from fathomark.sources import ledger_io as io


def full_row(**over):
    row = {f.name: None for f in led.FIELDS}
    for f in led.FIELDS:
        if not f.nullable:
            row[f.name] = {"string": "x", "bigint": 1, "boolean": False, "double": 1.0, "array<string>": ["a"]}[f.kind]
    row.update(schema_version=9, status="ok", macro_f1=0.5, **over)
    return row


def ledger(spark, *rows):
    schema = led.ledger_schema()
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def test_schema_has_63_fields():
    assert len({f.name for f in led.FIELDS}) == 63 and len(led.RUN_COORDINATES) == 19


@pytest.mark.parametrize("over,rule", [
    ({"schema_version": 8}, "schema_version"), ({"status": "maybe"}, "status"), ({"run_id": None}, "null run_id"),
    ({"status": "failed", "error": ""}, "failed without error"), ({"macro_f1": None}, "ok without macro_f1"), ({"n_classes": 4}, "n_classes"),
])
def test_each_rule_is_alive(spark, over, rule):
    row = full_row()
    row.update(over)
    got = {r.rule for r in led.violations(ledger(spark, row), led.ledger_rules(), ["run_id"]).collect()}
    assert rule in got
    assert led.violations(ledger(spark, full_row()), led.ledger_rules(), ["run_id"]).count() == 0


def test_append_read_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert io.read_ledger(spark, path).count() == 0
    io.append_ledger(ledger(spark, full_row(run_id="r1")), path)
    io.append_ledger(ledger(spark, full_row(run_id="r2")), path)
    with pytest.raises(io.LedgerError):
        bad = full_row(run_id="r3")
        bad["status"] = "odd"
        io.append_ledger(ledger(spark, bad), path)
    with pytest.raises(io.LedgerError):
        io.append_ledger(ledger(spark, full_row()).drop("seed"), path)
    (tmp_path / "runs" / "broken.json").write_text("{not json\n")
    got = io.read_ledger(spark, path)
    assert {r.run_id for r in got.where("run_id IS NOT NULL").collect()} == {"r1", "r2"}
    bad = io.bad_lines(got).collect()
    assert len(bad) == 1 and bad[0]["source_file"].endswith("broken.json")


def test_conform_fills_and_refuses(spark):
    base = ledger(spark, full_row()).drop("error", "epochs_run", "status", "schema_version")
    out = led.conform(base)
    assert led.schema_problems(out) == [] and out.first()["status"] == "ok"
    with pytest.raises(ValueError):
        led.conform(base.withColumn("new", F.lit(1)))
    with pytest.raises(ValueError):
        led.conform(base.drop("seed"))


def test_migration_chain_and_identity(spark):
    df = spark.createDataFrame([("a", 6, None), ("b", 7, "z"), ("c", 8, "q")], "run_id string, schema_version bigint, note string")
    steps = [led.Migration(6, lambda d: d.withColumn("note", F.lit("from6")), ["note"]), led.Migration(7, lambda d: d.withColumn("note", F.concat("note", F.lit("+7"))), ["note"])]
    got = {r.run_id: (r.schema_version, r.note) for r in led.migrate(df, steps, 8).collect()}
    assert got == {"a": (8, "from6+7"), "b": (8, "z+7"), "c": (8, "q")}
    with pytest.raises(led.IdentityChanged):
        led.migrate(df, [led.Migration(6, lambda d: d, ["seed"])], 8)


def test_run_id_depends_on_every_coordinate_and_null(spark):
    df = spark.createDataFrame([(1, None), (1, 0.0), (2, None)], "seed int, eps double")
    ids = [r[0] for r in df.select(run_id(["seed", "eps"])).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 16 for i in ids)
    assert ids[0] == df.select(run_id(["eps", "seed"])).first()[0]


def test_empty_tag_is_an_error(spark):
    with pytest.raises(led.EmptySelection):
        led.select_tag(spark.createDataFrame([("a",)], "freeze_tag string"), "b")


def test_merge_ignores_volatile_and_reports_conflict(spark):
    df = spark.createDataFrame(
        [("a", 1, "f1", 1.0), ("a", 1, "f2", 2.0), ("b", 1, "f1", 1.0), ("b", 2, "f2", 1.0), ("c", None, "f1", 1.0), ("c", None, "f1", 3.0)],
        "run_id string, x int, file string, wall_seconds double")
    vol = ("file", "wall_seconds")
    assert {r.run_id for r in led.merge_conflicts(df, ["run_id"], vol).collect()} == {"b"}
    got = {r.run_id: r for r in led.merge_shards(df, ["run_id"], ["file", "wall_seconds"], vol).collect()}
    assert set(got) == {"a", "c"} and got["a"]["file"] == "f1" and got["a"]["n_rows"] == 2
    done = spark.createDataFrame([("a",)], "run_id string")
    assert {r.run_id for r in led.merge_shards(df, ["run_id"], ["file"], vol, done).collect()} == {"c"}


def test_agreement_tolerance(spark):
    a = spark.createDataFrame([("r", 1.0, "x", None)], "run_id string, f double, s string, n int")
    b = spark.createDataFrame([("r", 1.0 + 1e-13, "x", None)], "run_id string, f double, s string, n int")
    assert led.agreement(a, b, ["run_id"]).count() == 0
    c = b.withColumn("f", F.lit(1.0 + 1e-9)).withColumn("n", F.lit(3))
    assert {r.field for r in led.agreement(a, c, ["run_id"]).collect()} == {"f", "n"}


def test_match_arms_fails_closed(spark):
    rows = [
        ("r1", "none", None, "ok", 0.5, 0.6), ("r2", "mean_shift", None, "ok", 0.5, 0.7),  # clean, null key
        ("r3", "none", 1, "ok", 0.5, 0.6),  # missing arm
        ("r4", "none", 2, "ok", 0.5, 0.6), ("r5", "none", 2, "ok", 0.5, 0.6), ("r6", "mean_shift", 2, "ok", 0.5, 0.6),  # duplicate
        ("r7", "none", 3, "failed", None, None), ("r8", "mean_shift", 3, "ok", 0.5, 0.6),
        ("r9", "none", 4, "ok", float("nan"), 0.1), ("ra", "mean_shift", 4, "ok", 0.5, 0.6),
    ]
    df = spark.createDataFrame(rows, "run_id string, alignment string, k int, status string, val double, test double").withColumn("hyperparams_json", F.lit('{"selected":{"C":1}}'))
    m = mt.match_arms(df, ["k"], "alignment", "none", "mean_shift", ["run_id", "val", "test", "hyperparams_json"])
    got = {r.k: r.problem for r in m.collect()}
    assert got == {None: None, 1: "missing arm", 2: "duplicate arm", 3: "incomplete", 4: "non-finite score"}
    flag = mt.equality_flags(m).first()
    assert flag["validation_equal"] and flag["params_equal"] and flag["target_difference"] == pytest.approx(0.1)


def test_grid_variants_and_blends(spark):
    g = grid.enumerate_grid(
        spark.range(1).drop("id"), {"alignment": (("none", "coral", "mkmmd_full"), "string"), "seed": ((0, 1), "int")},
        [("alignment", grid.alignment_variants([0.1, 1.0], [0.5]), {"alignment_eps": "double", "ledoit_wolf": "boolean", "alignment_lambda": "double"})],
        (F.col("alignment") == "none") & (F.col("seed") == 1))
    assert g.count() == 1 + 2 * 3 + 2 * 1
    assert grid.blend_variants("zscore", ("none", "scalar"), (0.5,), 4) == [{"blending": "none"}]
    assert len(grid.blend_variants("coral", ("none", "scalar", "gaa"), (0.25, 0.5), 4)) == 4


def test_predictions_conf_and_vectors(spark, tmp_path):
    p = spark.createDataFrame([("r1", str(i), "a" if i % 2 else "b") for i in range(25)] + [("r2", "9", "a")], "run_id string, item_id string, y_pred string")
    path = str(tmp_path / "pred")
    io.write_predictions(p, path, chunk=10)
    assert io.read_predictions(spark, path).exceptAll(p).count() == 0 and io.read_predictions(spark, path).count() == 26
    assert io.ragged_predictions(spark, path).count() == 0

    conf = spark.createDataFrame([("r1", "g", [1, 0, 2, 3])], "run_id string, grp string, cells array<bigint>")
    cpath = str(tmp_path / "conf")
    io.write_conf(conf, cpath, ("a", "b"))
    assert io.read_conf(spark, cpath, ("a", "b")).first()["cells"] == [1, 0, 2, 3]
    with pytest.raises(io.LedgerError):
        io.read_conf(spark, cpath, ("a", "c"))
    with pytest.raises(io.LedgerError):
        io.write_conf(conf, cpath + "2", ("a", "b", "c"))

    items = spark.createDataFrame([("i1", "s1"), ("i2", "s2")], "item_id string, sha256 string")
    key = io.vectors_key(items)
    assert key == io.vectors_key(items.orderBy(F.desc("item_id"))) != io.vectors_key(items.where("item_id = 'i1'"))
    vecs = spark.createDataFrame([("i1", [1.0])], "item_id string, v array<float>")
    assert not io.has_vectors(spark, str(tmp_path), key)
    io.write_vectors(vecs, str(tmp_path), key)
    assert io.has_vectors(spark, str(tmp_path), key)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_vectors(vecs, str(tmp_path), key)
    assert io.read_vectors(spark, str(tmp_path), key).schema["v"].dataType.simpleString() == "array<double>"


def test_union_prefers_canonical(spark, tmp_path):
    main, shard = str(tmp_path / "main"), str(tmp_path / "shard")
    io.append_ledger(ledger(spark, full_row(run_id="s1")), shard)
    assert {r.origin for r in io.read_union(spark, main, [shard]).collect()} == {"shards"}
    io.append_ledger(ledger(spark, full_row(run_id="m1")), main)
    assert {(r.run_id, r.origin) for r in io.read_union(spark, main, [shard]).collect()} == {("m1", "canonical")}
    with pytest.raises(io.LedgerError):
        io.read_union(spark, str(tmp_path / "x"), [str(tmp_path / "y")])


def test_ledger_files_are_gzipped_and_bounded(spark, tmp_path):
    path, plain = tmp_path / "ledger", tmp_path / "ledger" / "plain.json"
    rows = ledger(spark, full_row()).drop("run_id").join(spark.range(200).select(F.col("id").cast("string").alias("run_id"))).select(*led.ledger_schema().names)
    io.append_ledger(rows.coalesce(1), str(path), file_rows=50)
    files = list(path.glob("part-*"))
    assert len(files) == 4 and all(f.name.endswith(".json.gz") for f in files)
    lines = [gzip.decompress(f.read_bytes()).decode().splitlines() for f in files]
    assert [len(x) for x in lines] == [50] * 4 and set(json.loads(lines[0][0])) == set(led.ledger_schema().names)
    size = sum(len(line) + 1 for x in lines for line in x)
    assert 10 * sum(f.stat().st_size for f in files) < size
    # Plain files of older appends are read beside them.
    plain.write_text(lines[0][0].replace('"run_id":"', '"run_id":"old') + "\n")
    got = io.read_ledger(spark, str(path))
    assert {r.run_id[:3] == "old" for r in got.collect()} == {True, False} and got.count() == 201
    assert io.bad_lines(got).collect() == []
