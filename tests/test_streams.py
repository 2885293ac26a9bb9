from pyspark.sql import functions as F

from fathomark.streaming import jobs

SCHEMA = "run_id string, score double, wall_seconds double, ts timestamp"


def rows(spark, *r):
    return spark.createDataFrame([(a, b, c) for a, b, c in r], "run_id string, score double, wall_seconds double").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("wall_seconds")))


def test_ingest_drops_duplicates_across_files(spark, tmp_path):
    src = str(tmp_path / "in")
    run = lambda: jobs.ingest(jobs.file_stream(spark, src, SCHEMA, "parquet"), ["run_id"], "ts", "1 hour", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows(spark, ("a", 1.0, 0.0), ("b", 1.0, 1.0)).write.parquet(src)
    run()
    rows(spark, ("b", 1.0, 2.0), ("c", 1.0, 3.0)).write.mode("append").parquet(src)
    run()
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_running_counts_survive_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "grp int, y_true string, y_pred string"
    df = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (2, "b", "b")], schema)
    run = lambda: jobs.running_confusion(jobs.file_stream(spark, src, schema, "parquet"), ["grp"], out, str(tmp_path / "ck")).awaitTermination()
    df.write.parquet(src)
    run()
    df.where("grp = 1").write.mode("append").parquet(src)
    run()
    run()
    got = {(r.grp, r.y_true, r.y_pred): r.n for r in jobs.latest_counts(spark, out, ["grp"]).collect()}
    assert got == {(1, "a", "a"): 2, (1, "a", "b"): 2, (2, "b", "b"): 1}


def test_contradicting_batch_is_rejected(spark, tmp_path):
    src, out, rej = (str(tmp_path / n) for n in ("in", "out", "rej"))
    seen = []
    run = lambda: jobs.checked_append(jobs.file_stream(spark, src, SCHEMA, "parquet"), ["run_id"], out, rej, str(tmp_path / "ck"), ("wall_seconds", "ts"), lambda b, n: seen.append(n)).awaitTermination()
    rows(spark, ("a", 1.0, 0.0), ("b", 2.0, 0.0)).write.parquet(src)
    run()
    rows(spark, ("a", 1.0, 9.0), ("c", 3.0, 0.0)).write.mode("append").parquet(src)  # same result, other timing
    run()
    rows(spark, ("a", 7.0, 0.0), ("d", 4.0, 0.0)).write.mode("append").parquet(src)  # contradicts a
    run()
    assert sorted(r.run_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    assert sorted(r.run_id for r in spark.read.parquet(rej).collect()) == ["a", "d"] and seen == [1]


def test_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    """Folders without a key of the batch are not opened: broken files there do no harm."""
    src, out, rej = (str(tmp_path / n) for n in ("in", "out", "rej"))
    run = lambda ck="ck": jobs.checked_append(jobs.file_stream(spark, src, SCHEMA, "parquet"), ["run_id"], out, rej, str(tmp_path / ck), ("wall_seconds", "ts"), buckets=16).awaitTermination()
    rows(spark, *[(f"r{i}", float(i), 0.0) for i in range(60)], (None, 1.0, 0.0)).write.parquet(src)
    run()
    stored = spark.read.parquet(out).select("run_id", jobs.BUCKET).collect()
    home = {r.run_id: r[jobs.BUCKET] for r in stored}
    assert len(stored) == len(home) == 61 and len(set(home.values())) > 8
    run("other")  # the same rows under a new checkpoint: a replay adds nothing
    assert spark.read.parquet(out).count() == 61
    for folder in tmp_path.glob(f"out/{jobs.BUCKET}=*"):
        if folder.name != f"{jobs.BUCKET}={home['r7']}":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"broken")
    rows(spark, ("r7", 7.0, 5.0)).write.mode("append").parquet(src)
    run()
    rows(spark, ("r7", 8.0, 5.0)).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(rej).count() == 1
