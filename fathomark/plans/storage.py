"""Tables written through the package's sinks and read back through its readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import utc_stamp
from ..operators import align, ledger as led, metrics
from ..sources import files, ledger_io as io, manifest
from ..sources.scratch import shared_dir
from .geometry import probe, sides, sql_probe
from .registry import query, table
from .views import DIM_SQL, FLAGS, LEDGER_SQL, LINE_SQL, PRED_SQL, ledger, line_predictions, predictions, vectors


# ---- ledger ----------------------------------------------------------------
def full_rows(spark, d):
    """Orders as complete ledger rows: derived coordinates and scores, constants for the rest."""
    o = ledger(spark, d)
    const = {
        "git_sha": "unknown", "config_hash": "c", "label_map_hash": "l", "split_spec_hash": "s", "feature_spec_hash": "f",
        "search_spec_hash": "q", "hostname": "h", "lib_versions_json": "{}", "layer_agg": "layer", "feature_branch": "ssl",
        "blending": "none", "git_dirty": False, "n_classes": 2, "n_train": 1, "n_val": 1, "n_target_adapt": 1, "n_target_test": 1,
    }
    rows = o.select(
        "run_id", F.col("source").alias("source_corpus"), F.col("target").alias("target_corpus"), "alignment", "classifier", "backbone",
        "layer_index", "seed", "alignment_eps", "alignment_lambda", "status", "freeze_tag", F.col("test").alias("macro_f1"),
        F.col("val").alias("selection_source_val_macro_f1"), "wall_seconds", "solver_n_iter", F.col("fallback").alias("mmd_fallback_fired"),
        "hyperparams_json", F.when(F.col("status") == "failed", "stopped").alias("error"),
        F.concat_ws("-", "source", "target", F.col("seed").cast("string")).alias("split_id"),
        F.array(F.lit("a"), F.lit("b")).alias("class_names"), utc_stamp().alias("timestamp"),
    )
    for name, value in const.items():
        rows = rows.withColumn(name, F.lit(value))
    return led.conform(rows)


_BACK = "run_id, source_corpus, alignment, alignment_eps, layer_index, macro_f1, status, error"
_BACK_SQL = """SELECT run_id, source AS source_corpus, alignment, alignment_eps, layer_index, test AS macro_f1, status,
CASE WHEN status = 'failed' THEN 'stopped' END AS error FROM ledger"""


@query("ledger_append_read", f"WITH {LEDGER_SQL} {_BACK_SQL}")
def ledger_append_read(spark, d):
    """Two validated appends to a JSON-lines ledger, read back under the fixed schema."""
    rows, path = full_rows(spark, d), shared_dir(spark, "ledger")
    io.append_ledger(rows.where("seed < 2"), path)
    io.append_ledger(rows.where("seed >= 2"), path)
    return io.read_ledger(spark, path).select(*_BACK.split(", "))


@query("read_union", f"WITH {LEDGER_SQL} SELECT run_id, 'shards' AS origin FROM ledger")
def read_union(spark, d):
    """No canonical artifact: the shards are read, and every row says so."""
    rows, base = full_rows(spark, d), shared_dir(spark, "union")
    shards = [f"{base}/shard{i}" for i in range(2)]
    for i, path in enumerate(shards):
        io.append_ledger(rows.where(F.col("seed") % 2 == i), path)
    return io.read_union(spark, f"{base}/canonical", shards).select("run_id", "origin")


@query("conform", f"WITH {LEDGER_SQL} SELECT run_id, status, CAST(9 AS BIGINT) AS schema_version, seed, CAST(NULL AS BIGINT) AS n_groups FROM ledger")
def conform(spark, d):
    return full_rows(spark, d).select("run_id", "status", "schema_version", "seed", "n_groups")


@query("ledger_rules", f"""WITH {LEDGER_SQL} SELECT run_id, 'ok without macro_f1' AS rule FROM ledger WHERE status = 'ok' AND o_orderkey % 23 = 0
UNION ALL SELECT run_id, 'failed without error' FROM ledger WHERE status = 'failed' AND seed = 3""")
def ledger_rules(spark, d):
    """The full rule set on rows with planted faults."""
    gone = ledger(spark, d).where("o_orderkey % 23 = 0").select("run_id", F.lit(True).alias("gone"))
    rows = full_rows(spark, d).join(gone, "run_id", "left")
    rows = rows.withColumn("macro_f1", F.when(F.col("gone").isNull(), F.col("macro_f1"))).withColumn(
        "error", F.when(F.col("seed") != 3, F.col("error"))).drop("gone")
    return led.violations(rows, led.ledger_rules(), ["run_id"])


@query("migrate", f"""WITH {LEDGER_SQL} SELECT run_id, CAST(9 AS BIGINT) AS schema_version, CASE schema_version WHEN 7 THEN 'h-none' WHEN 8 THEN 'h' ELSE 'keep' END AS note,
CASE WHEN schema_version < 9 THEN alignment || '/2' ELSE 'new' END AS tag FROM ledger""")
def migrate(spark, d):
    """Rows of versions 7 to 9 brought to 9 by two steps."""
    old = ledger(spark, d).select("run_id", "schema_version", "alignment").withColumn(
        "note", F.when(F.col("schema_version") == 9, "keep").when(F.col("schema_version") == 8, "h")).withColumn(
        "tag", F.when(F.col("schema_version") == 9, "new"))
    steps = [
        led.Migration(7, lambda x: x.withColumn("note", F.lit("h-none")), ["note"]),
        led.Migration(8, lambda x: x.withColumn("tag", F.concat("alignment", F.lit("/2"))), ["tag"]),
    ]
    return led.migrate(old, steps, 9).select("run_id", "schema_version", "note", "tag")


# ---- predictions, counts, vectors ------------------------------------------
@query("predictions_write_read", f"WITH {PRED_SQL} SELECT 'r' || domain || '-' || seed AS run_id, CAST(item_id AS VARCHAR) AS item_id, y_pred FROM pred")
def predictions_write_read(spark, d):
    """Gzipped parallel arrays per run, in records of at most 1,000 items, and back to rows."""
    run = F.concat(F.lit("r"), F.col("domain").cast("string"), F.lit("-"), F.col("seed").cast("string"))
    p = predictions(spark, d).select(run.alias("run_id"), F.col("item_id").cast("string").alias("item_id"), "y_pred")
    path = shared_dir(spark, "predictions")
    io.write_predictions(p, path, chunk=1000)
    return io.read_predictions(spark, path)


@query("conf_write_read", f"WITH {LINE_SQL} SELECT arm, grp, y_true, y_pred, count(*) AS n FROM line GROUP BY ALL")
def conf_write_read(spark, d):
    raw = metrics.confusion_by_group(line_predictions(spark, d), ["arm"], "grp")
    path = shared_dir(spark, "conf")
    io.write_conf(metrics.pack_confusion(raw, FLAGS, ["arm", "grp"]), path, FLAGS)
    return metrics.unpack_confusion(io.read_conf(spark, path, FLAGS), FLAGS, ["arm", "grp"])


@query("vectors_write_read", f"WITH {DIM_SQL}, out AS (SELECT item_id, dim, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM dims) {sql_probe('item_id')}")
def vectors_write_read(spark, d):
    """Stored in single precision under a content key, partitioned by corpus, read back as doubles."""
    v = vectors(spark, d).withColumn("corpus", F.concat(F.lit("c"), F.col("domain").cast("string")))
    key = io.vectors_key(v.select("item_id", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256).alias("sha256")))
    path = shared_dir(spark, "vectors")
    io.write_vectors(v.select("item_id", "corpus", F.col("v").cast("array<float>").alias("v")), path, key)
    return probe(io.read_vectors(spark, path, key), "item_id")


# ---- manifest and statistics -----------------------------------------------
@query("manifest_write_read", """SELECT lang AS corpus, 'doc/' || doc_id AS utterance_id, source AS speaker_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'k' END AS label_six,
n_chars / 100.0::DOUBLE AS duration_s, sha256(text) AS sha256, '/here/' || lang || '/' || source || '/' || doc_id AS file_path FROM documents""")
def manifest_write_read(spark, d):
    """Portable manifest out, and back on another machine's roots."""
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents")
    uid = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    m = docs.select(
        F.col("lang").alias("corpus"), F.concat_ws("/", F.lit("/data"), "lang", "source", F.col("doc_id").cast("string")).alias("file_path"),
        uid.alias("utterance_id"), F.col("source").alias("speaker_id"), none.alias("session_id"), none.alias("subset"),
        F.lit("raw").alias("original_label"), F.when(F.col("doc_id") % 4 != 0, "k").alias("label_six"), none.alias("label_four"),
        (F.col("n_chars") / 100.0).alias("duration_s"), F.lit(16000).alias("sample_rate"), F.sha2("text", 256).alias("sha256"))
    langs = docs.select(F.col("lang").alias("corpus")).distinct()
    root = lambda base: langs.withColumn("root", F.concat(F.lit(base), F.col("corpus")))
    path = shared_dir(spark, "manifest")
    manifest.write_manifest(manifest.to_portable(m, root("/data/")), path, manifest.PORTABLE)
    back = manifest.load_items(spark, path, f"{path}-local", root("/here/"))
    return back.select("corpus", "utterance_id", "speaker_id", "label_six", "duration_s", "sha256", "file_path")


@query("stats_csv", f"WITH {PRED_SQL} SELECT domain, y_true AS class, count(*) AS n FROM pred GROUP BY ALL")
def stats_csv(spark, d):
    from ..operators.priors import class_counts

    path = shared_dir(spark, "stats")
    counts = class_counts(predictions(spark, d).withColumnRenamed("y_true", "class"), ["domain"], "class")
    io.write_stats(counts, path, ["domain", "class"])
    return spark.read.option("header", "true").schema("domain bigint, class string, n bigint").csv(path)


@query("mkmmd_full")
def mkmmd_full(spark, d):
    s, t = sides(spark, d)
    m = align.fit_align(s, t, "mkmmd_full", lam=0.1, steps=12, features=24, eps=0.01)
    return probe(m.transform(s, "source").unionByName(m.transform(t, "target")), "item_id", "domain")


# ---- audio headers ---------------------------------------------------------
def _le(value, size: int):
    """Little-endian bytes of a whole number."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


@query("wav_headers", """WITH c AS (SELECT c_custkey AS k, 8000 + 1000 * (c_custkey % 9) AS rate, c_custkey % 400 AS frames FROM customer),
p AS (SELECT *, CASE WHEN k % 50 = 0 THEN 'not a RIFF/WAVE file' WHEN k % 50 = 1 THEN 'data chunk is cut' WHEN k % 50 = 2 THEN 'no data chunk' END AS problem FROM c)
SELECT k AS item_id, CASE WHEN problem IS NULL THEN rate END::INTEGER AS sample_rate, CASE WHEN problem IS NULL THEN round_even(frames::DOUBLE / rate, 6) END AS duration_s,
problem AS header_problem FROM p""")
def wav_headers(spark, d):
    """Files made of the customers' keys: a LIST chunk of odd length in every third, a broken header in three of fifty."""
    k = F.col("c_custkey")
    rate, frames, lit = F.lit(8000) + 1000 * (k % 9), k % 400, lambda text: F.lit(text).cast("binary")
    data = F.unhex(F.repeat(F.lit("0102"), frames.cast("int")))
    form = F.concat(lit("fmt "), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.lit(1), 2), _le(rate, 4), _le(2 * rate, 4), _le(F.lit(2), 2), _le(F.lit(16), 2))
    note = F.when(k % 3 == 0, F.concat(lit("LIST"), _le(F.lit(5), 4), lit("abcde"), F.unhex(F.lit("00")))).otherwise(lit(""))
    name = F.when(k % 50 == 2, lit("junk")).otherwise(lit("data"))
    size = 2 * frames + F.when(k % 50 == 1, 2).otherwise(0)
    body = F.concat(F.when(k % 50 == 0, lit("RIFX")).otherwise(lit("RIFF")), _le(F.lit(0), 4), lit("WAVE"), note, form, note, name, _le(size, 4), data)
    rows = files.wav_header(table(spark, d, "customer").select(k.alias("item_id"), body.alias("content")))
    return rows.select("item_id", "sample_rate", "duration_s", "header_problem")


@query("annotations", """SELECT c_custkey AS item_id, substr('angneuhapsadexc', CAST(c_custkey % 5 * 3 + 1 AS BIGINT), 3) AS code FROM customer WHERE c_custkey % 7 <> 0""")
def annotations(spark, d):
    """Annotation lines written from the customers' keys and scanned again; every seventh line is none."""
    k = F.col("c_custkey")
    code = F.substring(F.lit("angneuhapsadexc"), (k % 5 * 3 + 1).cast("int"), F.lit(3))
    name = F.format_string("Ses%02dF_impro01_F%d", k % 5 + 1, k)
    line = F.when(k % 7 == 0, F.lit("% not an annotation")).otherwise(F.concat(F.lit("[0.10 - 2.50]\t"), name, F.lit("\t"), code, F.lit("\t[2.5, 3.0, 1.5]")))
    path = shared_dir(spark, "annotations")
    table(spark, d, "customer").select(line.alias("value")).write.text(f"{path}/EmoEvaluation")
    got = files.scan_annotations(spark, path)
    return got.select(F.regexp_extract("item", r"F(\d+)$", 1).cast("long").alias("item_id"), "code")
