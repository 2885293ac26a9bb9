"""The run ledger: fixed schema, validation, merging, agreement, migration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canonical_json, run_id

SCHEMA_VERSION = 9
STATUSES = ("ok", "failed")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool


def _fields(kind: str, nullable: bool, names: str) -> list[Field]:
    return [Field(n, kind, nullable) for n in names.split()]


# The ledger's column contract, grouped by type and nullability.
FIELDS: tuple[Field, ...] = tuple(
    _fields("bigint", False, "schema_version seed n_classes n_train n_val n_target_adapt n_target_test")
    + _fields("string", False, """run_id git_sha config_hash label_map_hash split_spec_hash feature_spec_hash
        search_spec_hash timestamp hostname lib_versions_json source_corpus target_corpus backbone layer_agg
        feature_branch alignment blending classifier hyperparams_json split_id status""")
    + _fields("boolean", False, "git_dirty")
    + _fields("array<string>", False, "class_names")
    + _fields("double", False, "wall_seconds")
    + _fields("string", True, """freeze_tag per_class_f1_json per_class_precision_json per_class_recall_json
        per_class_support_json confusion_json predictions_path error""")
    + _fields("bigint", True, """layer_index n_groups n_search_trials n_collapsed_classes epochs_run solver_n_iter
        source_train_n source_train_cap""")
    + _fields("boolean", True, "mmd_fallback_fired")
    + _fields("double", True, """blend_alpha alignment_eps alignment_lambda cov_condition_number cov_effective_rank
        marginal_mmd_raw marginal_mmd_reference marginal_mmd_normalised macro_f1 accuracy uar chance_macro_f1
        majority_macro_f1 prior_matched_macro_f1 selection_source_val_macro_f1""")
)

# The coordinates that make two rows the same run.
RUN_COORDINATES = (
    "label_map_hash", "split_spec_hash", "feature_spec_hash", "search_spec_hash", "seed",
    "source_corpus", "target_corpus", "backbone", "layer_agg", "layer_index", "feature_branch",
    "alignment", "alignment_eps", "alignment_lambda", "blending", "blend_alpha", "n_groups",
    "classifier", "split_id",
)

# Fields two executions of one run may differ in.
VOLATILE = (
    "timestamp", "wall_seconds", "hostname", "git_dirty", "git_sha", "predictions_path",
    "run_started_utc", "python_version", "library_versions_json",
)


def ledger_schema() -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{f.name} {f.kind}" for f in FIELDS))


def schema_problems(df: DataFrame, fields: Sequence[Field] = FIELDS) -> list[str]:
    """Missing, extra or wrongly typed columns, read from the plan without running it."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.kind for f in fields}
    out = [f"missing {n}" for n in sorted(set(want) - set(have))]
    out += [f"unexpected {n}" for n in sorted(set(have) - set(want))]
    out += [f"type {n}: {have[n]} is not {want[n]}" for n in sorted(set(want) & set(have)) if have[n] != want[n]]
    return out


@dataclass(frozen=True)
class Rule:
    """A row is in violation where ``bad`` is true."""

    name: str
    bad: Column


def not_null(columns: Iterable[str]) -> list[Rule]:
    return [Rule(f"null {c}", F.col(c).isNull()) for c in columns]


def ledger_rules() -> list[Rule]:
    """Nullability, version, status and the conditional rules of the ledger."""
    status = F.col("status")
    return not_null(f.name for f in FIELDS if not f.nullable) + [
        Rule("schema_version", F.col("schema_version") != SCHEMA_VERSION),
        Rule("status", ~status.isin(*STATUSES)),
        Rule("failed without error", (status == "failed") & (F.coalesce("error", F.lit("")) == "")),
        Rule("ok without macro_f1", (status == "ok") & F.col("macro_f1").isNull()),
        Rule("null class name", F.exists("class_names", lambda c: c.isNull())),
        Rule("n_classes", F.size("class_names") != F.col("n_classes")),
    ]


def violations(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One row per (row, broken rule). All rules are judged in one projection."""
    broken = F.array_compact(F.array(*[F.when(r.bad, F.lit(r.name)) for r in rules]))
    return df.select(*keep, F.explode(broken).alias("rule"))


def conform(df: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    """Rows in the full schema: absent nullable columns become null, unknown ones are refused."""
    names = {f.name for f in fields}
    unknown = sorted(set(df.columns) - names)
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    defaults = {"schema_version": F.lit(SCHEMA_VERSION), "status": F.lit("ok")}
    cols = []
    for f in fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.kind).alias(f.name))
        elif f.name in defaults:
            cols.append(defaults[f.name].cast(f.kind).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.kind).alias(f.name))
        else:
            raise ValueError(f"column {f.name} is required")
    return df.select(*cols)


class IdentityChanged(ValueError):
    """A migration would change what a stored run id stands for."""


@dataclass(frozen=True)
class Migration:
    """One version step. ``touches`` lists the columns it rewrites."""

    start: int
    apply: Callable[[DataFrame], DataFrame]
    touches: Sequence[str] = ()


def migrate(df: DataFrame, steps: Sequence[Migration], target: int, identity: Sequence[str] = RUN_COORDINATES) -> DataFrame:
    """Rows of any older version brought to ``target``; each step only touches its own version."""
    out = df
    for step in sorted(steps, key=lambda s: s.start):
        if step.start >= target:
            continue
        hit = sorted(set(step.touches) & set(identity))
        if hit:
            raise IdentityChanged(f"step from version {step.start} rewrites {hit}")
        old = out.where(F.col("schema_version") <= step.start)
        new = out.where(F.col("schema_version") > step.start)
        moved = step.apply(old).withColumn("schema_version", F.lit(step.start + 1).cast("long"))
        out = moved.unionByName(new, allowMissingColumns=True)
    return out


class EmptySelection(ValueError):
    """A selection that must match rows matched none."""


def select_tag(df: DataFrame, tag: str, column: str = "freeze_tag") -> DataFrame:
    """Exactly the rows of one tag; an empty selection is an error, not an empty table."""
    out = df.where(F.col(column) == tag)
    if out.isEmpty():
        raise EmptySelection(f"no rows with {column} = {tag!r}")
    return out


def main_rows(df: DataFrame, synthetic: str = "synthetic", corpora=("source", "target")) -> DataFrame:
    """Ledger rows that count: completed, not synthetic, not a baseline, not blended."""
    keep = (F.col("status") == "ok") & ~F.col("classifier").startswith("baseline")
    for c in corpora:
        keep &= F.col(c) != synthetic
    return df.where(keep)


def verify_ids(df: DataFrame, coordinates: Sequence[str] = RUN_COORDINATES) -> DataFrame:
    """Rows whose stored id is not the hash of their own coordinates."""
    fresh = df.withColumn("expected_run_id", run_id(coordinates))
    return fresh.where(~F.col("run_id").eqNullSafe(F.col("expected_run_id")))


def _stable(df: DataFrame, key: Sequence[str], ignore: Sequence[str]) -> list[str]:
    return sorted(c for c in df.columns if c not in set(key) | set(ignore))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_conflicts(df: DataFrame, key: Sequence[str], ignore: Sequence[str] = VOLATILE) -> DataFrame:
    """Keys whose copies differ outside the volatile columns.

    The smallest and the largest row hash differ exactly when the copies do, which
    keeps two values per key instead of a distinct set.
    """
    h = F.sha2(canonical_json(_stable(df, key, ignore)), 256)
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(h).alias("a"), F.max(h).alias("b"))
    return g.where("a <> b").select(*key, "n_rows")


def merge_shards(
    df: DataFrame, key: Sequence[str], order: Sequence[str], ignore: Sequence[str] = VOLATILE,
    target: DataFrame | None = None,
) -> DataFrame:
    """One row per key from shards with duplicate commits, minus ids already in ``target``.

    Rows of conflicting keys are left out here and listed by :func:`merge_conflicts`;
    the caller asserts that list is empty.
    """
    stable = _stable(df, key, ignore)
    rest = [c for c in df.columns if c not in key]
    h = F.sha2(canonical_json(stable), 256)
    g = df.groupBy(*key).agg(
        F.min(h).alias("_a"), F.max(h).alias("_b"),
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("n_rows"),
    )
    out = g.where("_a = _b").select(*key, "_row.*", "n_rows")
    return out if target is None else out.join(target.select(*key).distinct(), list(key), "left_anti")


def agreement(
    a: DataFrame, b: DataFrame, key: Sequence[str], ignore: Sequence[str] = VOLATILE, rtol: float = 1e-12
) -> DataFrame:
    """Every non-volatile field on which two ledgers disagree about a shared id.

    One join; the per-field comparison is an array in the same projection, so neither
    side is unpivoted before it.
    """
    kinds = {f.name: f.dataType for f in a.schema}
    shared = [c for c in _stable(a, key, ignore) if c in b.columns]
    left = a.select(*key, F.struct(*shared).alias("l"))
    right = b.select(*key, F.struct(*shared).alias("r"))
    found = []
    for c in shared:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        bad = ~x.eqNullSafe(y)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            close = F.abs(x - y) <= F.lit(rtol) * F.greatest(F.lit(1.0), F.abs(x))
            bad &= ~F.coalesce(close, F.lit(False))
        cell = F.struct(
            F.lit(c).alias("field"), x.cast("string").alias("left"), y.cast("string").alias("right")
        )
        found.append(F.when(bad, cell))
    diffs = F.explode(F.array_compact(F.array(*found))).alias("d")
    return left.join(right, list(key)).select(*key, diffs).select(*key, "d.*")


def todo(planned: DataFrame, done: Sequence[DataFrame], key: str = "run_id") -> DataFrame:
    """Planned rows not completed in any ledger."""
    ids = done[0].select(key)
    for other in done[1:]:
        ids = ids.union(other.select(key))
    return planned.join(ids, key, "left_anti")


def shard(df: DataFrame, index: int, n: int, key: str = "run_id") -> DataFrame:
    """One of ``n`` stable, disjoint subsets of a plan."""
    from ..functions.hashing import shard_of

    return df.where(shard_of(F.col(key), n) == index)
