"""Classifier families, selection on validation data only, and one grid cell end to end."""

from __future__ import annotations

import hashlib
import json
import math
import time
import traceback
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw_hash, draw_uniform
from ..functions.vectors import blend
from ..sources.ledger_io import write_predictions
from . import align, heads, metrics, mmd, priors
from .ledger import FIELDS, conform, todo
from .sums import added

# log10 bounds and choices of each family's search space.
SPACES: Mapping[str, Mapping[str, tuple]] = {
    "logreg": {"C": (-4.0, 4.0), "class_weight": ("none", "balanced")},
    "svm_linear": {"C": (-4.0, 4.0), "class_weight": ("none", "balanced")},
    "svm_rbf": {"C": (-3.0, 4.0), "gamma": (-6.0, 0.0), "class_weight": ("none", "balanced")},
    "mlp": {
        "lr": (-5.0, -2.0), "weight_decay": (-6.0, -1.0), "hidden": (64, 128, 256, 512), "depth": (1, 2, 3),
        "dropout": (0.0, 0.1, 0.3, 0.5), "batch_size": (32, 64, 128),
    },
}
# Parameters drawn log-uniformly between two bounds; the others are choices.
LOG_SCALE = ("C", "gamma", "lr", "weight_decay")


class NotConverged(RuntimeError):
    """A solver stopped at its iteration cap: the fit is not a valid candidate."""


# ---- candidates ------------------------------------------------------------
def candidates(spark: SparkSession, families: Sequence[str], seeds: Sequence[int], n: int) -> DataFrame:
    """Candidate lists of every (family, seed): a function of both alone, so arms share them."""
    base = spark.range(n).select(F.col("id").alias("candidate_index"))
    fam = F.explode(F.array(*[F.lit(f) for f in families]))
    sd = F.explode(F.array(*[F.lit(int(s)) for s in seeds]))
    rows = base.withColumn("family", fam).withColumn("seed", sd)
    for name in dict.fromkeys(n for space in SPACES.values() for n in space):
        u = draw_uniform(draw_hash("cand", F.col("family"), F.col("seed"), F.col("candidate_index"), name))
        value = None
        for f in families:
            if name not in SPACES[f]:
                continue
            space = SPACES[f][name]
            if name in LOG_SCALE:
                drawn = F.pow(F.lit(10.0), F.lit(space[0]) + u * (space[1] - space[0]))
            else:
                drawn = F.get(F.array(*[F.lit(x) for x in space]), F.floor(u * len(space)).cast("int"))
            value = (F if value is None else value).when(F.col("family") == f, drawn)
        kind = "double" if name in (*LOG_SCALE, "dropout") else "string" if name == "class_weight" else "int"
        rows = rows.withColumn(name, F.lit(None).cast(kind) if value is None else value.cast(kind))
    return rows


def candidate_list(spark: SparkSession, family: str, seed: int, n: int) -> list[dict]:
    """The same list on the driver; ``n`` is the search budget."""
    rows = candidates(spark, [family], [seed], n).orderBy("candidate_index").collect()
    return [{k: r[k] for k in SPACES[family]} for r in rows]


# ---- heads -----------------------------------------------------------------
@dataclass
class Fitted:
    """A fitted head: ``predict`` adds ``y_pred`` and ``p`` (or margins) to rows with ``v``."""

    predict: Callable[[DataFrame], DataFrame]
    n_iter: int | None = None


def fit_heads(train: DataFrame, family: str, classes: Sequence[str], params: Sequence[Mapping], label: str) -> list[Fitted | NotConverged]:
    """All candidates of a family at once, each fitted or refused."""
    rows = heads.training_rows(train, classes, label)
    d, counts = next(iter(heads.shapes(rows, len(classes)).values()))
    named = {str(i): heads.Head("", family, dict(p), d, counts) for i, p in enumerate(params)}
    got = heads.fit_all(rows, named)
    return [_accepted(named[str(i)], got[str(i)], classes) for i in range(len(params))]


def _accepted(head: heads.Head, end, classes: Sequence[str]) -> Fitted | NotConverged:
    if not end.converged:
        return NotConverged(f"{head.family} stopped at {end.steps} iterations with a gradient of {end.grad_norm:.2g}")
    return Fitted(lambda df: heads.predict(df, head, end.x, classes), end.steps)


def fit_logreg(train: DataFrame, classes, params, label, n) -> Fitted:
    return build("logreg", train, classes, params, label, n, {})


def fourier_weights(d: int, features: int, gamma: float, seed: int) -> np.ndarray:
    """Frequencies of a Gaussian kernel exp(-gamma |x - y|^2)."""
    return np.random.default_rng(seed).normal(scale=math.sqrt(2.0 * gamma), size=(d, features))


def fourier_map(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Paired cos and sin features: a translation of x only rotates them."""
    z = x @ w
    return np.hstack([np.cos(z), np.sin(z)]) / math.sqrt(w.shape[1])


@dataclass
class KernelStats:
    """Sufficient statistics of a ridge head on random features: one pass serves every C."""

    w: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    n: int
    classes: Sequence[str] = field(default_factory=tuple)


def kernel_stats(train: DataFrame, classes: Sequence[str], label: str, gamma: float, features: int, seed: int, weights: Sequence[float] | None = None) -> KernelStats:
    """Partial Gram and cross products per task, added up row by row of the matrix in two levels.

    ``weights``: one for each class, on the rows of that class.
    """
    d = len(train.select("v").first()["v"])
    w = fourier_weights(d, features, gamma, seed)
    shared = train.sparkSession.sparkContext.broadcast((w, {c: i for i, c in enumerate(classes)}))
    k = len(classes)
    weigh = np.ones(k) if weights is None else np.asarray(weights)

    def partial(batches):
        w_, index = shared.value
        gram, n = np.zeros((2 * w_.shape[1], 2 * w_.shape[1] + k)), 0
        for pdf in batches:
            z = fourier_map(np.stack(pdf["v"].to_numpy()), w_)
            y = -np.ones((len(pdf), k))
            own = pdf[label].map(index).to_numpy()
            y[np.arange(len(pdf)), own] = 1.0
            gram += (z * weigh[own][:, None]).T @ np.hstack([z, y])
            n += len(pdf)
        if n:
            yield pd.DataFrame({"i": np.arange(len(gram), dtype=np.int32), "part": [np.concatenate([[n], r]) for r in gram]})

    parts = train.select("v", label).mapInPandas(partial, "i int, part array<double>")
    rows = sorted(added(parts, ["i"]).collect(), key=lambda r: r["i"])
    full = np.stack([np.asarray(r["part"])[1:] for r in rows])
    m = 2 * features
    return KernelStats(w, full[:, :m], full[:, m:], int(rows[0]["part"][0]), list(classes))


def fit_kernel_ridge(stats: KernelStats, c: float) -> Fitted:
    beta = np.linalg.solve(stats.gram + np.eye(len(stats.gram)) / c, stats.cross)
    w, names = stats.w, list(stats.classes)

    def predict(df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast((w, beta))

        @F.pandas_udf("array<double>")
        def margins(v: pd.Series) -> pd.Series:
            w_, b_ = model.value
            return pd.Series(list(fourier_map(np.stack(v.to_numpy()), w_) @ b_))

        out = df.withColumn("p", margins("v"))
        best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
        return out.withColumn("y_pred", F.get(F.array(*[F.lit(n) for n in names]), best))

    return Fitted(predict)


def build(family: str, train: DataFrame, classes: Sequence[str], params: Mapping, label: str, n: int, cache: dict) -> Fitted:
    """Fit one candidate. Kernel statistics are shared between candidates with one gamma and weighting."""
    if family == "svm_rbf":
        key = (params["gamma"], params.get("class_weight"))
        if key not in cache:
            weights = None
            if params.get("class_weight") == "balanced":
                _, counts = next(iter(heads.shapes(heads.training_rows(train, classes, label), len(classes)).values()))
                weights = heads.Head("", family, params, 0, counts).class_weights
            cache[key] = kernel_stats(train, classes, label, params["gamma"], int(params.get("features", 128)), 0, weights)
        return fit_kernel_ridge(cache[key], params["C"])
    if family not in SPACES:
        raise ValueError(f"unknown family {family!r}")
    got = fit_heads(train, family, classes, [params], label)[0]
    if isinstance(got, NotConverged):
        raise got
    return got


# ---- selection -------------------------------------------------------------
@dataclass
class Selection:
    """The winning candidate, its position in the list, and the record of every trial."""

    family: str
    params: dict
    score: float
    trials: list[dict]
    fitted: Fitted
    index: int


def score_of(predicted: DataFrame, classes: Sequence[str], label: str) -> dict:
    rows = predicted.select(F.col(label).alias("y_true"), "y_pred", F.lit(0).alias("k"))
    counts = metrics.confusion_counts(rows, ["k"])
    got = metrics.all_metrics(counts, classes, ["k"]).collect()
    return got[0].asDict() if got else {"macro_f1": 0.0}


def fit_select(
    train: DataFrame, val: DataFrame, family: str, params: Sequence[Mapping], classes: Sequence[str], label: str = "label"
) -> Selection:
    """Fit every candidate on train, score on val only, keep the first best.

    The budget is the list: nothing is drawn in place of a candidate without a score.
    """
    # Counted once; every candidate then reuses the same persisted rows.
    train, val = train.persist(), val.persist()
    fits: dict[int, Fitted] = {}
    trials = []
    try:
        shared: dict = {}
        n = train.count()
        # The candidates of a family that descends share every job.
        ready = [] if family == "svm_rbf" or not params else fit_heads(train, family, classes, params, label)
        for i, p in enumerate(params):
            score = why = None
            try:
                got = ready[i] if ready else build(family, train, classes, p, label, n, shared)
                if isinstance(got, NotConverged):
                    raise got
                fits[i] = got
                score = float(score_of(got.predict(val), classes, label)["macro_f1"])
            except Exception as exc:  # noqa: BLE001 - kept in the trial's record
                fits.pop(i, None)
                why = str(exc)
            used = fits[i].n_iter if i in fits else None
            trials.append({"candidate_index": i, "params_json": json.dumps(dict(p), sort_keys=True), "score": score, "error": why, "n_iter": used})
    finally:
        train.unpersist()
        val.unpersist()
    if not fits:
        raise RuntimeError(f"no candidate of {family} has a score; the first says: {trials[0]['error'] if trials else 'empty list'}")
    winner = max(fits, key=lambda i: (trials[i]["score"], -i))
    return Selection(family, dict(params[winner]), trials[winner]["score"], trials, fits[winner], winner)


# ---- cells -----------------------------------------------------------------
@dataclass(frozen=True)
class Cell:
    """One grid cell over vectors with item_id, corpus, grp, label, v and split rows.

    ``settings``: pairs for the alignment, such as ("eps", 0.01). ``blend_alpha``: weight of the aligned vectors in a blend
    with the original ones; None takes the aligned vectors alone.
    """

    source: str
    target: str
    seed: int
    family: str = "logreg"
    alignment: str = "none"
    settings: tuple = ()
    budget: int = 3
    max_iter: int | None = None
    blend_alpha: float | None = None

    @property
    def run_id(self) -> str:
        """16 hex digits over the cell's coordinates."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


class LeakedRole(RuntimeError):
    """An alignment was fitted on rows that only the final score may see."""


def _roles(vecs: DataFrame, split_rows: DataFrame, cell: Cell) -> dict[str, DataFrame]:
    mine = split_rows.where(
        (F.col("source") == cell.source) & (F.col("target") == cell.target) & (F.col("seed") == cell.seed)
    ).select("item_id", "role")
    joined = vecs.join(mine, "item_id").persist()
    return {"all": joined} | {r: joined.where(F.col("role") == r) for r in ("source_train", "source_val", "target_adapt", "target_test")}


def _moved(model: align.Alignment, df: DataFrame, domain: str, alpha: float | None) -> DataFrame:
    """Aligned vectors, or their blend with the original ones."""
    if alpha is None:
        return model.transform(df, domain)
    out = model.transform(df.withColumn("_original", F.col("v")), domain)
    return out.withColumn("v", blend(F.col("_original"), F.col("v"), alpha)).drop("_original")


def _test_scores(predicted: DataFrame, classes: Sequence[str]) -> dict:
    """Scores, scores of every class and the confusion matrix; K * K counts reach the driver."""
    spark = predicted.sparkSession
    counts = metrics.confusion_counts(predicted.select("y_true", "y_pred", F.lit(0).alias("k")), ["k"])
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    whole = metrics.all_metrics(counts, classes, ["k"]).collect()[0]
    each = {r["class"]: r for r in metrics.per_class(counts, classes, ["k"]).collect()}
    found = {(r["y_true"], r["y_pred"]): r["n"] for r in counts.collect()}
    text = lambda name: json.dumps({c: each[c][name] for c in classes})
    return {
        "macro_f1": whole["macro_f1"], "accuracy": whole["accuracy"], "uar": whole["uar"], "n_collapsed_classes": whole["n_collapsed"],
        "per_class_f1_json": text("f1"), "per_class_precision_json": text("precision"), "per_class_recall_json": text("recall"),
        "per_class_support_json": text("support"), "confusion_json": json.dumps([[found.get((t, q), 0) for q in classes] for t in classes]),
    }


def _floors(train: Sequence[float], test: Sequence[float]) -> dict:
    """Expected macro-F1 of a uniform draw, of the largest training class and of a draw from the training prior."""
    p, q, k = np.asarray(test), np.asarray(train), len(test)
    top = p[int(np.argmax(q))]
    both = np.divide(2 * p * q, p + q, out=np.zeros(k), where=p + q > 0)
    return {"chance_macro_f1": float(np.mean(2 * p / k / (p + 1 / k))), "majority_macro_f1": float(2 * top / (top + 1) / k), "prior_matched_macro_f1": float(both.mean())}


def run_cell(spark: SparkSession, vecs: DataFrame, split_rows: DataFrame, cell: Cell, classes: Sequence[str], predictions: str | None = None) -> dict:
    """Align, blend, measure, select on validation, score the target once beside its floors: one ledger row.

    The discrepancy is measured on what the classifier sees, in its own frame and in the whitened frame of the unaligned
    source. ``predictions``: a shared folder in which the target's predictions are stored under the run's id.
    """
    began = time.monotonic()
    roles = _roles(vecs, split_rows, cell)
    train, val, adapt, test = (roles[r] for r in ("source_train", "source_val", "target_adapt", "target_test"))
    try:
        sizes = {r["role"]: r["n"] for r in roles["all"].groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
        model = align.fit_align(train, adapt, cell.alignment, **dict(cell.settings))
        if not model.fit_ids.join(test.select("item_id"), "item_id", "left_semi").isEmpty():
            raise LeakedRole(f"{cell.alignment} saw target_test")
        on_train, on_val, on_adapt, on_test = (
            _moved(model, df, domain, cell.blend_alpha) for df, domain in ((train, "source"), (val, "source"), (adapt, "target"), (test, "target"))
        )
        own = mmd.two_sides(on_train, on_adapt).withColumn("frame", F.lit("own"))
        frame = align.ReferenceFrame().fit(train, adapt)
        fixed = mmd.two_sides(frame.transform(on_train, "source"), frame.transform(on_adapt, "target")).withColumn("frame", F.lit("reference"))
        effect = {r["frame"]: r for r in mmd.effect_size(own.unionByName(fixed), ["frame"], 5, 512, cell.seed).collect()}
        params = candidate_list(spark, cell.family, cell.seed, cell.budget)
        if cell.max_iter:
            params = [{**p, "max_iter": cell.max_iter} for p in params]
        sel = fit_select(on_train, on_val, cell.family, params, classes)
        predicted = sel.fitted.predict(on_test).select("item_id", F.col("label").alias("y_true"), "y_pred").persist()
        scores = _test_scores(predicted, classes)
        path = None
        if predictions is not None:
            path = f"{predictions.rstrip('/')}/{cell.run_id}"
            write_predictions(predicted.select(F.lit(cell.run_id).alias("run_id"), F.col("item_id").cast("string").alias("item_id"), "y_pred"), path)
        predicted.unpersist()
        prior = {r: priors.prior_vector(roles[r].withColumn("k", F.lit(0)), classes, ["k"]).collect()[0]["p"] for r in ("source_train", "target_test")}
    finally:
        roles["all"].unpersist()
    failed = [t["error"] for t in sel.trials if t["score"] is None]
    settings, found = dict(cell.settings), model.diagnostics
    return _coordinates(cell) | scores | _floors(prior["source_train"], prior["target_test"]) | {
        "n_classes": len(classes), "class_names": list(classes), "predictions_path": path,
        "n_train": sizes.get("source_train", 0), "n_val": sizes.get("source_val", 0), "n_target_adapt": sizes.get("target_adapt", 0),
        "n_target_test": sizes.get("target_test", 0), "source_train_n": sizes.get("source_train", 0),
        "marginal_mmd_raw": effect["own"]["mmd2"], "marginal_mmd_normalised": effect["own"]["effect_size"],
        "marginal_mmd_reference": effect["reference"]["effect_size"], "mmd_fallback_fired": found.get("reverted"),
        "cov_condition_number": found.get("condition_number"), "cov_effective_rank": found.get("effective_rank"),
        "selection_source_val_macro_f1": sel.score, "n_search_trials": len(sel.trials), "solver_n_iter": sel.fitted.n_iter,
        "hyperparams_json": json.dumps({
            "family": cell.family, "selected": sel.params, "n_search_trials": len(sel.trials), "source_val_macro_f1": sel.score, "n_failed_trials": len(failed),
            "n_not_converged": sum("stopped at" in e for e in failed), "solver_n_iter": sel.fitted.n_iter, "selection_surface": "source_val", "alignment": settings,
        }, sort_keys=True),
        "wall_seconds": time.monotonic() - began, "status": "ok", "error": None,
    }


def _coordinates(cell: Cell) -> dict:
    settings = dict(cell.settings)
    return {
        "run_id": cell.run_id, "source_corpus": cell.source, "target_corpus": cell.target, "seed": cell.seed, "classifier": cell.family,
        "alignment": cell.alignment, "alignment_eps": settings.get("eps"), "alignment_lambda": settings.get("lam"),
        "blending": "none" if cell.blend_alpha is None else "scalar", "blend_alpha": cell.blend_alpha,
    }


# What a cell knows of itself; the other ledger columns are constants of the run.
CELL_COLUMNS = (
    "run_id", "source_corpus", "target_corpus", "seed", "classifier", "alignment", "alignment_eps", "alignment_lambda", "blending", "blend_alpha",
    "n_classes", "class_names", "n_train", "n_val", "n_target_adapt", "n_target_test", "source_train_n", "marginal_mmd_raw", "marginal_mmd_normalised",
    "marginal_mmd_reference", "mmd_fallback_fired", "cov_condition_number", "cov_effective_rank", "selection_source_val_macro_f1", "n_search_trials",
    "solver_n_iter", "hyperparams_json", "macro_f1", "accuracy", "uar", "n_collapsed_classes", "per_class_f1_json", "per_class_precision_json",
    "per_class_recall_json", "per_class_support_json", "confusion_json", "chance_macro_f1", "majority_macro_f1", "prior_matched_macro_f1",
    "predictions_path", "wall_seconds", "status", "error",
)
CELL_SCHEMA = ", ".join(f"{c} {kind}" for c in CELL_COLUMNS for kind in [next(f.kind for f in FIELDS if f.name == c)])
WORKERS = 4


def _guarded(spark, vecs, split_rows, cell: Cell, classes, predictions) -> dict:
    began = time.monotonic()
    try:
        return run_cell(spark, vecs, split_rows, cell, classes, predictions)
    except Exception:  # noqa: BLE001 - a failed cell is a ledger row
        return _coordinates(cell) | {
            "n_classes": len(classes), "class_names": list(classes), "n_train": 0, "n_val": 0, "n_target_adapt": 0, "n_target_test": 0,
            "hyperparams_json": "{}", "wall_seconds": time.monotonic() - began, "status": "failed", "error": traceback.format_exc(),
        }


def run_cells(
    spark: SparkSession, vecs: DataFrame, split_rows: DataFrame, cells: Sequence[Cell], classes: Sequence[str],
    predictions: str | None = None, workers: int = WORKERS,
) -> DataFrame:
    """One row per cell, in the order given; a cell that fails yields a failed row with its error.

    ``workers`` cells are under way at a time, so that one cell's small jobs fill the gaps of another's.
    """
    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(lambda cell: _guarded(spark, vecs, split_rows, cell, classes, predictions), cells))
    return spark.createDataFrame([tuple(r.get(n) for n in CELL_COLUMNS) for r in rows], CELL_SCHEMA)


def run_grid(
    spark: SparkSession, plan: DataFrame, done: DataFrame, to_cell: Callable[[dict], Cell], vecs: DataFrame,
    split_rows: DataFrame, classes: Sequence[str], sink: Callable[[DataFrame], None], shard: tuple[int, int] = (0, 1),
    predictions: str | None = None, workers: int = WORKERS,
) -> int:
    """Run the cells of ``plan`` not yet in ``done``, a wave of ``workers`` at a time; each wave is one append.

    A run that is broken off loses at most a wave and resumes behind what was appended. The plan is driven row by row
    because every cell is several Spark jobs; its rows are grid coordinates, never data.
    """
    from .ledger import shard as pick

    left = pick(todo(plan, [done]), shard[0], shard[1]).orderBy("run_id").toLocalIterator()
    count = 0
    while wave := list(islice(left, workers)):
        got = run_cells(spark, vecs, split_rows, [to_cell(r.asDict()) for r in wave], classes, predictions, workers)
        # The plan's own ids name the rows.
        place = F.create_map(*[F.lit(x) for r in wave for x in (to_cell(r.asDict()).run_id, r["run_id"])])
        sink(got.withColumn("run_id", place[F.col("run_id")]))
        count += len(wave)
    return count


def check_conditions(spark, vecs, split_rows, cells: Sequence[Cell], classes: Sequence[str]) -> DataFrame:
    """Validated, oracle and gap per pair over a list of conditions; budgets must be equal."""
    if len({c.budget for c in cells}) != 1:
        raise ValueError("every condition must have the same search budget")
    rows = run_cells(spark, vecs, split_rows, cells, classes).where("status = 'ok'")
    return rows.groupBy("source_corpus", "target_corpus", "seed").agg(
        F.min_by("macro_f1", F.struct(-F.col("selection_source_val_macro_f1"), "classifier", "alignment")).alias("validated"),
        F.max("macro_f1").alias("oracle"), F.count(F.lit(1)).alias("n_conditions"),
    ).withColumn("gap", F.col("oracle") - F.col("validated"))


def alpha_sweep(train: DataFrame, test: DataFrame, aligned: align.Alignment, alphas: Sequence[float], classes: Sequence[str],
                gamma: float = 1.0, c: float = 1.0, label: str = "label") -> list[tuple[float, float]]:
    """Score of every blend weight between raw and aligned source features, one fit each."""
    moved = aligned.transform(train, "source").withColumnRenamed("v", "_a").select("item_id", "_a")
    both = train.join(moved, "item_id").persist()
    target = aligned.transform(test, "target")
    out = []
    for a in alphas:
        mixed = both.withColumn("v", blend(F.col("v"), F.col("_a"), a)).drop("_a")
        fit = fit_kernel_ridge(kernel_stats(mixed, classes, label, gamma, 64, 0), c)
        out.append((float(a), float(score_of(fit.predict(target), classes, label)["macro_f1"])))
    both.unpersist()
    return out


def to_ledger(rows: DataFrame, **constants) -> DataFrame:
    """Cell rows in the full ledger schema, with run-level constants filled in."""
    for name, value in constants.items():
        rows = rows.withColumn(name, F.lit(value))
    return conform(rows)
