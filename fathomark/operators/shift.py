"""Label-shift estimation and correction from classifier outputs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import literal, total
from ..sources.scratch import materialise

RIDGE = 1e-6
MAX_CONFUSION_CONDITION = 1e8


def shift_counts(rows: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Source joint counts (K*K) and target predicted counts (K) per cell, in one aggregation.

    ``rows`` has side ('s' or 't'), y_true (used on the source only) and y_pred.
    """
    s, t = F.col("side") == "s", F.col("side") == "t"
    joint = [F.count_if(s & (F.col("y_true") == a) & (F.col("y_pred") == b)) for a in classes for b in classes]
    pred = [F.count_if(t & (F.col("y_pred") == b)) for b in classes]
    prior = [F.count_if(s & (F.col("y_true") == a)) for a in classes]
    return rows.groupBy(*by).agg(
        F.array(*joint).alias("joint"), F.array(*pred).alias("predicted"), F.array(*prior).alias("source_counts")
    )


def solve_weights(joint: np.ndarray, predicted: np.ndarray) -> np.ndarray | None:
    """q(y)/p(y) from the confusion system; None when the confusion cannot identify it."""
    c, mu = joint / max(joint.sum(), 1), predicted / max(predicted.sum(), 1)
    if not np.isfinite(c).all() or np.linalg.cond(c) > MAX_CONFUSION_CONDITION:
        return None
    w = np.linalg.solve(c.T + RIDGE * np.eye(len(mu)), mu)
    return np.clip(w, 0.0, None) if np.isfinite(w).all() else None


def bbse(rows: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Importance weights and target prior per cell; null where they are not identifiable."""
    by, k = list(by), len(classes)
    counts = shift_counts(rows, classes, by)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.select(*by).schema)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                w = solve_weights(np.asarray(r["joint"], float).reshape(k, k), np.asarray(r["predicted"], float))
                row = {c: r[c] for c in by}
                q = None
                if w is not None and w.sum() > 0:
                    p = np.asarray(r["source_counts"], float)
                    q = p * w
                    q = q / q.sum() if q.sum() > 0 else None
                out.append({**row, "weights": w, "target_prior": q})
            yield pd.DataFrame(out, columns=[*by, "weights", "target_prior"])

    return counts.mapInPandas(run, f"{fields}weights array<double>, target_prior array<double>")


def posterior(p: Column, ratio: Column) -> Column:
    """Posterior reweighted by a prior ratio and normalised; all zeros where nothing is left."""
    w = F.zip_with(p, ratio, lambda a, b: a * b)
    t = total(w)
    return F.transform(w, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0)))


def _ratio(estimate: Sequence[float], prior: Sequence[float]) -> list[float]:
    return [e / p if p > 0 else 0.0 for e, p in zip(estimate, prior)]


def compress(proba: DataFrame, p: str = "p") -> DataFrame:
    """Distinct posterior vectors with their multiplicity: EM only sees the average over them."""
    return proba.groupBy(p).agg(F.count(F.lit(1)).alias("w"))


_PASS = """SELECT {sums} FROM (SELECT w, transform(q, x -> if(z > 0, x / z, 0D)) AS q
 FROM (SELECT w, q, aggregate(q, 0D, (s, x) -> s + x) AS z FROM (SELECT w, zip_with({p}, :ratio, (a, b) -> a * b) AS q FROM {{comp}})))"""


def em_step(compressed: DataFrame, prior: Sequence[float], estimate: Sequence[float], p: str = "p") -> list[float]:
    """One EM pass over the table: K weighted sums. The estimate is a parameter, so passes share their plan's code."""
    sums = ", ".join(f"sum(w * q[{i}]) / sum(w)" for i in range(len(prior)))
    text = _PASS.format(sums=sums, p=f"`{p}`")
    return list(compressed.sparkSession.sql(text, args={"ratio": _ratio(estimate, prior)}, comp=compressed).collect()[0])


def em_prior(proba: DataFrame, prior: Sequence[float], max_iter: int = 1000, tol: float = 1e-8, p: str = "p") -> list[float]:
    """EM estimate of the target prior (Saerens, Latinne and Decaestecker, 2002).

    Distinct posteriors are written once with their multiplicity. Every iteration is one
    aggregate over that table, at any size: lineage does not grow, and only K numbers
    travel. No posteriors at all give the prior back.
    """
    estimate = [float(x) for x in prior]
    comp = materialise(compress(proba, p), "posteriors").persist()
    try:
        for _ in range(0 if comp.isEmpty() else max_iter):
            new = em_step(comp, prior, estimate, p)
            moved = max(abs(a - b) for a, b in zip(new, estimate))
            estimate = new
            if moved < tol:
                break
        return estimate
    finally:
        comp.unpersist()


def prior_correct(df: DataFrame, source_prior: Sequence[float], target_prior: Sequence[float], classes: Sequence[str],
                  p: str = "p") -> DataFrame:
    """Corrected posteriors and the class they decide for (first class wins a tie)."""
    out = df.withColumn("p_corrected", posterior(F.col(p), literal(_ratio(target_prior, source_prior))))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position("p_corrected", F.array_max("p_corrected")) - 1
    return out.withColumn("y_corrected", F.get(names, best.cast("int")))
