"""Moments, pooling and checks of feature vectors (one row per item, layer or frame)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.small import take_bounded
from ..functions.vectors import nonfinite
from .ranking import ordered_rank
from .sums import salts_for

CONSTANT = 1e-8
_FLUSH_KEYS = 16
MOMENT_BLOCK = 64


def dim_stats(df: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """n, mean, population std and constant dimensions per key, in one constant-size aggregate."""
    s = Summarizer.metrics("count", "mean", "variance", "max").summary(array_to_vector(F.col(v)))
    g = df.groupBy(*by).agg(s.alias("s"))
    n = F.col("s.count").cast("double")
    var = vector_to_array("s.variance")
    std = F.transform(var, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) * (n - 1.0) / n))
    return g.select(
        *by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), std.alias("std"),
        vector_to_array("s.max").alias("max"),
    ).withColumn("n_constant", F.size(F.filter("std", lambda x: x < CONSTANT)))


@dataclass
class _Block:
    """Rows ``at`` of one matrix of centred second moments, about the mean of the ``n`` rows it has seen.

    ``cubic``: sum of |y|^2 y for those dimensions, y the centred row. ``fourth`` adds up to the sum of |y|^4 over all
    blocks of a matrix; what does not belong to a dimension is counted in the first block.
    """

    at: int
    n: float
    mean: np.ndarray
    moment: np.ndarray
    cubic: np.ndarray
    spread: float
    fourth: float

    def moved(self, mean: np.ndarray) -> _Block:
        """The same rows about another mean."""
        away = mean - self.mean
        own = away[self.at : self.at + len(self.moment)]
        far, turned = float(away @ away), self.moment @ away
        fourth = self.fourth + 4 * float(own @ turned) - 4 * float(own @ self.cubic)
        if self.at == 0:
            fourth += self.n * far * far + 2 * far * self.spread
        cubic = self.cubic - self.spread * own - 2 * turned - self.n * far * own
        return _Block(self.at, self.n, mean, self.moment + self.n * np.outer(own, away), cubic, self.spread + self.n * far, fourth)

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.n, self.spread, self.fourth], self.mean, self.cubic, self.moment.ravel()])


def _unpacked(at: int, d: int, values: np.ndarray) -> _Block:
    rows = min(MOMENT_BLOCK, d - at)
    mean, cubic, moment = np.split(values[3:], [d, d + rows])
    return _Block(at, values[0], mean, moment.reshape(rows, d), cubic, values[1], values[2])


def _merged(blocks: list[_Block]) -> _Block:
    n = sum(b.n for b in blocks)
    mean = sum(b.n * b.mean for b in blocks) / n
    out = [b.moved(mean) for b in blocks]
    add = lambda name: sum(getattr(b, name) for b in out)
    return _Block(out[0].at, n, mean, add("moment"), add("cubic"), add("spread"), add("fourth"))


def _blocks_of(x: np.ndarray) -> list[_Block]:
    mean = x.mean(0)
    y = x - mean
    size = (y * y).sum(1)
    cubic = size @ y
    cuts = range(0, x.shape[1], MOMENT_BLOCK)
    return [_Block(k, len(x), mean, y[:, k : k + MOMENT_BLOCK].T @ y, cubic[k : k + MOMENT_BLOCK], size.sum(), float(size @ size) * (k == 0)) for k in cuts]


def moment_blocks(df: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """(by, _at, _d, _part): blocks of rows of the centred second-moment matrix of each key, in one scan.

    Each task centres its batches on their own means and merges them; merging about the common mean is exact and does not
    cancel. The partials of a block meet by salt first, then at last, so no group is larger than the square root of the
    number of tasks, and no mean has to be known beforehand.
    """
    by = list(by)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    schema = f"{fields}_at int, _d int, _part array<double>"

    def emit(held):
        for key, blocks in held.items():
            frame = pd.DataFrame({"_at": [b.at for b in blocks], "_d": len(blocks[0].mean), "_part": [b.packed() for b in blocks]})
            for c, k in zip(by, key):
                frame[c] = [k] * len(frame)
            yield frame[[*by, "_at", "_d", "_part"]]

    def partial(batches):
        held: dict[tuple, list[_Block]] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                if not len(rows):
                    continue
                new = _blocks_of(np.stack(rows[v].to_numpy()).astype(float))
                old = held.get(key)
                held[key] = new if old is None else [_merged([a, b]) for a, b in zip(old, new)]
            if len(held) > _FLUSH_KEYS:
                yield from emit(held)
                held = {}
        yield from emit(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        at, d = int(pdf["_at"].iloc[0]), int(pdf["_d"].iloc[0])
        one = _merged([_unpacked(at, d, np.asarray(x)) for x in pdf["_part"]])
        out = pdf.iloc[[0]][[*by, "_at", "_d"]].copy()
        out["_part"] = [one.packed()]
        return out

    parts = df.select(*by, v).mapInPandas(partial, schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts_for(df))))
    half = parts.groupBy(*by, "_at", "_salt").applyInPandas(merge, schema)
    return half.groupBy(*by, "_at").applyInPandas(merge, schema)


def gram(df: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """Centred second moments per key: (by, i, row, n, fourth, mean), one row per matrix row; ``fourth`` is the sum over
    the rows of the fourth power of their distance from the mean, in parts that add up over a key's ``i``."""
    b = moment_blocks(df, by, v)
    d, rows = F.col("_d"), F.least(F.lit(MOMENT_BLOCK), F.col("_d") - F.col("_at"))
    at = F.posexplode(F.transform(F.sequence(F.lit(0), rows - 1), lambda k: F.slice("_part", (F.lit(4) + d + rows + k * d).cast("int"), d)))
    out = b.select(*by, "_at", "_d", "_part", at.alias("_k", "_row"))
    fourth = F.when(F.col("_k") == 0, F.col("_part")[2]).otherwise(F.lit(0.0))
    return out.select(*by, (F.col("_at") + F.col("_k")).alias("i"), F.col("_row").alias("row"), F.col("_part")[0].cast("long").alias("n"), fourth.alias("fourth"), F.slice("_part", F.lit(4), d).alias("mean"))


def covariance(df: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """Unbiased covariance, one row per (by, i) with the matrix row as an array."""
    g = gram(df, by, v)
    scale = 1.0 / (F.col("n") - 1)
    return g.select(*by, "i", F.transform("row", lambda x: x * scale).alias("row"), "n")


# ---- pooling ---------------------------------------------------------------
def segment_pool(frames: DataFrame, item: str, bucket: Column, order: Sequence[str], values: Sequence[str], k: int) -> DataFrame:
    """Mean of ordered frames in ``k`` uniform segments; short items repeat frames.

    ``bucket`` grows with the frame order and keeps a very long item spread over tasks.
    """
    f = ordered_rank(frames, [item], bucket, order, "_r")
    t, n = F.col("_r") - 1, F.col("group_n")

    def holds(i: Column) -> Column:
        start = F.floor(i * n / k)
        end = F.greatest(F.floor((i + 1) * n / k), start + 1)
        return (F.least(start, n - 1) <= t) & (t < F.least(end, n))

    segs = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), holds)
    return f.withColumn("segment", F.explode(segs)).groupBy(item, "segment").agg(
        *[F.avg(c).alias(c) for c in values]
    )


def pool(frames: DataFrame, item: str, values: Sequence[str], modes: Sequence[str] = ("mean", "std", "max")) -> DataFrame:
    """Mean, population std and max over the frames of an item, in the order of ``modes``."""
    fn = {"mean": F.avg, "std": F.stddev_pop, "max": F.max}
    return frames.groupBy(item).agg(*[fn[m](c).alias(f"{c}_{m}") for m in modes for c in values])


def mean_vector(df: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """One averaged vector per key (segments or layers to item)."""
    m = Summarizer.metrics("mean").summary(array_to_vector(F.col(v)))
    return df.groupBy(*by).agg(m.alias("s")).select(*by, vector_to_array("s.mean").alias(v))


def parse_layer_spec(spec: str, n_layers: int) -> tuple[str, int, int]:
    """('last'|'layer'|'mean'|'all', first, last) with range checks."""
    text = spec.strip().lower()
    if text == "last":
        return "last", n_layers - 1, n_layers - 1
    if text == "weighted":
        return "all", 0, n_layers - 1
    m = re.fullmatch(r"layer:(\d+)", text)
    if m and int(m[1]) < n_layers:
        return "layer", int(m[1]), int(m[1])
    m = re.fullmatch(r"mean:(\d+)-(\d+)", text)
    if m and int(m[1]) <= int(m[2]) < n_layers:
        return "mean", int(m[1]), int(m[2])
    raise ValueError(f"bad layer spec {spec!r} for {n_layers} layers")


def aggregate_layers(df: DataFrame, spec: str, n_layers: int, by: Sequence[str]) -> DataFrame:
    """Apply a layer spec. The layer predicate prunes partitions when ``layer`` is one."""
    kind, first, last = parse_layer_spec(spec, n_layers)
    rows = df.where(F.col("layer").between(first, last))
    return rows if kind != "mean" else mean_vector(rows, by)


# ---- checks ----------------------------------------------------------------
def verify_vectors(items: DataFrame, vecs: DataFrame, key: str, d: int, v: str = "v") -> DataFrame:
    """Counts of every kind of problem between an item list and its vectors, in one row."""
    a = items.groupBy(key).agg(F.count(F.lit(1)).alias("ni"))
    b = vecs.groupBy(key).agg(
        F.count(F.lit(1)).alias("nv"), F.count_if(F.size(v) != d).alias("shape"), F.count_if(nonfinite(F.col(v))).alias("bad")
    )
    j = a.join(b, key, "full_outer")
    return j.agg(
        F.coalesce(F.sum("ni"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("nv"), F.lit(0)).alias("n_vectors"),
        F.count_if(F.col("nv").isNull()).alias("missing"), F.count_if(F.col("ni").isNull()).alias("extra"),
        F.count_if(F.col("nv") > 1).alias("repeated"), F.coalesce(F.sum("shape"), F.lit(0)).alias("wrong_shape"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("nonfinite"),
    )


def first_order_difference(expected: DataFrame, actual: DataFrame, pos: str, key: str) -> DataFrame:
    """First position at which two ordered id lists differ (null when they agree)."""
    e = expected.select(pos, F.col(key).alias("_e"))
    a = actual.select(pos, F.col(key).alias("_a"))
    j = e.join(a, pos, "full_outer").where(~F.col("_e").eqNullSafe(F.col("_a")))
    return j.agg(F.min(pos).alias("first_difference"), F.count(F.lit(1)).alias("n_differences"))


# ---- blending weights and dimension groups ---------------------------------
def alpha_mean_gap(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """|mean gap| over summed spread per dimension, clipped to [0, 1]; one row."""
    both = dim_stats(src.select(F.lit("s").alias("side"), "v").unionByName(tgt.select(F.lit("t").alias("side"), "v")), ["side"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    w = both.agg(side("s", "mean").alias("ms"), side("t", "mean").alias("mt"), side("s", "std").alias("ss"), side("t", "std").alias("st"))
    gap = F.zip_with("ms", "mt", lambda a, b: F.abs(a - b))
    spread = F.zip_with("ss", "st", lambda a, b: a + b + 1e-6)
    return w.select(F.zip_with(gap, spread, lambda g, s: F.least(F.lit(1.0), g / s)).alias("alpha"))


def group_edges(d: int, n_groups: int) -> list[int]:
    """Integer edges of equal contiguous groups."""
    return [i * d // n_groups for i in range(n_groups + 1)]


def alpha_contiguous(pairs: DataFrame, d: int, n_groups: int) -> DataFrame:
    """Mean |aligned - original| per contiguous group, relative to the largest group."""
    gap = F.zip_with("aligned", "original", lambda a, o: F.abs(a - o))
    m = dim_stats(pairs.select(gap.alias("v")), [])
    edges = group_edges(d, n_groups)
    means = [
        F.aggregate(F.slice("mean", a + 1, b - a), F.lit(0.0), lambda x, y: x + y) / (b - a)
        for a, b in zip(edges, edges[1:]) if b > a
    ]
    rel = m.select(F.array(*means).alias("g")).withColumn("top", F.array_max("g") + 1e-8)
    widths = [b - a for a, b in zip(edges, edges[1:]) if b > a]
    spread = F.flatten(F.array(*[F.array_repeat(F.least(F.lit(1.0), F.col("g")[i] / F.col("top")), w) for i, w in enumerate(widths)]))
    return rel.select(spread.alias("alpha"))


def alpha_elementwise(pairs: DataFrame) -> DataFrame:
    """Adds ``alpha``: |aligned - original| relative to the largest gap of its dimension."""
    gap = F.zip_with("aligned", "original", lambda a, o: F.abs(a - o))
    rows = pairs.withColumn("_gap", gap)
    top = take_bounded(dim_stats(rows, [], "_gap").select("max"), 1)[0]["max"]
    limit = F.array(*[F.lit(x + 1e-8) for x in top])
    return rows.withColumn("alpha", F.zip_with("_gap", limit, lambda g, m: F.least(F.lit(1.0), g / m))).drop("_gap")


def alpha_group_norm(src: DataFrame, tgt: DataFrame, groups: Sequence[int]) -> DataFrame:
    """d / (d + 1e-6) per group with d the norm of the mean gap inside the group."""
    both = dim_stats(src.select(F.lit("s").alias("side"), "v").unionByName(tgt.select(F.lit("t").alias("side"), "v")), ["side"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("mean")))
    gap = both.agg(side("s").alias("a"), side("t").alias("b")).select(
        F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)).alias("sq")
    )
    norms = []
    for g in range(max(groups) + 1):
        members = [F.col("sq")[j] for j, x in enumerate(groups) if x == g]
        norms.append(F.sqrt(sum(members[1:], members[0])) if members else F.lit(0.0))
    w = gap.select(F.array(*norms).alias("d"))
    per = F.transform("d", lambda x: F.least(F.lit(1.0), x / (x + 1e-6)))
    return w.select(per.alias("group_alpha")).withColumn(
        "alpha", F.array(*[F.col("group_alpha")[g] for g in groups])
    )


def inner_products(df: DataFrame, v: str = "v") -> np.ndarray:
    """The d x d matrix of sums of products of dimensions over all items, from the centred moments."""
    rows = sorted(gram(df, [], v).collect(), key=lambda r: r["i"])
    if not rows:
        return np.zeros((0, 0))
    mean = np.asarray(rows[0]["mean"])
    return np.stack([r["row"] for r in rows]) + rows[0]["n"] * np.outer(mean, mean)


def scatter(inner: np.ndarray, groups: Sequence[int]) -> list[tuple[int, int, float]]:
    """(group, dimensions, sum of squared distances of their profiles from the group's mean profile)."""
    label, out = np.asarray(groups), []
    for g in sorted(set(label.tolist())):
        mine = np.flatnonzero(label == g)
        part = inner[np.ix_(mine, mine)]
        out.append((int(g), len(mine), float(np.trace(part) - part.sum() / len(mine))))
    return out


def group_dims(df: DataFrame, k: int, seed: int = 0, starts: int = 10, rounds: int = 100) -> DataFrame:
    """(dim, group): dimensions clustered by their values over all items, with k-means of ``starts`` seeded starts.

    The distance of two dimensions' profiles follows from the d x d matrix of raw second moments, so the items are
    scanned once and only that matrix reaches the driver. Groups are numbered by their first dimension.
    """
    inner = inner_products(df)
    if not len(inner):
        return df.sparkSession.createDataFrame([], "dim int, group int")
    label = kernel_kmeans(inner, k, seed, starts, rounds)
    return df.sparkSession.createDataFrame([(i, int(g)) for i, g in enumerate(label)], "dim int, group int")


def kernel_kmeans(inner: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several k-means runs on points known by their inner products alone."""
    d, own = len(inner), np.diag(inner)
    rng = np.random.default_rng(seed)
    best, label = np.inf, np.zeros(d, int)

    def distances(assigned: np.ndarray, groups: int) -> np.ndarray:
        one = np.eye(groups)[assigned]
        size = np.maximum(one.sum(0), 1)
        cross = inner @ one / size
        within = (one * (inner @ one)).sum(0) / size**2
        far = own[:, None] - 2 * cross + within
        far[:, one.sum(0) == 0] = np.inf
        return far

    for _ in range(starts):
        # Seeds far from those before: each with a chance in proportion to its squared distance.
        chosen = [int(rng.integers(d))]
        while len(chosen) < min(k, d):
            near = np.min([own + own[c] - 2 * inner[:, c] for c in chosen], axis=0).clip(0)
            chosen.append(int(rng.choice(d, p=near / near.sum())) if near.sum() > 0 else next(i for i in range(d) if i not in chosen))
        now = np.argmin([own + own[c] - 2 * inner[:, c] for c in chosen], axis=0)
        for _ in range(rounds):
            far = distances(now, len(chosen))
            new = far.argmin(1)
            if (new == now).all():
                break
            now = new
        cost = float(distances(now, len(chosen))[np.arange(d), now].sum())
        if cost < best - 1e-9 * abs(cost):
            best, label = cost, now
    order = {g: i for i, g in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([order[g] for g in label.tolist()])
