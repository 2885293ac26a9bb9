"""Checked use of small frames: nothing is broadcast or collected without a size test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def take_bounded(df: DataFrame, max_rows: int = MAX_ROWS) -> list[Row] | None:
    """All rows when there are at most ``max_rows``, else None. Never fetches more than that."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def small_side(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """An aggregate as a broadcastable local relation when it is small, else unchanged.

    The aggregate is computed once for the check and not again in the join. Above the
    bound the plain frame is returned and the join shuffles as usual.
    """
    rows = take_bounded(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_checked(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Broadcast a cheap-to-read frame after counting it; above the bound its join is a shuffled hash join.

    The hint also keeps the planner from broadcasting a side whose size it cannot
    foresee, such as rows about to be multiplied by an explode.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df.hint("shuffle_hash")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core before a projection that multiplies rows.

    For frames that come straight from a scan: a few large files would otherwise leave
    the multiplied work to a few tasks. With enough splits nothing is moved.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
