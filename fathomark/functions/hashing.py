"""Deterministic draws and digests built on SHA-256.

Every random choice in the package is a hash of (seed, labels, row key), never a
stateful generator: the result does not depend on partitioning, survives a lost
executor, and can be reproduced by any SQL engine that has ``sha256``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# sha256 is cut to 8 hex digits (32 bits) for draws and to 15 (60 bits) for sums.
_DRAW_DIGITS = 8
_LIMB_DIGITS = 15


def _col(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def draw_hash(*parts) -> Column:
    """64 hex digits from ``a|b|c``; Columns are cast, anything else is literal text."""
    return F.sha2(F.concat_ws("|", *[_col(p) for p in parts]), 256)


def draw_bits(hex_col: Column) -> Column:
    """First 32 bits of a draw hash as a long in [0, 2^32)."""
    return F.conv(F.substring(hex_col, 1, _DRAW_DIGITS), 16, 10).cast("long")


def draw_index(hex_col: Column, n: Column | int) -> Column:
    """A draw in [0, n). The modulo bias is below n / 2^32."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(draw_bits(hex_col), n.cast("long"))


def draw_uniform(hex_col: Column) -> Column:
    """A draw in [0, 1)."""
    return draw_bits(hex_col).cast("double") / F.lit(4294967296.0)


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON over the named columns in name order, nulls kept.

    A null coordinate is part of an identity: leaving it out would let two
    different runs share an id.
    """
    ordered = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def payload_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def run_id(columns: Sequence[str]) -> Column:
    """16-hex id over the coordinates only; results and provenance stay out."""
    return F.substring(payload_hash(columns), 1, 16)


def shard_of(id_col: Column, n: int) -> Column:
    """Stable shard number of a hexadecimal id."""
    return draw_index(id_col, n)


def set_digest(entry: Column) -> list[Column]:
    """Aggregates for an order-free digest of a row set of any size.

    ``entry`` must contain whatever makes a row distinct, its position included
    where order matters. Sums of 60-bit pieces of each row's SHA-256 combine map
    side into constant-size state, so no task ever holds the whole list.
    """
    h = F.sha2(entry, 256)
    limbs = []
    for i in range(4):
        piece = F.conv(F.substring(h, 1 + i * _LIMB_DIGITS, _LIMB_DIGITS), 16, 10)
        limbs.append(F.sum(piece.cast("decimal(20,0)")).alias(f"_limb{i}"))
    return [F.count(F.lit(1)).alias("_n"), *limbs]


def set_digest_value() -> Column:
    """Final hash over the columns made by :func:`set_digest`."""
    parts = [F.col("_n").cast("string")] + [
        F.col(f"_limb{i}").cast("decimal(38,0)").cast("string") for i in range(4)
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def digest_rows(df, by: Sequence[str], entry: Column, out: str = "digest"):
    """One digest per group; ``by`` empty means one for the whole frame."""
    agg = df.groupBy(*by).agg(*set_digest(entry))
    return agg.select(*by, F.col("_n").alias("n_rows"), set_digest_value().alias(out))


def utc_stamp() -> Column:
    """Current time as ISO-8601 UTC text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
