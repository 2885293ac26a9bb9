"""Exact top-k inner products with block-at-a-time pruning.

Vectors become integers, floor(scale * x). Rows are range-partitioned by id into document-range groups; a group
holds blocks of ``BLOCK`` consecutive ids, each with a forward index (the matrix of its rows) and, for every
dimension (a term), the least and the greatest value. For a query, a block's bound is the sum over the terms of
the greater of query * least and query * greatest. Blocks are taken in the order of their bounds, in rounds, and
scored through the forward index until the next bound is below the query's kth score. In a round, a block meets all
queries that take it in one matrix product.

1. Seeds: every query is scored in one group, which gives a lower bound of its kth score.
2. Every group takes the queries in chunks, starts from that bound, prunes its blocks and returns only rows that
   reach the bound.
3. The k best of each query are ranked over all groups; ties go to the smaller id.

The queries are a stated set against all rows, in chunks and blocks. A task holds one group and one chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomark.sources.scratch import materialise

BLOCK = 256
GROUP_ROWS = 1 << 16
CHUNK = 1024


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best of each query by score, ties by id, in the order of the queries; their ranks from 0."""
    at = np.lexsort((ids, -scores, query))
    ordered = query[at]
    rank = np.arange(len(at)) - np.searchsorted(ordered, ordered)
    return at[rank < k], rank[rank < k]


def search_group(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, block: int = BLOCK) -> tuple[pd.DataFrame, int]:
    """The k best rows of one group for each query that reach ``least``, and how many blocks were scored.

    Each query takes its blocks in the order of their bounds, in rounds of 1, 1, 2, 4, ... blocks; between rounds its kth
    score prunes what is left. The queries that take the same block in a round are scored in one matrix product.
    """
    first = np.arange(0, len(ids), block)
    low, high = (f.reduceat(vectors, first, axis=0).astype(np.float64) for f in (np.minimum, np.maximum))
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    bounds = plus @ high.T + minus @ low.T  # integers below 2**53: exact
    order = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1)
    forward, asked = vectors.astype(np.float64), queries.astype(np.float64)
    floor = least.astype(np.float64)
    query, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    begin, scored = 0, 0
    while begin < len(first):
        end = min(len(first), max(1, 2 * begin))
        q, t = np.nonzero(bounds[:, begin:end] >= floor[:, None])
        if not len(q):  # bounds fall, so no later block can reach a floor either
            break
        taken = order[q, begin + t]
        by_block = np.argsort(taken, kind="stable")
        blocks, starts = np.unique(taken[by_block], return_index=True)
        more = [(query, found, score)]
        for b, who in zip(blocks, np.split(q[by_block], starts[1:])):
            rows = slice(first[b], first[b] + block)
            product = asked[who] @ forward[rows].T
            i, j = np.nonzero(product >= floor[who, None])
            more.append((who[i], ids[rows][j], product[i, j]))
        scored += len(q)
        query, found, score = (np.concatenate(x) for x in zip(*more))
        other = found != query_ids[query]
        query, found, score = query[other], found[other], score[other]
        best, rank = _best(query, found, score, k)
        query, found, score = query[best], found[best], score[best]
        full = rank == k - 1
        floor[query[full]] = np.maximum(floor[query[full]], score[full])
        begin = end
    return pd.DataFrame({"query_id": query_ids[query], "vec_id": found, "score": score.astype(np.int64)}), scored


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each vector length: their positions and the matrix of their vectors."""
    vectors = table.column("v").combine_chunks()
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[n] = at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
    return out


def _searcher(k: int, block: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])
        parts = [schema.empty_table()]
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, (query_ids, least) = left.column("vec_id").to_numpy(), (right.column(c).to_numpy() for c in ("query_id", "least"))
            # Only vectors of one length have an inner product.
            asked = _matrices(right)
            for n, (at, rows) in _matrices(left).items():
                if n in asked:
                    mine, queries = asked[n]
                    found, _ = search_group(ids[at], rows, query_ids[mine], queries, least[mine], k, block)
                    parts.append(pa.Table.from_pandas(found, schema, preserve_index=False))
        return pa.concat_tables(parts)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding", group_rows: int = GROUP_ROWS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each query row (all, if fewer).

    Null vectors, empty vectors, vectors with null or non-finite components and rows with a null id take no part;
    vectors of another length than the query's are no candidates. Of rows that share an id the one with the
    greatest vector takes part. Other columns are ignored.
    """
    rows = vectors.filter(is_query.isNotNull() & F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    rows = rows.groupBy(F.col(id_column).cast("long").alias("vec_id")).agg(F.max(integers(F.col(vector_column), scale)).alias("v"), F.max(is_query).alias("asked"))
    rows = materialise(rows, "vectors")
    n, asked = (int(x or 0) for x in rows.agg(F.count("*"), F.sum(F.col("asked").cast("long"))).first())
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // group_rows), min(2 * cores, n // (4 * block)))
    # Groups are ranges of ids of about equal size: quantiles of the ids, one number per group.
    cuts = rows.approxQuantile("vec_id", [i / groups for i in range(1, groups)], 0.2 / groups) if groups > 1 else []
    cut = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    grouped = materialise(rows.withColumn("g", F.size(F.filter(cut, lambda c: c < F.col("vec_id")))), "grouped-vectors")
    used = len(set(cuts)) + 1
    queries = grouped.filter("asked").select(F.col("vec_id").alias("query_id"), "v", F.col("g").alias("home"), (F.abs(F.xxhash64("vec_id")) % max(1, -(-asked // chunk))).alias("c"))
    queries = materialise(queries, "queries")
    blocks = grouped.select("g", "vec_id", "v")
    out = "query_id long, vec_id long, score long"
    # Salted by chunk: a group meets its own queries in chunks, never all of them at once.
    own_blocks = blocks.join(queries.select(F.col("home").alias("g"), F.col("c").alias("part")).distinct(), "g").select("g", "part", "vec_id", "v")
    own = queries.select(F.col("home").alias("g"), "c", "query_id", "v", F.lit(-(2**53)).cast("long").alias("least"))
    seeds = materialise(own_blocks.groupBy("g", "part").cogroup(own.groupBy("g", "c")).applyInArrow(_searcher(k, block), out), "seeds")
    least = seeds.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select("query_id", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    rest = queries.join(least, "query_id", "left").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(used - 1)))).filter("g <> home")
    rest = rest.select("g", "c", "query_id", "v", F.coalesce("kth", F.lit(-(2**53))).cast("long").alias("least"))
    pairs = rest.select("g", F.col("c").alias("part")).distinct()
    far_blocks = blocks.join(pairs, "g").select("g", "part", "vec_id", "v")
    far = far_blocks.groupBy("g", "part").cogroup(rest.groupBy("g", "c")).applyInArrow(_searcher(k, block), out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return seeds.union(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
