"""Near-duplicate documents with an LSH forest over MinHash signatures.

1. Each whole text becomes its set of word shingles, a digest of the set and a MinHash signature. Documents
   with equal sets form one class, represented by its smallest id.
2. Each of ``orders`` permutations of the signature sorts all classes (a range-partitioned sort). Neighbours
   in a sorted order with a common prefix of ``least`` values or more are candidates. Every class is paired
   with its ``reach`` next neighbours, so the depth adapts to the region, up to ``KEY_DEPTH`` values: where few
   share a prefix all of them meet at the least depth; where many do, only those with the longest common
   prefixes meet, and step 5 settles the others.
3. The signatures estimate each candidate; estimates far below the threshold are put aside (about four
   standard deviations, so a true link is lost with probability near 1e-5, and must be lost by every
   connection of its group to matter).
4. Links are confirmed on the full sets, recomputed from the texts. First each class is compared with its
   most similar smaller candidate, which connects most groups; then only candidates between different groups
   are, so a group of thousands of near copies costs a comparison or two per member.
5. Where more than ``reach`` + 1 classes share a prefix, some of their pairs were not candidates. Such classes form
   regions (components over the shared prefixes). A region that still holds several groups is compared whole: its
   classes are dealt into salted blocks, and each pair of blocks counts the common shingles of all its pairs.
6. Components of the confirmed links come from alternating star passes.

Candidates are linear in the number of classes; the work of step 5 is quadratic in a region, its rows are not: a
class is copied once per ``BLOCK_ROWS`` classes of its region. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.graph import components, stars_of
from fathomark.llm.names import free_names
from fathomark.llm.words import chunks, mix, split_words, window_hashes
from fathomark.sources.scratch import materialise

SHINGLE = 5
HASHES = 72
ORDERS = 24
LEAST_DEPTH = 3
KEY_DEPTH = 23
REACH = 4
SLACK = 4.0
BLOCK_ROWS = 512
BLOCK_BYTES = 32 << 20
_RNG = np.random.default_rng(20240601)
_MULTIPLY = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in row order."""
    for _, _, data, offsets in chunks(column):
        flat = split_words(data, offsets, lower=True)
        whole = window_hashes(flat.hashes, size)
        for a, b in zip(flat.first[:-1].tolist(), flat.first[1:].tolist()):
            n = b - a
            if n >= size:
                yield np.unique(whole[a : b - size + 1])
            else:
                yield window_hashes(flat.hashes[a:b], n) if n else np.zeros(0, np.uint64)


def signature_rows(size: int, hashes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            count, digest, signature = np.zeros(rows, np.int64), [None] * rows, [None] * rows
            held: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if not held:
                    return
                values = np.concatenate([s for _, s in held])
                at = np.cumsum([0, *[len(s) for _, s in held[:-1]]])
                out = np.empty((len(held), hashes), np.uint32)
                for j in range(hashes):
                    out[:, j] = np.minimum.reduceat((values * _MULTIPLY[j] + _ADD[j]) >> np.uint64(32), at)
                for (row, _), sig in zip(held, out):
                    signature[row] = sig.tobytes()
                held.clear()

            waiting = 0
            for row, found in enumerate(shingle_sets(batch.column("text"), size)):
                count[row] = len(found)
                if len(found):
                    digest[row] = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    held.append((row, found))
                    waiting += len(found)
                    if waiting >= 1 << 16:
                        flush()
                        waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], schema=schema)

    return run


def _permutations(hashes: int, orders: int, depth: int) -> np.ndarray:
    """The signature positions each order compares; first positions differ between orders as far as they can."""
    rng = np.random.default_rng(7)
    rows: list[np.ndarray] = []
    pool: list[int] = []
    for _ in range(orders):
        if len(pool) < LEAST_DEPTH:
            pool = rng.permutation(hashes).tolist()
        head = [pool.pop() for _ in range(LEAST_DEPTH)]
        rest = [p for p in rng.permutation(hashes).tolist() if p not in head]
        rows.append(np.array(head + rest[: depth - LEAST_DEPTH]))
    return np.stack(rows)


def _order_rows(hashes: int, orders: int, least: int, depth: int):
    """Sort keys of each order: its first ``least`` values whole, the low byte of each further one."""
    perms = _permutations(hashes, orders, depth)
    schema = pa.schema([("ord", pa.int32()), ("key", pa.binary()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, hashes)
            width = depth + 3 * least
            for t, perm in enumerate(perms):
                head = np.ascontiguousarray(sig[:, perm[:least]]).astype(">u4").view(np.uint8)
                keys = np.hstack([head, sig[:, perm[least:]].astype(np.uint8)]).tobytes()
                key = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, len(keys) + 1, width, dtype=np.int32)), pa.py_buffer(keys)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), key, batch.column("id")], schema=schema)

    return run


def _neighbours(order: np.ndarray, keys: np.ndarray, ids: np.ndarray, reach: int, least: int):
    """Pairs (smaller id, larger id) among sorted rows."""
    left, right = [], []
    for step in range(1, min(reach, len(ids) - 1) + 1):
        same = (order[step:] == order[:-step]) & (keys[step:, : 4 * least] == keys[:-step, : 4 * least]).all(1)
        left.append(ids[:-step][same])
        right.append(ids[step:][same])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _neighbour_rows(reach: int, least: int, depth: int):
    """Pairs of a sorted partition; its first and last ``reach`` rows come back as border rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ord", pa.int32()), ("key", pa.binary())])

    def columns(batch):
        n = batch.num_rows
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(n, depth + 3 * least)
        return batch.column("ord").to_numpy(), keys, batch.column("id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if seen < reach:
                yield border(now, slice(0, reach - seen))
            n = len(now[2])
            joined = now if carry is None else tuple(np.concatenate([c, x]) for c, x in zip(carry, now))
            a, b = _neighbours(*joined, reach, least)
            # Pairs among the carried rows alone were given with the batch before; the later distinct() folds them.
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], schema=schema)
            carry, seen = tuple(x[-reach:] for x in joined), seen + n
        if carry is not None and seen > reach:
            yield border(carry, slice(-min(reach, seen - reach), None))

    def border(part, rows: slice) -> pa.RecordBatch:
        order, keys, ids = (x[rows] for x in part)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(order), pa.array([k.tobytes() for k in keys], pa.binary())], schema=schema)

    return run


def candidate_pairs(classes: DataFrame, hashes: int = HASHES, orders: int = ORDERS, reach: int = REACH, least: int = LEAST_DEPTH, depth: int = KEY_DEPTH) -> DataFrame:
    """Distinct (a, b), a < b, from ``classes`` with columns id and signature."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("id", "signature").mapInArrow(_order_rows(hashes, orders, least, depth), "ord int, key binary, id long")
    by = ["ord", "key", "id"]
    near = _neighbour_rows(reach, least, depth)
    out = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(near, "a long, b long, ord int, key binary")
    out = materialise(out, "neighbours")
    # The borders of the partitions, in order: 2 * reach rows for each of `parts` partitions, whatever the input.
    edge = out.filter("b is null").select("ord", "key", F.col("a").alias("id")).coalesce(1).sortWithinPartitions(*by)
    border = edge.mapInArrow(near, "a long, b long, ord int, key binary")
    return out.union(border).filter("b is not null").select("a", "b").distinct()


def _similar_rows(hashes: int, at_least: float):
    """Candidates whose one-byte signatures agree often enough, with the estimated similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("estimate", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, hashes) for c in ("sketch_a", "sketch_b"))
            share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            keep = share >= at_least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(share[keep])], schema=schema)

    return run


def _confirm_rows(size: int, percent: int):
    """Pairs with 100 * intersection >= percent * union on the full sets of both texts."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=schema)

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm_rows(size, percent), "u long, v long")


def _bucket_rows(hashes: int, orders: int, least: int, depth: int):
    """(bucket, id): a number of each order's first ``least`` values."""
    perms = _permutations(hashes, orders, depth)[:, :least]
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, hashes).astype(np.uint64)
            for t, perm in enumerate(perms):
                h = np.full(len(sig), t, np.uint64)
                for column in perm.tolist():
                    h = mix(h ^ mix(sig[:, column] + np.uint64(1 << 32)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id")], schema=schema)

    return run


def saturated(classes: DataFrame, hashes: int = HASHES, orders: int = ORDERS, reach: int = REACH, least: int = LEAST_DEPTH, depth: int = KEY_DEPTH) -> DataFrame:
    """(node, component): the region of each class with a prefix that more than ``reach`` + 1 classes share."""
    rows = classes.select("id", "signature").mapInArrow(_bucket_rows(hashes, orders, least, depth), "bucket long, id long")
    full = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("v")).filter(F.col("n") > reach + 1).select("bucket", "v")
    full = materialise(full, "buckets")
    return components(rows.join(full, "bucket").select(F.col("id").alias("u"), "v"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each set of ``left`` with each set of ``right`` (sets sorted, values distinct)."""
    nl, nr = len(left), len(right)
    counts = np.zeros((nl, nr), np.int64)
    if not nl or not nr:
        return counts
    flat = [np.concatenate(x) for x in (left, right)]
    vocabulary = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    if not len(vocabulary):
        return counts
    entries = []
    for sets, values in zip((left, right), flat):
        term = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        known = vocabulary[term] == values
        doc, term = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known], term[known]
        order = np.argsort(term, kind="stable")
        entries.append((doc[order], term[order], np.searchsorted(term[order], np.arange(len(vocabulary) + 1))))
    (ldoc, lterm, lfirst), (rdoc, rterm, rfirst) = entries
    often = np.diff(lfirst) * np.diff(rfirst) * 64 > nl * nr
    # Frequent values: products of 0/1 matrices, whose sums are exact.
    terms = np.flatnonzero(often)
    for k in range(0, len(terms), 4096):
        some = terms[k : k + 4096]
        sides = []
        for n, doc, first in ((nl, ldoc, lfirst), (nr, rdoc, rfirst)):
            table = np.zeros((n, len(some)), np.float32)
            for column, t in enumerate(some.tolist()):
                table[doc[first[t] : first[t + 1]], column] = 1
            sides.append(table)
        counts += (sides[0] @ sides[1].T).astype(np.int64)
    # Rare values: the pairs of their holders.
    rare = ~often[lterm]
    doc, start, size = ldoc[rare], rfirst[lterm[rare]], np.diff(rfirst)[lterm[rare]]
    if len(doc):
        part = np.cumsum(size) >> 21
        for a, b in zip(cuts := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), [*cuts[1:], len(doc)]):
            n = size[a:b]
            at = np.repeat(start[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            counts += np.bincount(np.repeat(doc[a:b], n) * nr + rdoc[at], minlength=nl * nr).reshape(nl, nr)
    return counts


def _block_links(size: int, percent: int):
    """Links between different groups of a pair of blocks, reduced to a forest over the groups."""

    def run(table: pa.Table) -> pa.Table:
        sets = [s for chunk in table.column("text").chunks for s in shingle_sets(chunk, size)]
        ids, group, own, lo, hi = (table.column(c).to_numpy() for c in ("id", "grp", "own", "lo", "hi"))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        common = overlaps([sets[i] for i in left], [sets[i] for i in right])
        length = np.array([len(s) for s in sets], np.int64)
        whole = length[left][:, None] + length[right][None, :] - common
        i, j = np.nonzero((common > 0) & (100 * common >= percent * whole) & (group[left][:, None] != group[right][None, :]))
        i, j = left[i], right[j]
        ends = np.stack([np.minimum(group[i], group[j]), np.maximum(group[i], group[j])], 1)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        keep = []
        for k in np.unique(ends, axis=0, return_index=True)[1].tolist() if len(i) else ():
            a, b = root(int(ends[k, 0])), root(int(ends[k, 1]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                keep.append(k)
        return pa.table({"u": pa.array(ids[i[keep]], pa.int64()), "v": pa.array(ids[j[keep]], pa.int64())})

    return run


def region_links(regions: DataFrame, group: DataFrame, texts: DataFrame, size: int, percent: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v): links between groups inside regions, from all pairs of a region's classes that groups part.

    ``regions`` and ``group``: node, component; a class without a group is its own. ``texts``: id, text.
    """
    known = group.select("node", F.col("component").alias("grp"))
    member = regions.select("node", F.col("component").alias("region")).join(known, "node", "left").select(F.col("node").alias("id"), "region", F.coalesce("grp", "node").alias("grp"))
    # Texts are fetched for regions with two groups or more only.
    split = member.groupBy("region").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x < y").select("region")
    rows = materialise(member.join(split, "region").join(texts, "id"), "regions")
    blocks = F.ceil(F.greatest(F.count("*") / block_rows, F.sum(F.octet_length("text")) / block_bytes, F.lit(1.0))).cast("int")
    open_ = rows.groupBy("region").agg(blocks.alias("blocks"))
    rows = rows.join(open_, "region").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "grp", "text")
    return dealt.groupBy("region", "lo", "hi").applyInArrow(_block_links(size, percent), "u long, v long")


def _sketch(hashes: int):
    """The low byte of each signature value."""
    schema = pa.schema([("id", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, hashes).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in sig], pa.binary())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = 75, hashes: int = HASHES, orders: int = ORDERS, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest id with an equal set).

    Words are lower-cased (A-Z) runs between ASCII white space; a text of fewer than ``size`` words is one
    shingle. Null, empty and blank texts have no shingles and link with nothing: each is its own component.
    Rows with a null id come back with nulls and kept = true. Rows that share an id: each comes back, and they
    belong to one component if any of them links. Other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(signature_rows(size, hashes), "doc_id long, n_shingles long, class binary, signature binary")
    rows = materialise(rows, "signatures")
    known = rows.filter("doc_id is not null and class is not null")
    classes = materialise(known.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes")
    # Ids shared by unequal rows stand for each of their classes, which are linked through the id.
    known_ids = classes.groupBy("id").agg(F.first("signature").alias("signature"))
    pairs = candidate_pairs(known_ids, hashes, orders, reach)

    sketch = classes.select("id", "signature").mapInArrow(_sketch(hashes), "id long, sketch binary").dropDuplicates(["id"])
    at_least = percent / 100 - SLACK * float(np.sqrt(percent / 100 * (1 - percent / 100) / hashes))
    both = pairs.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    similar = both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_similar_rows(hashes, at_least), "a long, b long, estimate double")
    similar = materialise(similar, "similar")

    # A text of each class representative; rows that share the id and the set are equal in what is compared.
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    best = similar.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    tree = materialise(confirmed(best, texts, size, percent), "links")
    group = components(tree)
    left = group.select(F.col("node").alias("a"), F.col("component").alias("ga"))
    right = group.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    rest = similar.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("ga", "a") != F.coalesce("gb", "b"))
    rest = rest.join(best, ["a", "b"], "left_anti")
    # The stars of the groups stand for their links.
    links = stars_of(group).union(confirmed(rest, texts, size, percent))

    # Rows of one class reach its smallest id.
    member = known.select("doc_id", "class").join(classes.select("class", F.col("id").alias("class_id")), "class").select("doc_id", "class_id")
    twin = member.groupBy("doc_id").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v")).filter("u < v").select("u", "v")
    group = components(links.union(twin))
    more = region_links(saturated(known_ids, hashes, orders, reach), group, texts, size, percent)
    group = components(stars_of(group).union(more)).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    member = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).join(group, "class_id", "left")
    out = rows.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    component = F.coalesce("component_id", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the documents that are not the smallest id of their component.

    Rows with a null id and texts without words stay; repeated rows of a kept id all stay.
    """
    (gone_id,) = free_names(docs.columns, "gone_id")
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
