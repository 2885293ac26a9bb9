"""Exact Jaccard join of documents on word n-grams, as a join in the metric space of Jaccard distance.

The distance of two sets is 1 - intersection / union; documents within ``reach`` = 1 - percent / 100 are linked.

1. Documents with equal sets form one class, represented by its smallest id; only classes are compared.
2. Almost all classes lie at distance 1 from each other, where no pivot tells anything. So pivots are found through rare
   n-grams. Let e be the n-grams of a set that a linked set may lack. In any fixed order of the n-grams two linked sets
   share ``l`` of the first ``e + l`` of each. The order puts frequent n-grams last (an estimate from all rows; any
   order is exact). Sets with too few n-grams there that any other set has there can have no link and are put aside.
   The smallest id that holds an n-gram is the pivot of its holders; they form the pivot's region. A set in r regions
   stays in those that hold at least 1 / r of the ``l``: two linked sets keep one in common.
3. Each holder's distance to its pivot is taken on the full sets. Those within ``reach`` are linked to the pivot at once;
   components of these links join most groups. In a region, members of the pivot's group that lie more than ``reach``
   nearer than the nearest stranger cannot link with one (triangle inequality) and are left out; a region of one
   group is done.
4. A region of more than ``block_rows`` members is split: some members are drawn as pivots, every member goes to the
   cell of its nearest one (its Voronoi region), and as a guest to each cell whose pivot is at most 2 * ``reach``
   farther than its own. If x and y are linked, y is in x's cell: d(y, p) <= d(x, p) + reach <= d(x, q) + reach
   <= d(y, q) + 2 * reach for x's pivot p and y's pivot q. Cells are split again while that shrinks them. A region whose
   cells hold as many pairs as itself (its members are guests nearly everywhere) stays whole.
5. What is left is compared directly, in blocks of bounded size, homes with homes and guests.

What a task holds is bounded by about ``block_rows`` members and ``block_grams`` n-grams, or single longer texts. Where
all members of a region are about equally far from each other, pivots part nothing, cells stop shrinking, and the pairs
of blocks are compared: exact, at a cost quadratic in that region. Nothing of the documents reaches the driver but the
hashes of at most ``ranked`` frequent n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomark.functions.small import broadcast_checked
from fathomark.llm.graph import components
from fathomark.llm.near_dup import overlaps, shingle_sets
from fathomark.llm.words import chunks
from fathomark.sources.scratch import materialise

SIZE = 3
PERCENT = 90
RANKED = 1 << 17
OFTEN = 256
BLOCK_ROWS = 512
BLOCK_GRAMS = 2 << 20
PIVOTS = 24
LEVELS = 5
KEYS = 1_000_000  # rows of ids and flags, about 50 bytes each, up to which they are sent to the texts and not the texts to them
SLACK = 1e-9


def _measure_rows(size: int):
    """A row per document (doc_id, n_shingles, class), and rows (gram, often): n-grams frequent in a chunk of texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("gram", pa.int64()), ("often", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi, _, _ in chunks(text):
                sets = list(shingle_sets(text.slice(lo, hi - lo), size))
                n = len(sets)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema
                )
                gram, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
                often = count >= max(3, n / OFTEN)
                if often.any():
                    k = int(often.sum())
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(gram[often].view(np.int64)), pa.array(count[often])], schema=schema)

    return run


def prefix(n: int, percent: int) -> tuple[int, int]:
    """For a set of n: how many first n-grams to look at, and how many of those a linked set has among its own (the smallest
    linked set looks at the fewest)."""
    least = -(-percent * n // 100)
    missing = n - least
    return missing + max(1, missing), max(1, least - -(-percent * least // 100))


def _prefix_rows(size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    """(gram, doc_id, need) of the first n-grams of each document."""
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("need", pa.int32())])
    known, rank = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            text = batch.column("text")
            for lo, hi, _, _ in chunks(text):
                first, owner, mark = [], [], []
                for k, found in enumerate(shingle_sets(text.slice(lo, hi - lo), size)):
                    if not len(found):
                        continue
                    keep, need = prefix(len(found), percent)
                    place = np.zeros(len(found), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        place = np.where(known[at] == found, rank[at], 0)
                    # ``found`` is sorted by hash, so a stable sort breaks ties by hash.
                    few = found[np.argsort(place, kind="stable")[:keep]]
                    first.append(few)
                    owner.append(np.full(len(few), ids[lo + k]))
                    mark.append(np.full(len(few), need))
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(owner), pa.int64()), pa.array(np.concatenate(mark), pa.int32())], schema=schema)

    return run


def _distance_rows(size: int):
    """common and whole: intersection and union of the full sets of both texts of a row."""
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("common", pa.int64()), ("whole", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, whole = [], []
            for x, y in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size)):
                n = len(np.intersect1d(x, y, assume_unique=True))
                common.append(n)
                whole.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("id"), pa.array(common, pa.int64()), pa.array(whole, pa.int64())], schema=schema)

    return run


def _sets(table: pa.Table, size: int, column: str = "text") -> list[np.ndarray]:
    return [s for chunk in table.column(column).chunks for s in shingle_sets(chunk, size)]


def _jaccard(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    common = overlaps(left, right)
    n = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    return common, n[0][:, None] + n[1][None, :] - common


def _cells(size: int, reach: float):
    """Members of a region beside its pivots -> the cells they belong to, as home or as guest."""
    schema = pa.schema([("region", pa.int64()), ("cell", pa.int64()), ("id", pa.int64()), ("guest", pa.bool_())])

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        if not pivots.num_rows:  # none was drawn: the region stays as it is
            return pa.table([members.column("region"), members.column("region"), members.column("id"), members.column("guest")], schema=schema)
        common, whole = _jaccard(_sets(members, size), _sets(pivots, size, "p_text"))
        far = 1 - common / np.maximum(whole, 1)
        nearest = far.argmin(1)
        row, cell = np.nonzero(far <= far.min(1)[:, None] + 2 * reach + SLACK)
        guest = members.column("guest").to_numpy()[row] | (nearest[row] != cell)
        return pa.table([members.column("region").take(row), pivots.column("p_id").take(cell), members.column("id").take(row), pa.array(guest)], schema=schema)

    return run


def _block_links(size: int, percent: int):
    """Links of a pair of blocks between different groups, home with home or guest, reduced to a forest over the groups."""

    def run(table: pa.Table) -> pa.Table:
        sets = _sets(table, size)
        ids, group, own, lo, hi, guest = (table.column(c).to_numpy() for c in ("id", "grp", "own", "lo", "hi", "guest"))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        common, whole = _jaccard([sets[i] for i in left], [sets[i] for i in right])
        near = (common > 0) & (100 * common >= percent * whole)
        near &= (group[left][:, None] != group[right][None, :]) & ~(guest[left][:, None] & guest[right][None, :])
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        keep = []
        for k, (a, b) in enumerate(zip(group[i].tolist(), group[j].tolist())):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                keep.append(k)
        return pa.table({"u": pa.array(ids[i[keep]], pa.int64()), "v": pa.array(ids[j[keep]], pa.int64())})

    return run


def frequent_grams(measured: DataFrame, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that many documents hold: hashes in order, and ranks (the more frequent, the higher); ``ranked`` at most."""
    seen = measured.filter("gram is not null").groupBy("gram").agg(F.sum("often").alias("often"))
    seen = materialise(seen.withColumn("size", F.floor(F.log2("often")).cast("int")), "frequent-grams")
    room, least = ranked, 64
    # One row for each power of two: the largest classes that fit into the bound together.
    for size, n in sorted((tuple(r) for r in seen.groupBy("size").count().collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, size
    rows = seen.filter(F.col("size") >= least).select("gram", "often").toPandas()
    gram, often = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["often"].to_numpy(np.int64)
    order = np.argsort(gram)
    return gram[order], often[order]


def _shared(postings: DataFrame, name: str) -> DataFrame:
    """``postings`` of n-grams that several ids hold, with the smallest as ``region``."""
    shared = postings.groupBy("gram").agg(F.min("doc_id").alias("region"), F.max("doc_id").alias("last")).filter("region < last")
    shared = materialise(shared.select("gram", "region"), f"{name}-grams")
    return materialise(postings.drop("region").join(shared, "gram"), name)


def regions(docs: DataFrame, known: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int, rounds: int = 2) -> DataFrame:
    """(region, id): each pivot with the classes that share one of its rare n-grams. ``known``: id of every class.

    Each round puts more classes aside; the number of rounds changes the work, not the links.
    """
    postings = materialise(docs.mapInArrow(_prefix_rows(size, percent, frequent), "gram long, doc_id long, need int"), "postings")
    for k in range(rounds):
        postings = _shared(postings, f"shared-{k}")
        enough = postings.groupBy("doc_id").agg(F.count("*").alias("have"), F.min("need").alias("need")).filter("have >= need")
        alive = materialise(enough.select("doc_id").join(known.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), "alive")
        postings = postings.join(alive, "doc_id", "left_semi")
    held = _shared(postings, "held").groupBy("region", "doc_id").agg(F.count("*").alias("have"), F.min("need").alias("need"))
    # What two linked sets share here lies in at most as many regions as either is in, so one region has that part of it.
    among = F.count("*").over(Window.partitionBy("doc_id"))
    return held.withColumn("among", among).filter(F.col("have") * F.col("among") >= F.col("need")).select("region", F.col("doc_id").alias("id"))


def _parts(block_rows: int, block_grams: int):
    return F.ceil(F.greatest(F.col("members") / block_rows, F.col("load") / block_grams, F.lit(1.0))).cast("int")


def open_regions(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of the regions that hold two groups and a home, with the region's members and load (n-grams)."""
    state = rows.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("load"), F.min("grp").alias("x"), F.max("grp").alias("y"), F.min("guest").alias("all_guests"))
    state = materialise(state.filter("x < y and not all_guests").select("region", "members", "load"), name)
    return materialise(rows.join(state, "region"), f"{name}-rows")


def split(rows: DataFrame, texts: DataFrame, size: int, reach: float, block_rows: int, block_grams: int, pivots: int, level: int) -> DataFrame:
    """The cells of regions, in the columns of ``region_links``. ``rows``: the same with members and load."""
    salts = _parts(block_rows, block_grams)
    whole = rows.join(texts, "id").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(level)), salts).cast("int"))
    draw = F.pmod(F.xxhash64("id", "region", F.lit(level), F.lit("pivot")), F.col("members"))
    chosen = rows.filter(draw < pivots).join(texts, "id")
    # Other names: both sides of the cogroup come from the same rows.
    chosen = chosen.select(F.col("region").alias("p_region"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("p_salt"), F.col("id").alias("p_id"), F.col("text").alias("p_text"))
    pairs = whole.select("region", "salt", "id", "guest", "text").groupBy("region", "salt").cogroup(chosen.groupBy("p_region", "p_salt"))
    cells = pairs.applyInArrow(_cells(size, reach), "region long, cell long, id long, guest boolean")
    cells = cells.groupBy("region", "cell", "id").agg(F.min("guest").alias("guest"))
    out = cells.join(rows.select("region", "id", "grp", "n", F.col("members").alias("before")), ["region", "id"])
    return out.select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), "id", "guest", "grp", "n", F.col("region").alias("parent"), "before")


def region_links(
    rows: DataFrame, texts: DataFrame, size: int, percent: int, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS, pivots: int = PIVOTS, levels: int = LEVELS
) -> DataFrame:
    """(u, v): links between groups inside regions. ``rows``: region, id, guest, grp, n (set size); ``texts``: id, text."""
    columns = ["region", "id", "guest", "grp", "members", "load"]
    rows = open_regions(rows.withColumn("before", F.lit(None).cast("long")), "regions")
    left = rows.limit(0).select(columns)
    for level in range(levels):
        grown = (F.col("members") > block_rows) & (F.col("before").isNull() | (10 * F.col("members") <= 7 * F.col("before")))
        left = left.unionByName(rows.filter(~grown).select(columns))
        rows = rows.filter(grown)
        if rows.isEmpty():
            break
        cells = open_regions(split(rows, texts, size, 1 - percent / 100, block_rows, block_grams, pivots, level), "cells")
        wide = cells.groupBy("parent").agg(F.sum("members").alias("pairs"), F.max("before").alias("before")).filter("pairs >= before * before")
        wide = broadcast_checked(materialise(wide.select("parent"), "wide"), KEYS)
        left = left.unionByName(rows.join(wide, rows["region"] == wide["parent"], "left_semi").select(columns))
        rows = cells.join(wide, "parent", "left_anti")
    left = left.unionByName(rows.select(columns))
    blocks = _parts(block_rows, block_grams)
    dealt = broadcast_checked(left, KEYS).join(texts, "id").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "grp", "guest", "text")
    return dealt.groupBy("region", "lo", "hi").applyInArrow(_block_links(size, percent), "u long, v long")


def pivot_distances(member: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(region, id, common, whole) of each member and its pivot on the full sets."""
    a = texts.select(F.col("id").alias("region"), F.col("text").alias("text_a"))
    b = texts.select("id", F.col("text").alias("text_b"))
    both = broadcast_checked(member.filter("region <> id"), KEYS).join(a, "region").join(b, "id").select("region", "id", "text_a", "text_b")
    return both.mapInArrow(_distance_rows(size), "region long, id long, common long, whole long")


def jaccard_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, ranked: int = RANKED, **bounds) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (smallest id with an equal set).

    Words are lower-cased (A-Z) runs between ASCII white space; a text of fewer than ``size`` words is one n-gram.
    Documents link where 100 * intersection >= ``percent`` * union; component_id is the smallest id that links reach.
    Null, empty and blank texts have no n-grams and link with nothing. Rows with a null id come back with a null
    component. Rows that share an id: each comes back, and they belong to one component. Other columns of ``docs`` are
    ignored. ``bounds``: block_rows, block_grams, pivots, levels of ``region_links``; no bound changes the rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialise(docs.mapInArrow(_measure_rows(size), "doc_id long, n_shingles long, class binary, gram long, often long"), "measured")
    rows = measured.filter("gram is null").select("doc_id", "n_shingles", "class")
    known = rows.filter("doc_id is not null and class is not null")
    classes = materialise(known.groupBy("class").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n")), "classes")
    ids = classes.groupBy("id").agg(F.max("n").alias("n"))

    given = docs.filter("doc_id is not null")
    member = materialise(regions(given, ids, frequent_grams(measured, ranked), size, percent), "members")
    wanted = materialise(member.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    needed = given.join(broadcast_checked(wanted, KEYS), "doc_id", "left_semi")
    texts = materialise(needed.groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version")).agg(F.first("text").alias("text")).select("id", "text"), "member-texts")
    distance = materialise(pivot_distances(member, texts, size), "distances")

    links = distance.filter((F.col("common") > 0) & (100 * F.col("common") >= percent * F.col("whole"))).select(F.col("region").alias("u"), F.col("id").alias("v"))
    class_of = known.select("doc_id", "class").join(classes.select("class", F.col("id").alias("class_id")), "class").select("doc_id", "class_id")
    twin = class_of.groupBy("doc_id").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v")).filter("u < v").select("u", "v")
    group = components(links.union(twin))

    # Of the pivot's group, only who may lie within reach of the nearest stranger stays (triangle inequality).
    far = 1 - F.col("common") / F.col("whole")
    near = distance.groupBy("region", "id").agg(F.min(far).alias("least"), F.max(far).alias("most"))
    own = group.select(F.col("node").alias("id"), F.col("component").alias("grp"))
    pivot = group.select(F.col("node").alias("region"), F.col("component").alias("pivot_grp"))
    placed = member.join(near, ["region", "id"], "left").join(own, "id", "left").join(pivot, "region", "left").join(ids, "id")
    placed = placed.select("region", "id", F.coalesce("grp", "id").alias("grp"), F.coalesce("pivot_grp", "region").alias("pivot_grp"), "n", F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("most", F.lit(0.0)).alias("most"))
    placed = materialise(placed, "placed")
    stranger = materialise(placed.filter("grp <> pivot_grp").groupBy("region").agg(F.min("least").alias("nearest")), "strangers")
    window = (F.col("grp") != F.col("pivot_grp")) | (F.col("most") >= F.col("nearest") - (1 - percent / 100) - SLACK)
    inside = placed.join(stranger, "region").filter(window).select("region", "id", F.lit(False).alias("guest"), "grp", "n")
    more = region_links(inside, texts, size, percent, **bounds)

    stars = group.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = components(stars.union(more)).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    one = class_of.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).join(joined, "class_id", "left")
    out = rows.select("doc_id", "n_shingles").join(one, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
