"""Near-duplicate and substring dedup against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomark.llm import decontaminate, graph, near_dup, substrings


def shingles(text, size=5):
    w = bytes(text or "", "utf8").lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def groups(texts):
    """Component of each id by comparing all texts."""
    rows = [(i, shingles(t)) for i, t in texts if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in parent}


def test_near_duplicates_equal_brute_force(docs, texts):
    got = near_dup.near_duplicates(docs).collect()
    want = groups(texts)
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id), r
    sizes = sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None)
    assert sizes == sorted((i, len(shingles(t))) for i, t in texts if i is not None)


def test_near_duplicates_of_nothing(none):
    assert near_dup.near_duplicates(none).count() == 0


def test_keep_first_keeps_columns_and_one_of_each_group(docs, texts):
    kept = near_dup.keep_first(docs)
    want = groups(texts)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in texts if i is not None and want[i] == i)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (101, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stars_need_no_pass(spark, monkeypatch):
    stars = spark.createDataFrame([(5, 1), (1, 4), (9, 2), (2, 2)], "u long, v long")
    passes = []
    large = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda edges: passes.append(1) or large(edges))
    group = graph.components(stars)
    assert {r.node: r.component for r in group.collect()} == {1: 1, 4: 1, 5: 1, 2: 2, 9: 2} and not passes
    assert graph.components(graph.stars_of(group)).exceptAll(group).count() == 0 and not passes
    path = graph.components(spark.createDataFrame([(k, k + 1) for k in range(9)], "u long, v long"))
    assert {r.component for r in path.collect()} == {0} and passes


def test_dense_region_of_a_shared_passage(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(120)]
    rows = [(k, " ".join(passage + [f"x{k}-{i}" for i in range(rng.randint(5, 15))])) for k in range(150)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_pairs_just_above_the_threshold_among_texts_just_below_it(spark):
    """A core of 120 words and tails of 20: two texts are 0.744 alike, or 0.755 where the tails begin alike."""
    rng = random.Random(3)
    core = [f"c{i}" for i in range(120)]
    tails = {k: [f"x{k}-{i}" for i in range(20)] for k in range(400)}
    order = rng.sample(range(400), 400)
    for a, b in zip(order[:60:2], order[1:60:2]):
        tails[b][0] = tails[a][0]
    rows = [(k, " ".join(core + tail)) for k, tail in tails.items()]
    want = groups(rows)
    assert sum(k != c for k, c in want.items()) == 30
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()} == want


def test_overlaps_and_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, n), rng.integers(0, 5000, n)])).astype(np.uint64) for n in (0, 1, 30, 90, 200, 200)] * 30
    got = near_dup.overlaps(sets[:100], sets[100:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[100:]] for x in sets[:100]]
    texts = [(k, " ".join([f"c{i}" for i in range(60)] + [f"x{k // 2}-{i}" for i in range(10)] + [f"y{k}-{i}" for i in range(k % 4)])) for k in range(60)]
    regions = spark.createDataFrame([(k, 0) for k, _ in texts], "node long, component long")
    links = near_dup.region_links(regions, regions.limit(0), spark.createDataFrame(texts, "id long, text string"), 5, 75, block_rows=9)
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert {k: found.get(k, k) for k, _ in texts} == groups(texts)


def cut(texts, length=13):
    """Kept words of each row by looking at every window."""
    first = {}
    for i, t in texts:
        w = bytes(t or "", "utf8").split()
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in texts:
        w = bytes(t or "", "utf8").split()
        keep = [True] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                keep[k : k + length] = [False] * length
        out.append((i, len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep) if y)))
    return out


def test_substrings_equal_brute_force(docs, texts):
    want = sorted(((-1 if i is None else i), n, gone, hashlib.sha256(k).hexdigest()) for i, n, gone, k in cut(texts))
    # Shards by home; large homes in parts; anchors that are large by themselves by window hashes.
    for limit in (substrings.SHARD_WORDS, 90, 20):
        got = substrings.remove_repeats(docs, shard_words=limit, as_digest=True).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    assert any(gone for _, _, gone, _ in want)


def test_large_homes_are_split_by_hash_of_anchor(spark):
    """One passage heads 60 texts, which share pieces with each other too: every way of settling gives the same spans."""
    rng = random.Random(3)
    common, parts = [f"c{i}" for i in range(40)], [[f"p{k}x{i}" for i in range(20)] for k in range(8)]
    texts = [(i, " ".join(common[rng.randrange(10) :] + [x for _ in range(3) for x in [*parts[rng.randrange(8)], f"u{i}"]])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = [(i, n, gone, hashlib.sha256(k).hexdigest()) for i, n, gone, k in cut(texts)]
    ways = set()
    for limit in (100_000, 500, 30):
        runs = substrings.candidate_runs(docs, shard_words=limit).select("home", "hot").distinct().collect()
        ways.add((max(abs(r.home) for r in runs) > 60, any(r.hot for r in runs)))
        got = substrings.remove_repeats(docs, shard_words=limit, as_digest=True).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert (False, False) in ways and (True, True) in ways


def test_internal_names_may_be_columns(spark, docs, texts):
    """Columns named like the joins' own, in any case, come back as they were."""
    mine = ["gone_id", "cut_id", "CUT_SPANS", "bad_id", "bad_version", "hit_id", "Hit_Version", "hit_spans", "spans", "version", "component_id", "kept", "n_words", "marks", "home"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(mine)])
    items = spark.createDataFrame([(1, "nothing of this is in any text at all, not one bit")], "item_id long, text string")
    for out in (near_dup.keep_first(wide), substrings.cut_repeats(wide), decontaminate.drop_contaminated(wide, items), decontaminate.cut_spans(wide, items)):
        assert out.columns == wide.columns
        rows = out.select(*[F.col(n) for n in mine]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(mine)))]


def test_substrings_of_nothing_and_texts_kept(none, docs, texts):
    assert substrings.remove_repeats(none).count() == 0
    out = substrings.cut_repeats(docs)
    assert out.schema == docs.schema and out.count() == len(texts)
    same = {r.text for r in out.filter("doc_id < 40").collect()}
    assert same == {t for i, t in texts if i is not None and i < 40}
    assert out.filter("doc_id = 400 and text is null").count() == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=5), st.lists(st.integers(0, 4), max_size=20))
def test_matching_statistics(stored, query):
    automaton = substrings.SuffixAutomaton()
    for words in stored:
        automaton.add(words)
    parts = {tuple(w[a:b]) for w in stored for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    want = [max((n for n in range(1, k + 2) if tuple(query[k + 1 - n : k + 1]) in parts), default=0) for k in range(len(query))]
    assert automaton.matching_statistics(query) == want
