"""Fill-in-middle, filter audit and n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomark.llm import fill_middle, filter_audit, ngram_join

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def cut(doc_id, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) by the regular expression itself."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_regular_expression(spark, texts):
    rng = random.Random(2)
    more = [(1000 + i, "".join(rng.choice(["ä", "語", "🙂", "a", " ", "\t", "\n", "\x0b", " ", "<", "P>"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    more += [(2000, "x <P> y"), (2001, "   "), (2002, " lead"), (2003, "trail \n"), (2004, "w"), (2005, "é " * 200_000), (2005, "other text of the same id"), (2006, "<" * 40), (2006, "<" * 40)]
    rows = texts + more
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n long")
    for block in (fill_middle.BLOCK, 3):
        out = fill_middle.fill_in_middle(frame, block=block)
        out = out.withColumn("back", fill_middle.restored("output", "form")).collect()
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted(((i, *cut(i, t)) for i, t in rows), key=key)
        assert Counter(r.back for r in out) == Counter(t or "" for _, t in rows)
    forms = Counter(r.form for r in out)
    assert forms["spm"] > forms["psm"] > 0 and forms["plain"] > 0


def test_fill_in_middle_of_nothing(none):
    assert fill_middle.fill_in_middle(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70))
def test_fenwick_tree(counts):
    tree = fill_middle.FenwickTree(np.array([counts, counts], np.int64).reshape(2, -1))
    total = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    assert tree.before(np.arange(len(counts) + 1), 1).tolist() == total.tolist()
    target = np.arange(1, total[-1] + 1)
    block, left = tree.descend(target, 0)
    want = np.searchsorted(total, target) - 1
    assert block.tolist() == want.tolist() and left.tolist() == (target - total[want]).tolist()


WORD = re.compile("[^\x20\x09-\x0d]+")


def audited(docs, labels):
    """All rows by looking at every document in every order."""
    bits = []
    for i, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        marks = [(q, x) for j, q, x in labels if j is not None and j == i]
        bits.append((part or "", fails, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    parts = {p for p, *_ in bits}
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for k, letter in enumerate(order):
            for part in parts:
                mine = [(f, g, t) for p, f, g, t in bits if p == part]
                gone = [any(f[x] for x in order[:k]) for f, _, _ in mine]
                removed = [f[letter] and not z for (f, _, _), z in zip(mine, gone)]
                shapley[part, letter] += sum(removed)
                out[part, order, k + 1] = [
                    sum(not z and not f[letter] for (f, _, _), z in zip(mine, gone)), sum(removed), sum(f[letter] and z for (f, _, _), z in zip(mine, gone)),
                    sum(f[letter] and sum(f.values()) == 1 for f, _, _ in mine), sum(r and g for r, (_, g, _) in zip(removed, mine)), sum(r and t for r, (_, _, t) in zip(removed, mine)),
                ]
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeABé") for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.choice([5, 199, 200, 201, 300]))) for _ in range(25)]
    base += [" ".join(["same"] * k) for k in (0, 1, 200, 400)] + [" ".join(f"w{i}" for i in range(250)) + x for x in ("", " #", " A" * 60, " |")] + [" \n\t "]
    docs = [(k, t, rng.choice(["p", "q", "", None])) for k, t in enumerate(base)]
    docs += [(100 + k, rng.choice(base), rng.choice(["p", "q"])) for k in range(60)]
    docs += [(None, base[0], "p"), (None, None, None), (500, None, "q"), (501, "", "q"), (3, base[3], "p"), (3, base[3], "p"), (3, "different text", "z"), (600, " ".join(word() for _ in range(30_000)), "long")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "bits", 9) for d in docs], "doc_id long, text string, source string, hash string, n long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marks).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == audited(docs, labels)
    assert len(got) == 600 * len({r.part for r in got})


def test_audit_of_nothing(spark, none):
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def sets_of(text, size=3):
    w = bytes(text or "", "utf8").lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def joined(rows, percent=90):
    """Component of each id by comparing all texts."""
    rows = [(i, sets_of(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if a != b and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in parent}


def test_join_equals_brute_force_on_mixed_texts(docs, texts):
    got = ngram_join.jaccard_join(docs).collect()
    want = joined(texts)
    assert len(got) == len(texts)
    for r in got:
        assert r.component_id is None if r.doc_id is None else r.component_id == want[r.doc_id], r
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(sets_of(t))) for i, t in texts if i is not None)


def test_join_of_nothing(none):
    assert ngram_join.jaccard_join(none).count() == 0


@pytest.fixture(scope="module")
def dense():
    """Many texts at distances around the threshold: chains of edits, templates, and groups that touch at their borders."""
    rng = random.Random(8)
    rows = []
    for base in range(4):
        words = [f"b{base}-{i}" for i in range(120)]
        for k in range(120):
            mine = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4])):
                mine[rng.randrange(120)] = rng.choice(["x", "y", f"z{k}"])
            rows.append((len(rows), " ".join(mine)))
    template = [f"t{i}" for i in range(150)]
    rows += [(len(rows) + k, " ".join(template + [f"own{k}-{i}" for i in range(rng.randint(6, 10))])) for k in range(150)]
    rng.shuffle(rows)
    return rows


def test_join_equals_brute_force_in_dense_regions(spark, dense):
    frame = spark.createDataFrame(dense, "doc_id long, text string")
    want = joined(dense)
    sizes = Counter(want.values())
    assert len(sizes) > 20 and max(sizes.values()) > 5
    for bounds in ({}, {"block_rows": 40, "pivots": 3, "levels": 2, "block_grams": 2000}):
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(frame, **bounds).collect()}
        assert got == want, bounds


def test_a_region_that_cells_do_not_part_is_compared_once(spark, monkeypatch):
    """60 texts about equally far from each other, and one copy: each text is dealt once, not once for every cell."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(60)]
    texts.append((60, texts[7][1] + " end"))
    rows = spark.createDataFrame([(0, i, False, i, 18) for i, _ in texts], "region long, id long, guest boolean, grp long, n long")
    dealt, checked = [], ngram_join.broadcast_checked
    monkeypatch.setattr(ngram_join, "broadcast_checked", lambda df, most: dealt.append(df) or checked(df, most))
    links = ngram_join.region_links(rows, spark.createDataFrame(texts, "id long, text string"), 3, 90, block_rows=10, pivots=6)
    assert {tuple(r) for r in links.collect()} in ({(7, 60)}, {(60, 7)})
    assert dealt[-1].count() == 61


def test_cells_keep_every_link_and_part_the_groups(spark, dense):
    """Splitting alone: every linked pair of different groups meets in a cell where one of them is at home."""
    rows = spark.createDataFrame([(7, i, False, i, len(sets_of(t)), len(dense), 0) for i, t in dense], "region long, id long, guest boolean, grp long, n long, members long, load long")
    texts = spark.createDataFrame(dense, "id long, text string")
    cells = ngram_join.split(rows, texts, 3, 0.1, 50, 1 << 20, 12, 0).collect()
    homes, there = {}, {}
    for c in cells:
        there.setdefault(c.region, set()).add(c.id)
        if not c.guest:
            assert c.id not in homes
            homes[c.id] = c.region
    assert set(homes) == {i for i, _ in dense}
    known = {i: sets_of(t) for i, t in dense}
    for a, x in known.items():
        for b, y in known.items():
            if a < b and 100 * len(x & y) >= 90 * len(x | y):
                assert b in there[homes[a]] and a in there[homes[b]]
    assert max(map(len, there.values())) < len(dense)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=40), st.sets(st.integers(0, 40), max_size=4), st.sets(st.integers(0, 40), max_size=4))
def test_prefixes_of_linked_sets_share_enough(x, add, drop):
    y = (x | add) - drop
    if not y or 100 * len(x & y) < 90 * len(x | y):
        return
    (keep_x, need_x), (keep_y, need_y) = (ngram_join.prefix(len(s), 90) for s in (x, y))
    assert len(set(sorted(x)[:keep_x]) & set(sorted(y)[:keep_y])) >= max(need_x, need_y)


def test_frequent_grams_are_bounded(spark):
    rows = [(g, c) for g, c in [(1, 3), (2, 5), (3, 900), (4, 1000), (5, 2), (-6, 950)]]
    frame = spark.createDataFrame(rows, "gram long, often long")
    gram, rank = ngram_join.frequent_grams(frame, ranked=4)
    assert dict(zip(gram.view(np.int64).tolist(), rank.tolist())) == {3: 900, 4: 1000, -6: 950, 2: 5}
    assert len(ngram_join.frequent_grams(frame.filter(F.lit(False)), ranked=4)[0]) == 0
