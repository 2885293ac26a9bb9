"""Top-k search, tool calls and the pipeline against brute force."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fathomark.llm import tool_calls, topk

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score long, rank int"


def brute_top(rows, k, scale=64):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(float(np.float32(x)) * scale) for x in v]
            good[i] = max(good.get(i, w), w)
    out = []
    for q, v in good.items():
        if q % 5 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("group_rows,chunk,block", [(topk.GROUP_ROWS, topk.CHUNK, topk.BLOCK), (40, 3, 8)])
def test_top_k_equals_brute_force(spark, group_rows, chunk, block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(300, None), (305, []), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (315, [float("nan")] * 6), (320, [float("inf")] * 6), (325, [1.0, 2.0]), (326, [2.0, 1.0]), (None, [1.0] * 6), (0, [9.0] * 6), (0, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=7, group_rows=group_rows, chunk=chunk, block=block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7)


def test_top_k_of_nothing_and_of_one(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1, 1)], VECTORS), F.col("vec_id") % 5 == 0).count() == 0


def test_vectors_reach_the_search_as_columns(spark, capsys):
    """No row of a group is turned into a Python object."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], 1, 1) for i in range(60)], VECTORS)
    topk.top_k(df, F.col("vec_id") % 5 == 0, k=3, group_rows=20).explain()
    plan = capsys.readouterr().out
    assert "CoGroupsInArrow" in plan and "InPandas" not in plan


def test_a_block_is_scored_for_all_its_queries_at_once(monkeypatch):
    """The rounds of 256 queries over 16 blocks need far fewer matrix products than there are pairs."""
    rng = np.random.default_rng(1)
    vectors, ids = rng.integers(-9, 10, (256, 8)), rng.permutation(256)
    products = []
    split = np.split
    monkeypatch.setattr(topk.np, "split", lambda a, at: products.append(len(at) + 1) or split(a, at))
    found, scored = topk.search_group(ids, vectors, ids, vectors, np.full(256, -(2.0**53)), 5, block=16)
    assert scored > 20 * sum(products)
    rows = list(found.itertuples(index=False, name=None))
    for i in range(256):
        best = sorted((-int(vectors[i] @ vectors[j]), int(ids[j])) for j in range(256) if j != i)[:5]
        assert [(v, s) for q, v, s in rows if q == ids[i]] == [(j, -s) for s, j in best]


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (40, 16))
    vectors = np.repeat(centres, 64, 0) + rng.integers(-3, 4, (2560, 16))
    ids = np.arange(2560)
    found, scored = topk.search_group(ids, vectors, ids[:50], vectors[:50], np.full(50, -(2.0**53)), 10, block=64)
    assert scored < 50 * 10
    for q in range(50):
        score = vectors @ vectors[q]
        score[q] = -(10**9)
        assert sorted(found[found.query_id == q].score, reverse=True) == sorted(score.tolist(), reverse=True)[:10]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=3), max_size=7))
def test_topological_order(after):
    ids = [str(k) for k in range(len(after))]
    order, cyclic = tool_calls.topological(ids, [[str(a) for a in names] for names in after])
    assert sorted(order) == list(range(len(after)))
    place = {k: n for n, k in enumerate(order)}
    assert all(place[a] < place[k] for k, names in enumerate(after) for a in names if a < len(after) and k not in cyclic)


def test_link_orders_validates_and_serialises(spark):
    call = lambda i, name="note", args=None, after=(): (i, name, json.dumps(args if args is not None else {"turn": 1, "text": "é"}), list(after))
    messages = [
        (1, 0, [call("a", after=["b"]), call("b"), call("c", args={"text": 3, "turn": True, "z": 1})], "clash"),
        (1, 2, [call("a"), call("d", after=["a"]), call("e", after=["nowhere"]), call("x", "odd", {}), ("n", "note", None, None)], "clash"),
        (1, 4, [call("p", after=["q"]), call("q", after=["p"])], "clash"), (2, 0, None, "clash"), (2, 1, [], "clash"), (None, 0, [call("a")], "clash"), (3, 5, [("j", "note", "{bad", None)], "clash"),
    ]
    results = [(1, 1, "a", "first"), (1, 3, "a", "late"), (1, 1, "b", None), (1, 3, "ghost", "g"), (1, 0, "c", "too early"), (None, 1, "a", "null")]
    m = spark.createDataFrame(messages, f"conv_id long, turn long, calls array<{tool_calls.CALL}>, json string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, result string")
    got = {(x.conv_id, x.turn, x.call_id): x for x in tool_calls.link(m, r, tool_calls.SCHEMAS).collect()}
    first = got[1, 0, "a"]
    assert (first.status, first.place, first.in_order, first.faults) == ("linked", 2, True, [])
    assert first.json == '{"arguments":{"text":"é","turn":1},"id":"a","name":"note","result":"first","status":"linked","valid":true}'
    assert got[1, 0, "b"].place == 0 and got[1, 0, "b"].status == "linked"
    assert got[1, 0, "c"].faults == ["text is not string", "turn is not integer", "unexpected z"]
    assert got[1, 2, "a"].status == "repeated" and got[1, 2, "d"].in_order and not got[1, 2, "e"].in_order
    assert got[1, 2, "x"].faults == ["unknown tool"] and got[1, 2, "n"].faults == ["missing text", "missing turn"]
    assert not got[1, 4, "p"].in_order and not got[1, 4, "q"].in_order
    assert got[1, 3, "ghost"].status == "orphan" and got[3, 5, "j"].faults == ["not JSON"]
    assert got[None, 0, "a"].status == "unanswered" and got[None, 1, "a"].status == "orphan"
    # A result before its call is no answer.
    assert got[1, 0, "c"].status == "unanswered"
    empty = tool_calls.link(m.limit(0), r.limit(0), tool_calls.SCHEMAS)
    assert empty.count() == 0


def test_arguments_without_canonical_json_are_faults(spark):
    deep = '{"text":' + "[" * 100_000 + "]" * 100_000 + "}"
    bad = {
        "nan": ('{"text":NaN,"turn":1}', "not JSON"), "inf": ('{"text":"a","turn":-Infinity}', "not JSON"), "big": ('{"text":"a","turn":1e400}', "number out of range"),
        "half": ('{"text":"\\ud800","turn":1}', "lone surrogate"), "key": ('{"\\udc00":1}', "lone surrogate"), "deep": (deep, "nested too deeply"), "digits": ('{"text":"a","turn":' + "9" * 5000 + "}", "not JSON"),
        "empty": ("", "not JSON"), "list": ("[]", "not an object"),
    }
    m = spark.createDataFrame([(1, 0, [(k, "note", a, []) for k, (a, _) in bad.items()])], f"conv_id long, turn long, calls array<{tool_calls.CALL}>")
    r = spark.createDataFrame([], "conv_id long, turn long, call_id string, result string")
    got = {x.call_id: x for x in tool_calls.link(m, r, tool_calls.SCHEMAS).collect()}
    assert {k: x.faults for k, x in got.items()} == {k: [fault] for k, (_, fault) in bad.items()}
    for k, (a, fault) in bad.items():
        said = json.loads(got[k].json)
        assert said["arguments"] == (a if fault != "not an object" else []) and not said["valid"], k


def test_types_of_a_schema():
    schema = {"properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "decimal"}, "c": True, "d": {}}}
    assert tool_calls.faults('{"a":1,"c":2,"d":[]}', schema) == [] == tool_calls.faults('{"a":null}', schema)
    assert tool_calls.faults('{"a":true,"b":1}', schema) == ["a is not integer or null", "b has the unknown type decimal"]


def test_a_long_chain_of_calls_is_ordered():
    n = 50_000
    order, cyclic = tool_calls.topological([str(k) for k in range(n)], [[str(k + 1)] for k in range(n - 1)] + [[]])
    assert order == list(range(n))[::-1] and not cyclic


def test_every_result_comes_back(spark):
    messages = [(1, 2, [("c", "note", '{"turn":1,"text":"x"}', [])])]
    results = [(1, 0, "c", "early"), (1, 5, "c", "answer"), (1, 5, "c", "answer"), (1, 7, "c", None), (1, 9, "ghost", "g"), (1, 9, "ghost", "g")]
    m = spark.createDataFrame(messages, f"conv_id long, turn long, calls array<{tool_calls.CALL}>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, result string")
    got = sorted((x.turn, x.call_id, x.status, json.loads(x.json)["result"], tuple(x.faults)) for x in tool_calls.link(m, r, tool_calls.SCHEMAS).collect())
    assert got == [
        (0, "c", "orphan", "early", ()), (2, "c", "linked", "answer", ()), (5, "c", "repeated", "answer", ()), (7, "c", "repeated", None, ()),
        (9, "ghost", "orphan", "g", ()), (9, "ghost", "orphan", "g", ()),
    ]


def test_queries_match_sql(spark):
    from oracle import compare, connect

    con = connect(SF)
    for name in ("op1_minhash_near_dedup", "op2_substring_dedup", "op5_decontaminate", "op6_topk", "op10_tool_calls"):
        assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == "", name


def test_pipeline_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        if name == "substring_dedup":
            assert old.keys() == new.keys() and all(len((new[k] or "").split()) <= len((old[k] or "").split()) for k in old)
        else:
            assert new.keys() <= old.keys() and all(new[k] == old[k] for k in new)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "decontamination", "bpe"]
