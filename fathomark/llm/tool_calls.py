"""Tool calls of conversations: link results by identifier, order, validate, serialise.

A call message is a row whose ``calls`` lists the calls one turn makes; a result row answers one call by its id.

1. Results meet the first call of their (conversation, call id) in a hash join. The answer of a call is the first
   result of a later turn, a grouped minimum; every other result comes back as a row of its own, flagged, as do
   calls without a result. Equal results are counted first, so a repeated id does not multiply rows.
2. A call may name calls it comes after. Those of an earlier turn must exist there; those of the same turn are
   sorted topologically inside the message (Kahn's rounds over the few calls of one row). Order in a conversation
   is (turn, position in the message), so no conversation has to fit one task.
3. Arguments are checked against the tool's schema: known tool, required names, types, no names beyond. Arguments
   without a canonical form are a fault of their call and come back as the text they were.
4. Each call with its result becomes canonical JSON: sorted keys, no blanks, UTF-8, plain numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "struct<id:string,name:string,arguments:string,after:array<string>>"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _finite(number: str) -> float:
    if math.isinf(value := float(number)):
        raise OverflowError(number)
    return value


def parsed(arguments: str):
    """(value, None), or (None, fault) of a text that has no canonical JSON: NaN and infinities, numbers beyond a
    double, half of a surrogate pair, nesting beyond the interpreter's depth, or no JSON at all."""
    try:
        value = json.loads(arguments, parse_constant=_refuse, parse_float=_finite)
        canonical(value).encode()
    except OverflowError:
        return None, "number out of range"
    except UnicodeEncodeError:
        return None, "lone surrogate"
    except RecursionError:
        return None, "nested too deeply"
    except ValueError:
        return None, "not JSON"
    return value, None


def _is_kind(value, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def faults(arguments: str | None, schema: dict | None) -> list[str]:
    """What is wrong with a call's arguments, in a fixed order; empty when they are valid.

    A property's type is a name or a list of names; a name that is no JSON type is a fault of each call that uses it.
    """
    if schema is None:
        return ["unknown tool"]
    value, wrong = parsed(arguments if arguments is not None else "{}")
    if wrong:
        return [wrong]
    if not isinstance(value, dict):
        return ["not an object"]
    known = schema.get("properties", {})
    out = [f"missing {k}" for k in sorted(schema.get("required", ())) if k not in value]
    for key in sorted(value):
        if key not in known:
            out.append(f"unexpected {key}")
            continue
        kind = known[key].get("type") if isinstance(known[key], dict) else None
        kinds = [kind] if isinstance(kind, str) else list(kind or ())
        if strange := [k for k in kinds if k not in _TYPES]:
            out.append(f"{key} has the unknown type {strange[0]}")
        elif kinds and not any(_is_kind(value[key], k) for k in kinds):
            out.append(f"{key} is not {' or '.join(kinds)}")
    return out


def topological(ids: list[str | None], after: list[list[str]]) -> tuple[list[int], set[int]]:
    """(positions in order, positions on a cycle): Kahn's rounds, ties by position; cycles keep their place last.

    Names that are not among ``ids`` do not constrain; of equal ids the first is meant.
    """
    first: dict = {}
    for k, name in enumerate(ids):
        first.setdefault(name, k)
    waits = [{first[a] for a in names if a in first} for names in after]
    open_, follow = [len(w) for w in waits], [[] for _ in ids]
    for k, before in enumerate(waits):
        for b in before:
            follow[b].append(k)
    done: list[int] = []
    ready = [k for k, n in enumerate(open_) if n == 0]
    while ready:
        done += ready
        later = []
        for k in ready:
            for f in follow[k]:
                open_[f] -= 1
                if open_[f] == 0:
                    later.append(f)
        ready = sorted(later)
    left = set(range(len(ids))).difference(done)
    return done + sorted(left), left


def _ordered_rows(messages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in messages:
        rows: list[tuple] = []
        for conv, turn, calls in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "calls"))):
            calls = [c for c in calls or () if c is not None]
            order, cyclic = topological([c["id"] for c in calls], [[a for a in c["after"] or () if a is not None] for c in calls])
            for place, k in enumerate(order):
                c = calls[k]
                rows.append((conv, turn, place, c["id"], c["name"], c["arguments"], c["after"] or [], k in cyclic))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()]
        names = ["conv_id", "turn", "place", "call_id", "name", "arguments", "after", "cyclic"]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)


def _json_rows(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for row in batch.to_pylist():
                wrong = [] if not row["is_call"] else faults(row["arguments"], schemas.get(row["name"]))
                arguments, broken = (None, None) if row["arguments"] is None else parsed(row["arguments"])
                if broken:
                    arguments = row["arguments"]
                found.append(wrong)
                texts.append(canonical({"arguments": arguments, "id": row["call_id"], "name": row["name"], "result": row["result"], "status": row["status"], "valid": not wrong}))
            keep = ["conv_id", "turn", "place", "call_id", "status", "in_order"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*keep, "faults", "json"])

    return run


def link(messages: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per unmatched result: conv_id, turn, place, call_id, status, in_order, faults, json.

    ``messages``: conv_id, turn, calls (array of CALL). ``results``: conv_id, turn, call_id, result. ``status`` is
    linked, unanswered (no result of a later turn), orphan (a result without a call of an earlier turn) or repeated (a
    call id used before in its conversation, which takes no result; or a further result of an answered call). ``in_order`` is false for a call on a cycle, or after a name
    that neither its own message nor an earlier turn has. Null conversation ids, null or empty call lists and null
    results are kept as their own values (a null id links with nothing); other columns are ignored.
    """
    calls = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("calls").cast(f"array<{CALL}>").alias("calls"))
    calls = calls.mapInArrow(_ordered_rows, "conv_id long, turn long, place int, call_id string, name string, arguments string, after array<string>, cyclic boolean")
    # The first use of each id in a conversation; a grouped minimum, combined before the shuffle.
    first = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("first"))
    calls = calls.join(first, ["conv_id", "call_id"], "left")
    calls = calls.withColumn("repeated", F.coalesce((F.col("turn") != F.col("first.turn")) | (F.col("place") != F.col("first.place")), F.lit(False)))

    names = calls.filter(F.size("after") > 0).select("conv_id", "turn", "place", "call_id", F.explode("after").alias("name_after"))
    earlier = first.select(F.col("conv_id").alias("e_conv"), F.col("call_id").alias("e_id"), F.col("first.turn").alias("e_turn"))
    broken = names.join(earlier, (F.col("conv_id") == F.col("e_conv")) & (F.col("name_after") == F.col("e_id")) & (F.col("e_turn") <= F.col("turn")), "left_anti")
    broken = broken.select("conv_id", "turn", "place", "call_id").distinct().withColumn("broken", F.lit(True))
    on = ["conv_id", "turn", "place", "call_id"]
    calls = calls.alias("x").join(broken.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in on], "left").select("x.*", "y.broken")

    answers = results.select(F.col("conv_id").cast("long").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("turn").cast("long").alias("r_turn"), "result")
    answers = answers.groupBy("r_conv", "r_id", "r_turn", "result").agg(F.count("*").alias("n"))
    begun = first.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("first.turn").alias("c_turn"))
    answers = answers.join(begun, ["r_conv", "r_id"], "left").withColumn("late", F.coalesce(F.col("r_turn") > F.col("c_turn"), F.lit(False)))
    chosen = answers.filter("late").groupBy("r_conv", "r_id").agg(F.min(F.struct("r_turn", "result")).alias("answer"))
    # All results but one copy of each answer.
    rest = answers.join(chosen, ["r_conv", "r_id"], "left")
    taken = F.col("late") & F.col("r_turn").eqNullSafe(F.col("answer.r_turn")) & F.col("result").eqNullSafe(F.col("answer.result"))
    rest = rest.withColumn("left", F.col("n") - F.when(taken, 1).otherwise(0)).filter(F.col("left") > 0)
    rest = rest.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
    none = F.lit(None).cast("string")
    rest = rest.select(
        F.col("r_conv").alias("conv_id"), F.col("r_turn").alias("turn"), F.lit(0).alias("place"), F.col("r_id").alias("call_id"), none.alias("name"), none.alias("arguments"), "result",
        F.when(F.col("late"), "repeated").otherwise("orphan").alias("status"), F.lit(False).alias("in_order"), F.lit(False).alias("is_call"),
    )
    meets = (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")) & ~F.col("repeated")
    both = calls.join(chosen, meets, "left")
    status = F.when(F.col("repeated"), "repeated").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    in_order = ~F.coalesce("cyclic", F.lit(False)) & F.col("broken").isNull()
    both = both.select("conv_id", "turn", "place", "call_id", "name", "arguments", F.col("answer.result").alias("result"), status.alias("status"), in_order.alias("in_order"), F.lit(True).alias("is_call"))
    rows = rest.union(both)
    return rows.mapInArrow(_json_rows(schemas), "conv_id long, turn long, place int, call_id string, status string, in_order boolean, faults array<string>, json string")


# The tools of the query below.
SCHEMAS = {
    "note": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text", "turn"]},
    "answer": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}, "lines": {"type": "integer"}}, "required": ["text", "turn", "lines"]},
}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain turns: (messages, results) for ``link``.

    A system or user turn makes one ``note`` call per line of its text and an ``answer`` call, listed first, that
    comes after the notes; an assistant turn answers the ``answer`` call of the turn before it. Repeated rows of a
    turn are one (the least text).
    """
    turns = conversations.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    turns = turns.select("conv_id", "turn", "t.role", "t.text")
    name = lambda k: F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.col("turn"), k)
    lines = F.split("text", "\n")
    note = lambda x, i: F.struct(name(i + 1).alias("id"), F.lit("note").alias("name"), F.to_json(F.struct(x.alias("text"), F.col("turn").alias("turn"))).alias("arguments"), F.array().cast("array<string>").alias("after"))
    answer = F.struct(
        name(F.lit(0)).alias("id"), F.lit("answer").alias("name"), F.to_json(F.struct(F.size(lines).alias("lines"), F.col("text").alias("text"), F.col("turn").alias("turn"))).alias("arguments"),
        F.transform(lines, lambda x, i: name(i + 1)).alias("after"),
    )
    messages = turns.filter("role <> 'assistant'").select("conv_id", "turn", F.concat(F.array(answer), F.transform(lines, note)).alias("calls"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.col("turn") - 1, F.lit(0)).alias("call_id"), F.col("text").alias("result"))
    return messages, results
