"""Tool calls and their results in conversations: linked, ordered, validated, written as canonical JSON.

A message may make calls (id, name and arguments, a JSON text) or, with role ``tool``, bring the result of
one.  Calls and results are joined by conversation and identifier.  A call whose arguments hold
``{"$ref": id}`` needs the result of that call; so results come behind their calls and calls behind the
results they need.  The order is the given one (turn, place in the message), except that whatever stands
before something it needs moves right behind it: a node sorts by the largest place among itself and all it
rests on, then by the steps from there, then by its own place.

The order is found by rounds over all conversations at once.  First the places spread along the edges, told on
only by nodes that moved; then nodes of one largest place are peeled from it for their steps.  Nodes whose needs
all come before themselves take part in neither, so conversations in order take one round; otherwise rounds are
as many as the longest chain behind a place that is later than its own nodes.  What cannot be peeled lies on a
cycle or behind one; the strongly connected parts tell which, and every member of a cycle is marked.

Each call and result is one row: status ``ok``, ``unanswered`` (call), ``orphan`` (result without a call),
``duplicate`` (a later call or result of an identifier that is taken) or ``cyclic`` (needs itself through
others; such rows keep their own places and nothing waits for them, rows behind a cycle are not cyclic).  problems lists what is wrong with the arguments.  Rows without conversation or identifier link
with nothing and are orphans or unanswered; arguments that are null count as empty text and are no JSON.
"""

from __future__ import annotations

import functools
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import importable, materialize

CHECKED = "canonical string, problems array<string>, refs array<string>"
TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,),
         "null": (type(None),)}


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> object:
    """A JSON text; repeated keys, NaN and infinities are errors."""
    value = json.loads(text or "", object_pairs_hook=_unique, parse_constant=_no_constant)
    return _finite(value)


def _finite(value: object) -> object:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("number out of range")
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)  # 1.0 and 1 are one number
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    """Keys in order of their code points, no blanks, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def references(value: object) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, properties, required, additionalProperties, items, minimum, maximum.

    A reference stands for a value of any type.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of range")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                out += problems(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    return out


def check(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str], list[str]]:
    """Canonical arguments (null if they are no JSON), their problems, the identifiers they refer to."""
    try:
        value = parse(arguments)
        written = canonical(value)
        written.encode()  # an escape of half a surrogate pair stands for no character
    except (ValueError, RecursionError):
        return None, ["$: no JSON"], []
    wrong = problems(value, schemas[name]) if name in schemas else ["$: unknown tool"]
    return written, wrong, sorted(set(references(value)))


def checked(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    importable()

    @F.pandas_udf(CHECKED)
    def run(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(n, t, schemas) for n, t in zip(names, texts, strict=True)], columns=["canonical", "problems", "refs"])
    return run.asNondeterministic()(name, arguments)  # so that no plan evaluates it twice


@F.pandas_udf(T.StringType())
def as_json(rows: pd.DataFrame) -> pd.Series:
    """Canonical JSON of a call or result."""
    out = []
    for r in rows.itertuples(index=False):
        made = {"id": r.call_id, "kind": r.kind, "status": r.status}
        if r.kind == "call":
            made |= {"name": r.name, "arguments": None if r.canonical is None else json.loads(r.canonical), "valid": len(r.problems) == 0}
        else:
            made |= {"content": r.content}
        out.append(canonical(made))
    return pd.Series(out, dtype="object")


def firsts(df: DataFrame) -> DataFrame:
    """The first place of each identifier of a conversation."""
    return (df.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
            .agg(F.min(F.struct("turn", "nth")).alias("first")))


def settled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, node, place) with top: the largest place among a node and all that it rests on.

    Rounds over all conversations; only nodes that moved in one round tell in the next.
    """
    now = materialize(nodes.select("conv_id", "node", "place", F.col("place").alias("top"), F.lit(True).alias("moved")), "places")
    while True:
        told = now.where("moved").select("conv_id", F.col("node").alias("before"), F.col("top").alias("told"))
        told = edges.join(told, ["conv_id", "before"]).groupBy("conv_id", F.col("after").alias("node")).agg(F.max("told").alias("told"))
        moved = F.coalesce(F.col("told") > F.col("top"), F.lit(False))
        now = materialize(now.drop("moved").join(told.hint("shuffle_hash"), ["conv_id", "node"], "left")
                          .select("conv_id", "node", "place", F.when(moved, F.col("told")).otherwise(F.col("top")).alias("top"), moved.alias("moved")), "places")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def peeled(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(conv_id, node, steps) of nodes free of cycles, by the longest way to them, and the edges that are left.

    A round takes away all nodes into which no edge leads; what is left lies on a cycle or behind one.
    """
    layers, steps, left = None, 0, materialize(edges, "needs")
    while True:
        ends = left.select("conv_id", F.col("after").alias("node")).distinct()
        free = left.select("conv_id", F.col("before").alias("node")).distinct().join(ends.hint("shuffle_hash"), ["conv_id", "node"], "left_anti")
        free = materialize(free.withColumn("steps", F.lit(steps)), "free")
        if free.isEmpty():
            return layers, left
        cut = left.join(free.select("conv_id", F.col("node").alias("before")).hint("shuffle_hash"), ["conv_id", "before"], "left_anti")
        rest = materialize(cut, "needs")
        # of nodes that no edge leads to any more, those without edges of their own end here
        last = left.select("conv_id", F.col("after").alias("node")).distinct()
        for way in ("before", "after"):
            last = last.join(rest.select("conv_id", F.col(way).alias("node")).distinct().hint("shuffle_hash"), ["conv_id", "node"], "left_anti")
        layer = free.unionByName(last.withColumn("steps", F.lit(steps + 1)))
        layers = layer if layers is None else layers.unionByName(layer)
        steps, left = steps + 1, rest


def turned(edges: DataFrame) -> DataFrame:
    return edges.select("conv_id", F.col("after").alias("before"), F.col("before").alias("after"))


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(conv_id, node) of all nodes that need themselves through others; None if there are none.

    Edges that lead out of a cycle or into one only through nodes off all cycles are peeled away from both ends.  What
    is left falls into groups by the largest place that reaches a node; in each, the nodes from which that place is
    reached are one strongly connected part.  Parts go, and the rest is looked at again.
    """
    found = None
    while True:
        _, edges = peeled(edges)
        _, back = peeled(turned(edges))
        edges = turned(back)
        if edges.isEmpty():
            return found
        ends = edges.select("conv_id", F.col("before").alias("node")).union(edges.select("conv_id", "after")).distinct()
        tops = settled(nodes.join(ends, ["conv_id", "node"], "left_semi"), edges).drop("place")
        for x in ("before", "after"):
            edges = edges.join(tops.select("conv_id", F.col("node").alias(x), F.col("top").alias(f"{x}_top")).hint("shuffle_hash"), ["conv_id", x])
        within = materialize(edges.where("before_top = after_top").select("conv_id", "before", "after"), "within")
        # from each top backwards: a mark that spreads against the edges
        marks = tops.select("conv_id", "node", (F.col("top.from") == F.col("node")).cast("int").alias("place"))
        reach = settled(marks, turned(within)).where("top = 1").select("conv_id", "node")
        pairs = within.join(reach.withColumnRenamed("node", "before").hint("shuffle_hash"), ["conv_id", "before"], "left_semi") \
            .join(reach.withColumnRenamed("node", "after").hint("shuffle_hash"), ["conv_id", "after"], "left_semi")
        part = materialize(pairs.select("conv_id", F.col("before").alias("node")).union(pairs.select("conv_id", "after")).distinct(), "cyclic")
        found = part if found is None else found.unionByName(part)
        edges = within  # an edge between two groups lies on no cycle
        for x in ("before", "after"):
            edges = edges.join(reach.withColumnRenamed("node", x).hint("shuffle_hash"), ["conv_id", x], "left_anti")


def steps_within(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Nodes with top; their steps from it, where they have any; edges on cycles or behind them."""
    tops = settled(nodes, edges)
    same = edges
    for x in ("before", "after"):
        same = same.join(tops.select("conv_id", F.col("node").alias(x), F.col("top").alias(f"{x}_top")).hint("shuffle_hash"), ["conv_id", x])
    return tops, *peeled(same.where("before_top = after_top").select("conv_id", "before", "after"))


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, node, turn, nth) with behind: struct of turn, nth, from (node) and steps that sorts them; and cyclic.

    edges: conv_id, before, after (nodes).  Nodes that share the largest place they rest on are peeled for their steps;
    what cannot be peeled is searched for cycles.  Nodes on cycles keep their own places and nobody waits for them, so
    without them the order is found anew.
    """
    nodes = materialize(nodes.withColumn("place", F.struct("turn", "nth", F.col("node").alias("from"))), "nodes")
    edges = materialize(edges.select("conv_id", "before", "after").distinct(), "edges")
    tops, layers, left = steps_within(nodes, edges)
    cyclic = on_cycles(nodes, left)
    if cyclic is not None:
        for x in ("before", "after"):
            edges = edges.join(cyclic.withColumnRenamed("node", x).hint("shuffle_hash"), ["conv_id", x], "left_anti")
        tops, layers, _ = steps_within(nodes, materialize(edges, "edges"))
    marks = [tops.withColumn("steps", F.lit(0)).withColumn("cyclic", F.lit(False))]
    if layers is not None:
        marks.append(layers.select("conv_id", "node", F.lit(None).alias("place"), F.lit(None).alias("top"), "steps", F.lit(False).alias("cyclic")))
    if cyclic is not None:
        marks.append(cyclic.select("conv_id", "node", F.lit(None).alias("place"), F.lit(None).alias("top"), F.lit(0).alias("steps"), F.lit(True).alias("cyclic")))
    out = functools.reduce(DataFrame.unionByName, marks).groupBy("conv_id", "node").agg(
        F.max("top").alias("top"), F.max("steps").alias("steps"), F.max("cyclic").alias("cyclic"))
    return out.select("conv_id", "node", F.struct("top.turn", "top.nth", "top.from", "steps").alias("behind"), "cyclic")


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows conv_id, kind, call_id, turn, nth, status, problems, behind, json; sorted by conv_id, behind, turn, nth they are in order.

    messages: conv_id, turn, role, text, tool_calls (array of struct id, name, arguments), tool_call_id.
    """
    base = messages.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "tool_calls", "tool_call_id")
    calls = base.select("conv_id", "turn", F.posexplode("tool_calls").alias("nth", "call")).select(
        "conv_id", "turn", "nth", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    calls = materialize(calls.withColumn("c", checked(F.col("name"), F.col("arguments"), schemas))
                        .select("conv_id", "turn", "nth", "call_id", "name", "c.*"), "calls")
    results = base.where("role = 'tool'").select("conv_id", "turn", F.lit(0).alias("nth"), F.col("tool_call_id").alias("call_id"), F.col("text").alias("content"))

    keys = ["conv_id", "call_id"]
    owners, answers = firsts(calls).hint("shuffle_hash"), firsts(results).hint("shuffle_hash")
    call_rows = (calls.join(owners, keys, "left").join(answers.withColumnRenamed("first", "answer").hint("shuffle_hash"), keys, "left")
                 .withColumn("mine", F.coalesce(F.col("first") == F.struct("turn", "nth"), F.lit(True)))
                 .withColumn("status", F.when(~F.col("mine"), "duplicate").when(F.col("answer").isNull(), "unanswered").otherwise("ok")))
    result_rows = (results.join(answers, keys, "left").join(owners.withColumnRenamed("first", "asked").hint("shuffle_hash"), keys, "left")
                   .withColumn("mine", F.coalesce(F.col("first") == F.struct("turn", "nth"), F.lit(True)))
                   .withColumn("status", F.when(F.col("asked").isNull(), "orphan").when(~F.col("mine"), "duplicate").otherwise("ok")))

    def named(kind: str, of: str = "call_id") -> Column:
        return F.concat(F.lit(kind + ":"), F.col(of))

    linked = call_rows.where("status <> 'duplicate' and call_id is not null and conv_id is not null")
    answered = result_rows.where("status = 'ok'")
    nodes = (linked.select("conv_id", named("c").alias("node"), "turn", "nth")
             .unionByName(answered.select("conv_id", named("r").alias("node"), "turn", F.lit(-1).alias("nth"))))
    edges = answered.select("conv_id", named("c").alias("before"), named("r").alias("after")).unionByName(
        linked.select("conv_id", "call_id", F.explode("refs").alias("ref")).select("conv_id", named("r", "ref").alias("before"), named("c").alias("after")))
    places = materialize(ordered(nodes, edges).select("conv_id", F.col("node").alias("at"), "behind", "cyclic"), "order")

    def finished(rows: DataFrame, kind: str) -> DataFrame:
        mine = F.when(F.col("status") != "duplicate", named(kind[0]))
        out = rows.drop("behind", "cyclic").withColumn("at", mine).join(places.hint("shuffle_hash"), ["conv_id", "at"], "left")
        nth = F.col("nth") if kind == "call" else F.lit(-1)
        return out.select(
            "conv_id", F.lit(kind).alias("kind"), "call_id", "turn", nth.alias("nth"),
            F.when(F.col("cyclic"), "cyclic").otherwise(F.col("status")).alias("status"),
            *(F.col(c) if c in out.columns else F.lit(None).cast(t).alias(c)
              for c, t in (("name", "string"), ("canonical", "string"), ("problems", "array<string>"), ("content", "string"))),
            F.coalesce("behind", F.struct(F.col("turn"), nth.alias("nth"), named(kind[0]).alias("from"), F.lit(0).alias("steps"))).alias("behind"))

    rows = finished(call_rows, "call").unionByName(finished(result_rows, "result"))
    text = as_json(F.struct("kind", "call_id", "status", "name", "canonical", F.coalesce("problems", F.array()).alias("problems"), "content"))
    return rows.select("conv_id", "kind", "call_id", "turn", "nth", "status", "problems", "behind", text.alias("json"))
