"""Nodes of JSON texts of any shape and depth: one walk per text, one plan whatever the documents look like.

Texts of common length are parsed at once and their tree is unfolded; longer and very deep ones are walked token by
token.  A walk keeps its way in a list, so neither Python's nor the planner's depth bounds a document.  Rows leave in
bounded batches; nothing is shuffled.
"""

from __future__ import annotations

import json.decoder
import re
from collections.abc import Collection, Iterable, Iterator, Sequence
from functools import reduce
from itertools import islice
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:"])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
BLANK = re.compile(r"[ \t\n\r]*")
OPENS = {"{": "object", "[": "array", '"': "string"}
KINDS = ("object", "array", "number", "string", "boolean", "null")
KIND_OF = {tuple: "object", list: "array", float: "number", str: "string", bool: "boolean", type(None): "null"}
#: Texts of more characters are walked, as are those whose tree has more characters of paths open at a time.
WHOLE_CHARS = 1_000_000
OPEN_CHARS = 4_000_000
#: Texts of more characters may have more paths than a task should hold, as these grow with the square of the depth.
SHORT_CHARS = 20_000
#: Characters of paths that leave a task at a time.
BATCH_CHARS = 4_000_000
FIELDS = [("ord", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("value", pa.float64())]
NODE = T.StructType([T.StructField("ord", T.LongType()), T.StructField("path", T.StringType()),
                     T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


def walk(text: str, kinds: Collection[str] = KINDS) -> Iterator[tuple[str, str, float | None]]:
    """Path, kind and number of every node of these kinds in the order of the text; ValueError where it is no JSON."""
    place: list[int | None] = []  # for each open container the place in it, none in an object
    part: list[str] = []  # the last part of the path in each
    named: list[bool] = []  # whether the container's own path has any part
    at, want = 0, "value"
    while True:
        token = TOKEN.match(text, at)
        if not token:
            raise ValueError(f"no JSON at {at}")
        mark, number, word = token.groups()
        at = token.end()
        if mark == '"' and want in ("key", "key or end"):
            key, at = json.decoder.scanstring(text, at, True)
            colon = TOKEN.match(text, at)
            if not colon or colon[1] != ":":
                raise ValueError(f"no colon at {at}")
            at, want = colon.end(), "value"
            part[-1] = f".{key}" if named[-1] else key
            continue
        if want in ("value", "value or end") and mark not in (*"]},:",):
            kind = OPENS.get(mark) or ("number" if number else "null" if word == "null" else "boolean")
            if kind in kinds:
                yield "".join(part), kind, float(number) if number else None
            if mark == '"':
                _, at = json.decoder.scanstring(text, at, True)
            elif mark:
                named.append(bool(named and (named[-1] or part[-1])))
                place.append(0 if mark == "[" else None)
                part.append("[0]" if mark == "[" else "")
                want = "value or end" if mark == "[" else "key or end"
                continue
        elif mark == "," and want == "more":
            if place[-1] is None:
                want = "key"
            else:
                place[-1] += 1
                part[-1], want = f"[{place[-1]}]", "value"
            continue
        elif place and mark == ("}" if place[-1] is None else "]") and want not in ("key", "value"):
            for way in (place, part, named):
                way.pop()
        else:
            raise ValueError(f"{token[0]!r} at {at}")
        if not place:  # the outermost value has ended
            if BLANK.match(text, at).end() != len(text):
                raise ValueError(f"more at {at}")
            return
        want = "more"


def _no_number(word: str) -> float:
    raise ValueError(f"{word} is no JSON")


#: Objects come as tuples of pairs, so that repeated keys stay; numbers as the walk reads them.
DECODER = json.decoder.JSONDecoder(object_pairs_hook=tuple, parse_int=float, parse_float=float, parse_constant=_no_number)


def _below(head: str, pairs: tuple) -> Iterator[tuple[str, object]]:
    return ((head + key, x) for key, x in pairs)


def _items(path: str, items: list) -> Iterator[tuple[str, object]]:
    return ((f"{path}[{k}]", x) for k, x in enumerate(items))


def unfold(tree: object, kinds: Collection[str] = KINDS) -> Iterator[tuple[str, str, float | None]]:
    """What ``walk`` tells of the text of a tree; RecursionError where too many characters of paths are open."""
    ways, sizes, size = [iter([("", tree)])], [0], 0
    while ways:
        for path, x in ways[-1]:
            kind = KIND_OF[type(x)]
            if kind in kinds:
                yield path, kind, x if kind == "number" else None
            if kind == "object":
                head = f"{path}." if path else ""
                ways.append(_below(head, x))
            elif kind == "array":
                ways.append(_items(path, x))
            else:
                continue
            sizes.append(len(path))
            size += len(path)
            if size > OPEN_CHARS:
                raise RecursionError
            break
        else:
            ways.pop()
            size -= sizes.pop()


def _nodes(text: str, kinds: Collection[str]) -> Iterator[tuple[str, str, float | None]]:
    told = 0
    if len(text) <= WHOLE_CHARS:
        try:
            for node in unfold(DECODER.decode(text), kinds):
                told += 1
                yield node
            return
        except ValueError:
            return
        except RecursionError:
            pass
    try:
        for _ in walk(text, ()):  # to the end before the first node is told, and without any path
            pass
    except ValueError:
        return
    yield from islice(walk(text, kinds), told, None)


def found(text: str | None, kinds: Collection[str] = KINDS) -> Iterator[tuple[str, str, float | None]]:
    """Nodes of a text, none if it is null or no JSON; half a surrogate pair in a path becomes a question mark."""
    for path, kind, value in _nodes(text or "", kinds):
        yield path if path.isascii() else path.encode("utf-8", "replace").decode(), kind, value


def nodes(documents: DataFrame, keys: Sequence[str], text: str = "json", kinds: Collection[str] = KINDS, once: bool = False) -> DataFrame:
    """keys, ord, path, kind, value: one row for every node of these kinds of every document.

    Paths are ``a.b[0].c``, the outermost node has the empty one; kinds are object, array, number, string,
    boolean and null; only numbers have a value (infinite beyond the range of doubles).  Null texts and texts
    that are no JSON give no row, repeated rows give their nodes each; a key that an object repeats gives each
    of its values; ``ord`` counts the nodes told.  Neither the depth nor the number of
    nodes of a document is bounded.  ``once`` tells of nodes of a row with the same path the first one, and holds all its paths.
    """
    own = documents.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*own.drop("__text").schema.fields, *NODE.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def flush(batch: pa.RecordBatch = batch, held: list[tuple] = held) -> pa.RecordBatch:
                row, *columns = zip(*held, strict=True)
                kept = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))]
                out = pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))],
                                                 names=[*keys, *(n for n, _ in FIELDS)])
                held.clear()
                return out

            for row in range(batch.num_rows):
                seen: set[str] = set()
                for k, node in enumerate(found(batch.column(len(keys))[row].as_py(), kinds)):
                    if once:
                        if node[0] in seen:
                            continue
                        seen.add(node[0])
                    held.append((row, k, *node))
                    size += len(node[0]) + 64
                    if size > BATCH_CHARS:
                        yield flush()
                        size = 0
            if held:
                yield flush()

    return own.mapInArrow(run, schema)


def paths(documents: DataFrame, keys: Sequence[str], text: str = "json") -> DataFrame:
    """keys and path of every node below the outermost one, each once for its keys.

    Where no other row has a row's keys and its text is short, its paths are told apart in the walk; only those of all
    other rows, which other tasks may tell as well, are exchanged.
    """
    own = documents.select(*keys, F.col(text).cast("string").alias("__text"))
    rows = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    shared = rows.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.lit(True).alias("__shared"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
    marked = own.join(shared, same, "left").withColumn("__apart", F.col("__shared").isNull() & (F.length("__text") <= SHORT_CHARS))
    apart, met = (nodes(marked.where(x), keys, "__text", once=o).where("path <> ''").select(*keys, "path")
                  for x, o in ((F.col("__apart"), True), (~F.col("__apart"), False)))
    return apart.unionByName(met.distinct())
