"""Deeply nested records as flat tables that keep their parent-child links.

Every object of a record gets a Dewey label: the ordinals of the steps from the record's root down to it. A label's parent is
the label without its last step, so links need no join and no generated keys; objects of one schema path (``classes/methods``)
form one table.

Scale
    Records are independent: one pass without a shuffle, a stack instead of recursion, output in bounded batches however many
    members a record has. Repeated records are removed from the (small) result rows, with partial aggregation before the shuffle.

Defined results
    * Null, empty and unreadable payloads give no rows; neither do null members or members that are not objects.
    * An empty object gives a row. Positions count nulls. A lone object where a list is due stands for a list of one.
    * A collection by name that is given as a list holds the members that bear a ``name``; others have no path and give no row.
    * The root is the outermost object that holds one of the root keys, through wrapping objects, lists and JSON within strings.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import json
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "dewey string, parent_dewey string, coll string, schema_path string, obj_path string, parent_path string, name string, ordinal int, attributes string"


@dataclass(frozen=True)
class Shape:
    """How records nest: the keys that mark the root, the collections keyed by name, and those ordered by position."""

    roots: frozenset[str]
    named: frozenset[str]
    placed: frozenset[str]


#: The registry records of modules and packages.
REGISTRY = Shape(
    frozenset({"module", "import_path"}),
    frozenset({"functions", "classes", "methods", "attributes", "constants", "inherited_methods", "inherited_attributes", "types", "variables"}),
    frozenset({"params", "returns", "type_params", "fields"}),
)


_BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")


def _decoded(text: str) -> object:
    """What a string holds: JSON, plain or in base64, compressed or not; None otherwise."""
    s = text.strip().lstrip("﻿")
    if not s:
        return None
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        pass
    s = "".join(s.split())
    if s[0] in "{[" or len(s) % 4 or not _BASE64.fullmatch(s):
        return None
    try:
        raw = base64.b64decode(s, validate=True)
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        elif raw[:1] == b"\x78":
            raw = zlib.decompress(raw)
        return json.loads(raw)
    except (ValueError, binascii.Error, OSError, zlib.error, RecursionError, EOFError):
        return None


def find_root(payload: str | None, shape: Shape) -> dict | None:
    """The outermost object that holds a root key; breadth first, so that the nearest one wins."""
    if not payload:
        return None
    level: list = [_decoded(payload)]
    while level:
        below: list = []
        for x in level:
            if isinstance(x, dict):
                if not shape.roots.isdisjoint(x):
                    return x
                below.extend(x.values())
            elif isinstance(x, list):
                below.extend(x)
            elif isinstance(x, str) and len(x) > 1:
                below.append(_decoded(x))
        level = [x for x in below if isinstance(x, dict | list | str)]
    return None


def _members(value: object, placed: bool) -> Iterator[tuple[str, object]]:
    if placed:
        if isinstance(value, dict):
            value = [value]
        if isinstance(value, list):
            yield from ((str(i), x) for i, x in enumerate(value))
    elif isinstance(value, dict):
        yield from value.items()
    elif isinstance(value, list):  # named members listed with their name inside
        yield from ((str(x["name"]), x) for x in value if isinstance(x, dict) and isinstance(x.get("name"), str))


def walk(root: dict, shape: Shape) -> Iterator[tuple]:
    """The objects below ``root`` in document order: a row of NODE_SCHEMA each."""
    stack: list[tuple[dict, str, str, str]] = [(root, "", "", "")]
    while stack:
        obj, dewey, schema_path, path = stack.pop()
        found: list[tuple[dict, str, str, str]] = []
        step = 0
        for coll, value in obj.items():
            if coll not in shape.named and coll not in shape.placed:
                continue
            at_schema = f"{schema_path}/{coll}" if schema_path else coll
            for place, (name, member) in enumerate(_members(value, coll in shape.placed)):
                step += 1
                if not isinstance(member, dict):
                    continue
                label = f"{dewey}.{step}" if dewey else str(step)
                below = f"{path}/{coll}/{name}" if path else f"{coll}/{name}"
                kept = {k: v for k, v in member.items() if k not in shape.named and k not in shape.placed}
                yield label, dewey, coll, at_schema, below, path, name, place, kept
                found.append((member, label, at_schema, below))
        stack.extend(reversed(found))


def _nodes(shape: Shape, attributes: bool, batch_rows: int = 20_000):
    names = ["id", "dewey", "parent_dewey", "coll", "schema_path", "obj_path", "parent_path", "name", "ordinal"] + ["attributes"] * attributes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            kind = b.schema.field(0).type
            schema = pa.schema([pa.field(n, kind if n == "id" else pa.int32() if n == "ordinal" else pa.string()) for n in names])
            for rid, payload in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                root = find_root(payload, shape)
                if root is None:
                    continue
                rid = rid.as_py()
                for row in walk(root, shape):
                    out.append((rid, *row[:-1], *([json.dumps(row[-1], sort_keys=True)] * attributes)))
                    if len(out) >= batch_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []

    return run


def flatten_records(records: DataFrame, id_col: str, payload_col: str, shape: Shape = REGISTRY, attributes: bool = True) -> DataFrame:
    """One row for each object below the root of each record: its id, labels, paths and scalar attributes (as JSON)."""
    kind = records.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {NODE_SCHEMA}" if attributes else f"id {kind}, {NODE_SCHEMA.rpartition(',')[0]}"
    got = records.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{payload_col}`").alias("payload")).where("payload IS NOT NULL")
    return got.mapInArrow(_nodes(shape, attributes), schema).withColumnRenamed("id", id_col)


def flat_tables(nodes: DataFrame, paths: Sequence[str]) -> dict[str, DataFrame]:
    """The nodes grouped by schema path: a table for each of ``paths``, whose ``parent_dewey`` is the key of the table above."""
    return {p: nodes.where(F.col("schema_path") == p).drop("schema_path", "coll") for p in paths}


def parent_label(dewey: str = "dewey"):
    """The label of a node's parent: the label without its last step; '' for nodes below the root."""
    return F.regexp_replace(F.col(dewey), r"(^|\.)[^.]*$", "")
