"""Deeply nested JSON records to related flat tables, by Dewey labels.

A payload is read once and walked in document order. Every object that holds the anchor key is
a record; its label is its order in the payload. A repeated element below it appends its place
in its list, so the label of the second source of the fourth skill of the first record is
``0.3.1``. The keys on the way form the schema path (``skills.sources``), which names the flat
table; a row's parent is its label cut by one place, found in the table of the parent path.
Flattening needs no shuffle, and the tables join on (document, label).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Table of payloads that can't be read; its rows have an empty label.
INVALID = "_invalid"

NODE_SCHEMA = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("label", T.ArrayType(T.IntegerType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.StringType()),
    ]
)


def flatten_json(df: DataFrame, doc_col: str, payload_col: str, anchor: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of every record in a JSON column: (doc, table_name, label, fields, value).

    ``anchor`` is the key that makes an object a record, wherever it is nested; a record inside
    another counts on its own. The record itself is in table ``""``. ``fields`` has an object's
    scalar members as text, ``value`` a scalar list element as text. A null member or element is
    kept as a null, so places count it. For the schema paths in ``lists`` a lone object or
    scalar counts as a list of one, and a list written as JSON text as that list; null counts as
    an empty list. Null and white-space payloads and rows with a null document give no nodes; a payload that isn't valid JSON,
    or that is nested too deeply for the parser, gives one node in table ``_invalid`` with the
    reason. Other columns of ``df`` are not read.
    """
    walk = _walker(anchor, frozenset(lists))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, payload in zip(batch["doc"], batch["payload"], strict=True):
                if payload is not None and payload.strip():
                    rows.extend((int(doc), *node) for node in walk(payload))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=NODE_SCHEMA.names)
                    rows = []
            yield pd.DataFrame(rows, columns=NODE_SCHEMA.names)

    return df.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("bigint").alias("doc"), F.col(payload_col).alias("payload")).mapInPandas(run, NODE_SCHEMA)


def child_table(nodes: DataFrame, table_name: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One flat table: doc, label, parent_label, pos, the wanted columns, and value.

    Labels are dotted text; ``parent_label`` is the label in the parent path's table, empty for
    records.
    """
    depth = F.size("label")
    return nodes.where(F.col("table_name") == table_name).select(
        "doc",
        F.array_join("label", ".").alias("label"),
        F.array_join(F.slice("label", 1, F.greatest(depth - 1, F.lit(0))), ".").alias("parent_label"),
        F.get("label", depth - 1).alias("pos"),
        *(F.try_element_at("fields", F.lit(c)).alias(c) for c in columns),
        "value",
    )


def label_at(level: int) -> Column:
    """The place a node's ancestor at ``level`` has in its list."""
    return F.get("label", F.lit(level)).cast("bigint")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _text(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, str):
        return v.encode("utf-8", "replace").decode("utf-8")
    return json.dumps(v)


def _as_list(v: object) -> list:
    if v is None:
        return []
    if isinstance(v, str) and v.lstrip()[:1] == "[":
        try:
            inner = json.loads(v, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return [v]
        return inner if isinstance(inner, list) else [v]
    return v if isinstance(v, list) else [v]


def _walker(anchor: str, lists: frozenset[str]) -> Callable[[str], list[tuple]]:
    def records(root: object) -> list[dict]:
        found, stack = [], [root]
        while stack:
            v = stack.pop()
            if isinstance(v, dict):
                if anchor in v:
                    found.append(v)
                stack.extend(reversed(v.values()))
            elif isinstance(v, list):
                stack.extend(reversed(v))
        return found

    def nodes(record: dict, pos: int) -> list[tuple]:
        out, stack = [], [("", [pos], record)]
        while stack:
            path, label, obj = stack.pop()
            fields, below = {}, []
            for key, v in obj.items():
                sub = f"{path}.{key}" if path else key
                if sub in lists or isinstance(v, list):
                    for i, x in enumerate(_as_list(v)):
                        if isinstance(x, dict):
                            below.append((sub, [*label, i], x))
                        elif isinstance(x, list):
                            below.append((sub, [*label, i], {"": x}))
                        else:
                            out.append((sub, [*label, i], {}, _text(x)))
                elif isinstance(v, dict):
                    if anchor not in v:
                        below.append((sub, label, v))
                else:
                    fields[_text(key)] = _text(v)
            out.append((path, label, fields, None))
            stack.extend(reversed(below))
        return out

    def walk(payload: str) -> list[tuple]:
        try:
            root = json.loads(payload, parse_constant=_no_constant)
        except (ValueError, RecursionError) as e:
            return [(INVALID, [], {"reason": str(e)[:200]}, None)]
        return [n for pos, r in enumerate(records(root)) for n in nodes(r, pos)]

    return walk
