"""Deeply nested records to related flat tables by interval labels.

Each body is walked once, depth first, and every node gets its pre-order and
post-order number.  A node lies below another exactly where its interval lies
inside the other's, so any ancestor question is a comparison of two numbers;
the direct parent's number is emitted too, so that the tables link by an
equi-join.  A body is one cell of the table: the walk keeps its own stack and
needs memory in proportion to that one cell only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.strict_json import opened, parse


@dataclass(frozen=True)
class Child:
    """A field whose value holds nodes: 'one' object, a 'list' or a 'map' of them."""

    field: str
    kind: str
    holds: str = "list"


@dataclass(frozen=True)
class TreeSpec:
    """Kinds of nodes and where each kind's children stand."""

    root: str
    children: dict[str, tuple[Child, ...]] = field(default_factory=dict)


RUN_TREE = TreeSpec(
    "run",
    {
        "run": (Child("engine_only", "arm", "one"), Child("graph_first", "arm", "one")),
        "arm": (Child("questions", "question"),),
        "question": (
            Child("takip", "question"),
            Child("buckets", "bucket", "map"),
            Child("evidence", "evidence"),
        ),
    },
)

LABELS = "kind string, node_path string, pre long, post long, parent_pre long, depth int, fields map<string,string>"


def _raw(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _members(child: Child, value) -> Iterator[tuple[str, object]]:
    """(path step, object) of each node that a child field holds; nulls are none."""
    value = opened(value)
    if child.holds == "one":
        if isinstance(value, dict):
            yield child.field, value
    elif child.holds == "map":
        if isinstance(value, dict):
            for name, item in value.items():
                item = opened(item)
                if item is not None:
                    yield f"{child.field}.{name}", item if isinstance(item, dict) else {"value": item}
    else:
        items = value if isinstance(value, list) else [value]
        for at, item in enumerate(items):
            item = opened(item)
            if isinstance(item, dict):
                yield f"{child.field}[{at}]", item


def label(body: str | None, spec: TreeSpec = RUN_TREE) -> list[tuple]:
    """(kind, path, pre, post, parent_pre, depth, fields) of each node of a body.

    A body that is null, no valid JSON or no object has no nodes.
    """
    if body is None:
        return []
    try:
        top = opened(parse(body))
    except ValueError:
        return []
    if not isinstance(top, dict):
        return []
    out: list[list] = []
    pre = post = 0

    def enter(kind: str, path: str, node: dict, parent: int | None, depth: int):
        nonlocal pre
        own = {c.field for c in spec.children.get(kind, ())}
        row = [kind, path, pre, None, parent, depth, {k: _raw(v) for k, v in node.items() if k not in own}]
        pre += 1
        out.append(row)
        steps = ((c.kind, s, n) for c in spec.children.get(kind, ()) for s, n in _members(c, node.get(c.field)))
        return row, steps

    stack = [enter(spec.root, "", top, None, 0)]
    while stack:
        row, steps = stack[-1]
        for kind, step, node in steps:
            path = f"{row[1]}.{step}" if row[1] else step
            stack.append(enter(kind, path, node, row[2], row[5] + 1))
            break
        else:
            row[3] = post
            post += 1
            stack.pop()
    return [tuple(r) for r in out]


def label_trees(df: DataFrame, key: str, body: str = "body", spec: TreeSpec = RUN_TREE) -> DataFrame:
    """One row for each node of each body: the key and the interval labels.

    Other columns are ignored.  Bodies that arrive twice with one content give
    each node once (first path in the order of the labels).  Null keys stay null.
    """
    schema = df.select(F.col(key).alias("tree_key")).schema
    columns = LABELS.split(", ")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tree_key", *(c.split(" ")[0] for c in columns)]
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch["tree_key"], batch["body_text"]):
                for node in label(text, spec):
                    rows.append((k, *node))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    kind = schema["tree_key"].dataType.simpleString()
    nodes = df.select(F.col(key).alias("tree_key"), F.col(body).alias("body_text")).mapInPandas(
        walk, f"tree_key {kind}, {LABELS}"
    )
    return nodes.dropDuplicates(["tree_key", "node_path"]).withColumnRenamed("tree_key", key)


def linked(nodes: DataFrame, key: str, kind: str) -> DataFrame:
    """Nodes of one kind, each with its parent's kind and path.

    The parent is found by its number and must contain the child's interval.
    """
    up = nodes.select(
        F.col(key).alias("up_key"),
        F.col("pre").alias("up_pre"),
        F.col("post").alias("up_post"),
        F.col("kind").alias("parent_kind"),
        F.col("node_path").alias("parent_path"),
    )
    inside = (F.col("up_pre") < F.col("pre")) & (F.col("up_post") > F.col("post"))
    on = F.col(key).eqNullSafe(F.col("up_key")) & (F.col("parent_pre") == F.col("up_pre")) & inside
    return nodes.filter(F.col("kind") == kind).join(up, on, "left").drop("up_key", "up_pre", "up_post")


def below(nodes: DataFrame, key: str, ancestor: str, kind: str) -> DataFrame:
    """(key, ancestor_path, node_path): all nodes of a kind inside nodes of another, at any depth."""
    top = nodes.filter(F.col("kind") == ancestor).select(
        F.col(key).alias("up_key"), F.col("pre").alias("up_pre"), F.col("post").alias("up_post"),
        F.col("node_path").alias("ancestor_path"),
    )
    inside = (F.col("up_pre") < F.col("pre")) & (F.col("up_post") > F.col("post"))
    return (
        nodes.filter(F.col("kind") == kind)
        .join(top, F.col(key).eqNullSafe(F.col("up_key")) & inside)
        .select(key, "ancestor_path", "node_path")
    )


def whole(column) -> F.Column:
    """A count that may be written as a number or as text; null where it is neither."""
    return F.expr(f"try_cast(fields['{column}'] AS BIGINT)")


def flag(column) -> F.Column:
    return F.expr(f"try_cast(fields['{column}'] AS BOOLEAN)")


def run_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of runs, arms, questions, buckets and evidence of run bodies."""
    nodes = label_trees(runs, "run_id")
    f = lambda name: F.col("fields")[name]
    ingest = lambda name, t: F.expr(f"try_cast(get_json_object(fields['ingest'], '$.{name}') AS {t})")
    base = ["run_id", "node_path", "pre", "post", "parent_kind", "parent_path"]
    linked_to = lambda kind: linked(nodes, "run_id", kind)
    return {
        "nodes": nodes,
        "runs": nodes.filter(F.col("kind") == "run").select(
            "run_id", "pre", "post", f("backend").alias("backend"), f("corpus").alias("corpus"),
            whole("gpu_layers").alias("gpu_layers"), ingest("facts", "BIGINT").alias("facts"),
            ingest("skipped", "BIGINT").alias("skipped"), ingest("derived", "BIGINT").alias("derived"),
            ingest("calls", "BIGINT").alias("ingest_calls"), ingest("wall_seconds", "DOUBLE").alias("wall_seconds"),
        ),
        "arms": linked_to("arm").select(
            *base, whole("question_count").alias("question_count"), whole("calls").alias("calls")
        ),
        "questions": linked_to("question").select(
            *base, f("soru").alias("soru"), f("cevap").alias("cevap"), whole("ms").alias("ms"),
            whole("calls").alias("calls"), flag("abstained").alias("abstained"),
            flag("from_graph").alias("from_graph"),
        ),
        "buckets": linked_to("bucket").select(
            *base, F.expr("substring(node_path, length(parent_path) + length('.buckets.') + 1)").alias("bucket"),
            whole("calls").alias("calls"), whole("prompt_tokens").alias("prompt_tokens"),
            whole("completion_tokens").alias("completion_tokens"),
        ),
        "evidence": linked_to("evidence").select(
            *base, f("source").alias("source"),
            F.from_json(f("lines"), "array<bigint>").alias("lines"),
        ),
    }
