"""Checkpoint trees: one run's on the driver, many runs' as an adjacency table in Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow import fs

STATES = ("pending", "in-progress", "done", "failed")


@dataclass
class Node:
    step_id: str
    state: str = "pending"
    children: list[Node] = field(default_factory=list)
    output_hash: str | None = None
    cursor: str | None = None
    error: str | None = None
    path: str | None = None


class CheckpointTree:
    def __init__(self, root: str):
        self.root = Node(root)

    def walk(self) -> Iterator[tuple[Node, int]]:
        """(node, depth) in pre-order."""
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            yield node, depth
            todo.extend((c, depth + 1) for c in reversed(node.children))

    def find(self, step_id: str) -> Node | None:
        return next((n for n, _ in self.walk() if n.step_id == step_id), None)

    def first_open(self) -> Node | None:
        return next((n for n, _ in self.walk() if n.state != "done"), None)

    def add(self, step_id: str, parent: str | None = None) -> Node:
        """The child of that name; it is made if it isn't there."""
        at = self.find(parent) if parent else self.root
        if at is None:
            raise KeyError(parent)
        for c in at.children:
            if c.step_id == step_id:
                return c
        at.children.append(Node(step_id))
        return at.children[-1]

    def mark(self, step_id: str, state: str, **fields: str | None) -> Node:
        node = self.find(step_id)
        if node is None or state not in STATES:
            raise KeyError(f"{step_id}: {state}")
        node.state = state
        for k, v in fields.items():
            setattr(node, k, v)
        return node

    def all_done(self) -> bool:
        return self.first_open() is None

    def count_by_state(self) -> dict[str, int]:
        out = dict.fromkeys(STATES, 0)
        for n, _ in self.walk():
            out[n.state] += 1
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self.root))

    @classmethod
    def from_json(cls, text: str) -> CheckpointTree:
        def node(d: dict) -> Node:
            return Node(**{**d, "children": [node(c) for c in d["children"]]})

        tree = cls("")
        tree.root = node(json.loads(text))
        return tree

    def rows(self, run_id: str) -> list[tuple]:
        """Rows of the adjacency table (model.CHECKPOINT)."""
        out = []

        def visit(n: Node, parent: str | None, ord_: int) -> None:
            out.append((run_id, n.step_id, parent, ord_, n.state, n.output_hash, n.cursor, n.error))
            for i, c in enumerate(n.children):
                visit(c, n.step_id, i)

        visit(self.root, None, 0)
        return out


def tree_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (run_id, node_id, parent_id, ord, state, ...) with depth and path, whose order is the pre-order.

    Each node knows an ancestor above what its path covers, at first its parent. A round
    joins all nodes to theirs and doubles the distance, so a tree of any size and depth
    takes a round for each power of two below its depth. A round is written once and
    read by the next. Nodes that no root leads to are left out.
    """
    own = F.lpad(F.col("ord").cast("string"), 10, "0")
    todo = _written(nodes.select("run_id", "node_id", "parent_id", "ord", "state", F.lit(0).alias("depth"), own.alias("path"), F.col("parent_id").alias("up")))
    done = []
    while True:
        # a round that ends no path is followed by none that does
        ended, todo = todo.where("up is null"), todo.where("up is not null")
        done.append(ended.drop("up"))
        if done[1:] and ended.isEmpty() or todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        above = reduce(DataFrame.unionByName, [x.withColumn("up", F.lit(None).cast(todo.schema["up"].dataType)) for x in done], todo)
        wanted = todo.select(F.col("run_id").alias("w_run"), F.col("up").alias("w_up")).distinct()
        above = above.join(wanted, (F.col("run_id") == F.col("w_run")) & (F.col("node_id") == F.col("w_up")), "left_semi")
        above = above.select(F.col("run_id").alias("a_run"), F.col("node_id").alias("a_node"), F.col("depth").alias("a_depth"), F.col("path").alias("a_path"), F.col("up").alias("a_up"))
        met = todo.join(above, (F.col("run_id") == F.col("a_run")) & (F.col("up") == F.col("a_node")))
        todo = _written(met.select("run_id", "node_id", "parent_id", "ord", "state", (F.col("depth") + F.col("a_depth") + 1).alias("depth"), F.concat("a_path", F.lit("/"), "path").alias("path"), F.col("a_up").alias("up")))


def _written(df: DataFrame) -> DataFrame:
    path = fs.scratch(df.sparkSession, "tree")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_by_state(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run_id", "state").agg(F.count("*").alias("n"))


def first_open(ordered: DataFrame) -> DataFrame:
    """The first node of each run, in pre-order, that isn't done."""
    return ordered.where("state <> 'done'").groupBy("run_id").agg(F.min_by(F.struct("node_id", "state", "depth"), "path").alias("x")).select("run_id", "x.*")
