"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsweave.llm.common import leave, stash

MAX_ROUNDS = 60
#: Nodes that a task holds at most while it contracts its edges.
CONTRACT_NODES = 500_000
EDGES_A_FILE = 50_000


def _contract(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: each partition's edges replaced by stars around the smallest node of each
    of its own components.  A task that meets too many nodes sends off its stars and starts anew."""

    @leave("components")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars() -> pa.RecordBatch:
            found = [(x, root(x)) for x in parent]
            found = [(x, r) for x, r in found if x != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent.setdefault(a, a) if a not in parent else a), root(parent.setdefault(b, b) if b not in parent else b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > CONTRACT_NODES:
                yield stars()
                parent.clear()
        yield stars()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge (a, b) of long ids touches.

    ``component`` is the smallest node reachable.  Loops, repeated edges and either direction are
    fine; edges with a null end are left out; no edges give no rows.

    Each round links all larger neighbours of a node to the smallest (a large star), brings the
    edges of each larger end together, and contracts every partition.
    """
    pairs = stash(_contract(edges.where("a <> b").select("a", "b")), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break  # both stay the same only when no edge has moved
        state = now
        both = pairs.union(pairs.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = _contract(large.repartition("u")).distinct()
        pairs = stash(moved.coalesce(max(1, now[0] // EDGES_A_FILE + 1)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(labels.select("component", "component").distinct())
