"""Merkle manifest of a dataset: a proof for every row that it belongs to one root.

Leaves are ranked within their language and dealt into blocks of ``8 ** HEIGHT``; tasks reduce each block to
one node, again and again while more than ``TOP_NODES`` nodes are left.  The driver builds the small top tree
and broadcasts the suffix path (siblings up to the root) of each of its nodes; tasks then finish the proofs of
their blocks and fold every row.  Beyond one round of blocks the paths go down as one row for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import LOWER, UPPER, leave, stash
from opsweave.llm.ranking import ranked

ARITY = 8
#: Levels of a block.
HEIGHT = 3
#: Nodes that the driver takes at most, and whose suffix paths (some 2 KB each) are broadcast.
TOP_NODES = 4096
#: Stands in a path between the levels below a language's subroot and those above it.
SUBROOT = "#"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256_hex(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for null, else UTF-8 byte count, colon and value."""
    values = [f.cast("string") for f in fields]
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*parts), 256)


def level_up(nodes: list[str]) -> list[str]:
    return [sha256_hex("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]


def siblings(level: list[str], at: int) -> str:
    """The run's nodes before and after ``at``, as ``left,right``."""
    first = at - at % ARITY
    return "".join(level[first:at]) + "," + "".join(level[at + 1 : first + ARITY])


def levels_of(n: int) -> int:
    """Reductions until one of ``n`` nodes remains."""
    height, span = 0, 1
    while span < n:
        height, span = height + 1, span * ARITY
    return height


def tree_paths(nodes: list[str], levels: int) -> tuple[list[list[str]], list[str]]:
    """For each node its siblings in ``levels`` levels upward, and the nodes that are left."""
    paths: list[list[str]] = [[] for _ in nodes]
    for step in range(levels):
        for at, path in enumerate(paths):
            path.append(siblings(nodes, at // ARITY**step))
        nodes = level_up(nodes)
    return paths, nodes


def fold(leaf: str, path: list[str]) -> tuple[str, str]:
    """The subroot and the root that follow from a leaf and its path."""
    node = subroot = leaf
    for step in path:
        if step == SUBROOT:
            subroot = node
        else:
            left, right = step.split(",")
            node = sha256_hex(left + node + right)
    return subroot, node


def proof_digest(path: list[str]) -> str:
    return sha256_hex("".join(path).replace(",", "").replace(SUBROOT, ""))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (tree, block), cut where either changes: one whole block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree"), batch.column("block")
        cuts = pc.or_(pc.not_equal(tree[1:], tree[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(k + 1 for k in pc.indices_nonzero(cuts).to_pylist()), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and (held[-1].column("tree")[0] != part.column("tree")[0] or held[-1].column("block")[0] != part.column("block")[0]):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def _blocked(nodes: DataFrame, span: int, *more: Column) -> DataFrame:
    return nodes.select("tree", F.expr(f"`at` div {span}").alias("block"), "at", "n", *more)


def _together(nodes: DataFrame) -> DataFrame:
    """Nodes of a block side by side, in order."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _reduce(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, at, n, hash): one node for each block of ``8 ** height`` nodes."""
    span = ARITY**height

    @leave("merkle")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = block.column("n")[0].as_py()
            hashes = block.column("hash").to_pylist()
            for _ in range(min(height, levels_of(n))):
                hashes = level_up(hashes)
            yield pa.RecordBatch.from_pydict({"tree": [block.column("tree")[0].as_py()], "at": [block.column("block")[0].as_py()], "n": [-(-n // span)], "hash": hashes})

    return _together(_blocked(nodes, span, F.col("hash"))).mapInArrow(run, "tree string, at long, n long, hash string")


def _top(nodes: list, languages: bool) -> tuple[dict, str]:
    """Suffix paths by (tree, at) and the root; ``languages``: trees are languages whose subroots give the root."""
    trees: dict[str, list[str]] = {}
    for row in sorted(nodes, key=lambda r: (r.tree, r.at)):  # code points sort as UTF-8 bytes do
        trees.setdefault(row.tree, []).append(row.hash)
    below = {tree: tree_paths(hashes, levels_of(len(hashes))) for tree, hashes in trees.items()}
    above, last = tree_paths([left[0] for _, left in below.values()], levels_of(len(below))) if languages else ([[]], next(iter(below.values()))[1])
    mark = [SUBROOT] if languages else []
    paths = {(tree, at): "|".join([*path, *mark, *upper]) for (tree, (own, _)), upper in zip(below.items(), above) for at, path in enumerate(own)}
    return paths, last[0]


def _descend(nodes: DataFrame, height: int, paths, columns: list[Column], schema: str, finish) -> DataFrame:
    """Meets each block with the path of its node (``paths``: a broadcast dict, or rows (tree, at, path))
    and gives ``finish(block, path of each row)``."""
    feed = _blocked(nodes, ARITY**height, *columns)
    shared = None if isinstance(paths, DataFrame) else paths
    if shared is None:
        heads = paths.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), "path")
        feed = feed.unionByName(heads, allowMissingColumns=True)

    @leave("merkle")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            if shared is None:
                above, block = block.column("path")[0].as_py(), block.slice(1)
            else:
                above = shared.value[block.column("tree")[0].as_py(), block.column("block")[0].as_py()]
            own, _ = tree_paths(block.column("hash").to_pylist(), min(height, levels_of(block.column("n")[0].as_py())))
            yield finish(block, [path + above.split("|") if above else path for path in own])

    return _together(feed).mapInArrow(run, schema)


def _node_paths(block: pa.RecordBatch, paths: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"tree": block.column("tree"), "at": block.column("at"), "path": pa.array(["|".join(p) for p in paths], pa.string())})


_PATHS = "tree string, at long, path string"


def _paths_to_root(nodes: DataFrame, height: int, top_nodes: int, languages: bool):
    """For rows (tree, at, n, hash): paths by (tree, at) up to the root, a broadcast dict or rows, and the root."""
    spark = nodes.sparkSession
    held = nodes.limit(top_nodes + 1).collect()
    if len(held) <= top_nodes:
        paths, root = _top(held, languages)
        return spark.sparkContext.broadcast(paths), root
    if nodes.where("n > 1").limit(1).count():
        above, root = _paths_to_root(stash(_reduce(nodes, height), "nodes"), height, top_nodes, languages)
        return stash(_descend(nodes, height, above, [F.col("hash")], _PATHS, _node_paths), "paths"), root
    # One node a language, and too many languages: their subroots are the leaves of a tree of their own.
    upper = ranked(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "hash"), "tree", ["lang"], "subroots")
    above, root = _paths_to_root(stash(_reduce(upper, height), "nodes"), height, top_nodes, False)
    found = _descend(upper, height, above, [F.col("hash"), F.col("lang")], "lang string, path string", lambda block, paths: pa.RecordBatch.from_pydict({"lang": block.column("lang"), "path": pa.array(["|".join([SUBROOT, *p]) for p in paths], pa.string())}))
    return stash(found.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("at"), "path"), "paths"), root


def manifest(docs: DataFrame, height: int = HEIGHT, top_nodes: int = TOP_NODES) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of ``docs``.

    Any column may be null: it counts as ``-``; rows with a null language are a tree of their own, first of all.
    A null doc_id comes first in its language and is never tampered with.  Rows of one language and doc_id are
    ordered by their leaf; rows that repeat whole are leaves of their own, alike in all but their place.  Empty
    and very long texts are hashed whole, in the JVM.  Other columns than the five are not read, whatever their
    names.  An empty table gives no rows.
    """
    fields = [docs[f"`{name}`"] for name in FIELDS]
    changed = F.translate(fields[-1].cast("string"), UPPER, LOWER)
    tampered = F.crc32(fields[0].cast("string")) % 3 == 0
    leaves = docs.select(
        fields[0].alias("doc_id"),
        F.when(fields[2].isNull(), "").otherwise(F.concat(F.lit("="), fields[2].cast("string"))).alias("tree"),
        leaf_hash(fields).alias("hash"),
        F.when(tampered, leaf_hash([*fields[:-1], changed])).alias("changed"),
    )
    nodes = ranked(stash(leaves, "leaves"), "tree", ["doc_id", "hash"], "ranked")
    nodes = stash(nodes, "leaves")
    first = stash(_reduce(nodes, height), "nodes")
    schema = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if first.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    paths, root = _paths_to_root(first, height, top_nodes, True)

    def finish(block: pa.RecordBatch, rows: list[list[str]]) -> pa.RecordBatch:
        leaf, changed = block.column("hash").to_pylist(), block.column("changed").to_pylist()
        subroots = [fold(h, path)[0] for h, path in zip(leaf, rows)]
        folded = [fold(c or h, path)[1] for h, c, path in zip(leaf, changed, rows)]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": block.column("doc_id"), "leaf": leaf, "subroot": subroots, "root": [root] * len(leaf),
                "proof_sha256": [proof_digest(path) for path in rows], "folded_root": folded, "verified": [f == root for f in folded],
            }
        )

    return _descend(nodes, height, paths, [F.col("hash"), F.col("doc_id"), F.col("changed")], schema, finish)
