"""Prefix trie of conversations by succinct level-order tries.

Turns become digests once; their texts travel no further.  Each rebuilt conversation is read in order as a chain
of prefix keys.  Prefixes with more than ``1 / HEAVY_NODES`` of all rows are the heavy upper levels, at most
``HEAVY_NODES`` of them; every conversation belongs below its first light prefix, and light prefixes are the
shards: small, however hot a first turn or a whole conversation is.  A task builds the level-order trie of its
shards in numpy (LOUDS bits and label arrays) and rolls it up in reverse level order; what the shard roots add
to the heavy levels is summed by Spark, and the driver rolls those up in the same way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from opsweave.llm.common import leave, stash

#: Every conversation whose id divides by this lends its first turns to those up to the next one.
DONORS = 20
MOST_HEAD = 3
#: Prefixes that the driver and every task hold at most.
HEAVY_NODES = 4096
#: Members of a prefix that is never heavy.
LEAST_HEAVY = 32
#: Rows of shards that are built into one trie.
SHARD_ROWS = 1 << 16
#: Ids of a row in which the ends of a heavy prefix travel.
ENDS_A_ROW = 4096
_KEY = 16
_ROOT = b"\0" * _KEY


def head_length(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % (MOST_HEAD + 1)


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation in order, their texts as digests."""
    role, text = (F.coalesce(turns[f"`{name}`"].cast("string"), F.lit("")) for name in ("role", "text"))
    rows = turns.select(
        turns["`conv_id`"].cast("long").alias("conv_id"),
        turns["`turn`"].alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _KEY)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("conv_id", "pos", "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): rows of every rebuilt conversation; the first of each, at pos -1, has no turn."""
    crc = F.crc32(F.col("conv_id").cast("string"))
    own = turns.where((F.col("pos") >= crc % (MOST_HEAD + 1)) | (F.col("pos") == 0))
    # Every conversation has a row at 0: it stands for the root, and for the turn unless the head replaces that.
    marks = own.where("pos = 0").select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    kept = own.where(F.col("pos") >= crc % (MOST_HEAD + 1)).select("conv_id", (F.col("pos") + MOST_HEAD).alias("pos"), "digest", "words")
    lent = turns.where((F.col("pos") < MOST_HEAD) & (F.col("conv_id") % DONORS == 0)).select(F.col("conv_id").alias("donor"), "pos", "digest", "words")
    takers = marks.select("conv_id", (F.col("conv_id") - F.col("conv_id") % DONORS).alias("donor"))
    heads = takers.join(lent, "donor").where(F.col("pos") < crc % (MOST_HEAD + 1)).select("conv_id", "pos", "digest", "words")
    return marks.unionByName(heads).unionByName(kept)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


class Chain:
    """Reads rows of conversations in order, batch after batch: the prefix key of each row, that of the prefix
    before it, its depth, and whether the conversation ends there.  A batch's last row waits for the next batch."""

    def __init__(self) -> None:
        self.conv, self.key, self.depth, self.held = None, _ROOT, 0, None

    def read(self, batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words"))):
            if conv != self.conv:
                self.conv, self.key, self.depth, up = conv, _ROOT, 0, None
            else:
                up = self.key
                self.key, self.depth = hashlib.blake2b(up + digest, digest_size=_KEY).digest(), self.depth + 1
            if self.held:
                out.append((*self.held, up is None))
            self.held = conv, self.depth, self.key, up, digest, words
        return out

    def rest(self) -> list[tuple]:
        return [(*self.held, True)] if self.held else []


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, key, up, words): every prefix of every conversation."""

    @leave("conversation_trie")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _each(Chain(), batches):
            conv, depth, key, up, _, words, _ = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(up, pa.binary()), pa.array(words, pa.int64())],
                ["conv_id", "depth", "key", "up", "words"],
            )

    return _in_order(rows).mapInArrow(run, "conv_id long, depth long, key binary, up binary, words long")


def _each(chain: Chain, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        if found := chain.read(batch):
            yield found
    if found := chain.rest():
        yield found


_SHARE = "shard binary, conv_id long, depth long, digest binary, words long, ends boolean"


def _shares(rows: DataFrame, heavy) -> DataFrame:
    """Light rows under their shard (the conversation's first light prefix), and the ends of heavy prefixes:
    there ``digest`` is null and ``shard`` is the heavy prefix."""

    @leave("conversation_trie")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = heavy.value, None
        for found in _each(Chain(), batches):
            out = []
            for conv, depth, key, up, digest, words, ends in found:
                if key in known:
                    shard = None
                    if ends:
                        out.append((key, conv, depth, None, words, True))
                    continue
                if up is None or up in known:
                    shard = up + key
                out.append((shard, conv, depth, digest, words, ends))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "conv_id", "depth", "digest", "words", "ends"])

    return _in_order(rows).mapInArrow(run, _SHARE)


def louds(n_children: np.ndarray) -> np.ndarray:
    """Level-order unary degree sequence: a one for each child and a zero for each node."""
    bits = np.ones(int(n_children.sum()) + len(n_children), np.uint8)
    bits[np.cumsum(n_children + 1) - 1] = 0
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of the k-th node that is some node's child: the zeros before the k-th one."""
    return np.cumsum(bits == 0)[bits == 1]


def roll_up(bits: np.ndarray, n_roots: int, own_leaves: np.ndarray, own_saved: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over subtrees, level by level from the lowest.  ``levels`` has the first node of each level and the
    number of nodes."""
    leaves, saved, up = own_leaves.copy(), own_saved.copy(), parents(bits)
    for a, b in zip(levels[-2:0:-1], levels[:0:-1]):
        np.add.at(leaves, up[a - n_roots : b - n_roots], leaves[a:b])
        np.add.at(saved, up[a - n_roots : b - n_roots], saved[a:b])
    return leaves, saved


def ends_digest(conv_ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, conv_ids)).encode()).hexdigest()


def build(rows: pa.Table) -> dict[str, np.ndarray | list]:
    """The level-order tries of whole shards, as columns by node; ``rows`` are in order of (shard, conv_id, depth)."""
    conv = rows["conv_id"].to_numpy()
    depth = rows["depth"].to_numpy()
    words = rows["words"].to_numpy()
    ends = rows["ends"].to_numpy()
    shards = rows["shard"].combine_chunks().dictionary_encode()
    roots, shard = shards.dictionary.to_pylist(), shards.indices.to_numpy()
    label = rows["digest"].combine_chunks().dictionary_encode().indices.to_numpy()
    same = np.concatenate([[False], (conv[1:] == conv[:-1]) & (shard[1:] == shard[:-1])])
    starts = np.flatnonzero(~same)
    lengths = np.diff(np.append(starts, len(conv)))
    node = np.full(len(conv), -1, np.int64)
    node[starts] = shard[starts]
    n_labels = int(label.max()) + 1
    counts, labels, children, levels = [], [label[starts[np.unique(shard[starts], return_index=True)[1]]]], [], [0, len(roots)]
    counts.append(np.bincount(shard[starts], minlength=len(roots)))
    step, base = 1, 0
    while len(at := starts[lengths > step] + step):
        pair = (node[at - 1] - base) * n_labels + label[at]
        found, inverse = np.unique(pair, return_inverse=True)
        children.append(np.bincount(found // n_labels, minlength=levels[-1] - base))
        base = levels[-1]
        node[at] = base + inverse
        counts.append(np.bincount(inverse))
        labels.append(found % n_labels)
        levels.append(base + len(found))
        step += 1
    children.append(np.zeros(levels[-1] - base, np.int64))
    n_children, n_convs = np.concatenate(children), np.concatenate(counts)
    bits, n = louds(n_children), levels[-1]
    first, at_depth, tokens = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(first, node, conv)
    at_depth[node], tokens[node] = depth, words
    leaves, saved = roll_up(bits, len(roots), (n_children == 0).astype(np.int64), (n_convs - 1) * tokens, np.array(levels))
    up = np.full(n, -1, np.int64)
    up[len(roots) :] = parents(bits)
    ended = np.flatnonzero(ends)
    ended = ended[np.lexsort((conv[ended], node[ended]))]
    digests = [ends_digest([])] * n
    for part in np.split(ended, np.flatnonzero(np.diff(node[ended])) + 1):
        if len(part):
            digests[node[part[0]]] = ends_digest(conv[part].tolist())
    return {
        "roots": roots, "louds": bits, "labels": np.concatenate(labels), "up": up, "conv_id": first, "depth": at_depth, "n_convs": n_convs,
        "n_children": n_children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digests,
    }


_NUMBERS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODE = ", ".join(f"{c} long" for c in _NUMBERS) + ", ends_sha256 string"


def _shard_tries(shares: DataFrame, heavy, shard_rows: int) -> DataFrame:
    """The nodes of all shards; ``up`` is the heavy prefix above a shard's root and null elsewhere."""

    def nodes(rows: pa.Table) -> pa.RecordBatch:
        trie = build(rows)
        up, roots = trie["up"], [root[:_KEY] for root in trie["roots"]]
        above = trie["conv_id"][np.maximum(up, 0)]
        above[: len(roots)] = [heavy.value[key] for key in roots]
        columns = {"parent_conv_id": above} | {c: trie[c] for c in _NUMBERS if c != "parent_conv_id"}
        arrays = [pa.array(columns[c], pa.int64()) for c in _NUMBERS]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(trie["ends_sha256"], pa.string()), pa.array(roots + [None] * (len(up) - len(roots)), pa.binary())], [*_NUMBERS, "ends_sha256", "up"])

    @leave("conversation_trie")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < shard_rows:
                continue
            table = pa.Table.from_batches(held)
            shard = table["shard"].combine_chunks()
            cut = int(pc.index(pc.equal(shard, shard[-1]), True).as_py())  # the last shard may go on
            if cut:
                yield nodes(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = len(table) - cut
        if size:
            yield nodes(pa.Table.from_batches(held))

    return shares.repartition("shard").sortWithinPartitions("shard", "conv_id", "depth").mapInArrow(run, _NODE + ", up binary")


def _ends_of_heavy(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): ids range-partitioned by (key, id) and packed into rows of text; then one pass over
    those of each key, in order, that holds one row at a time."""

    @leave("conversation_trie")
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("shard"), batch.column("conv_id").to_numpy()
            cuts = [0, *(k + 1 for k in pc.indices_nonzero(pc.not_equal(keys[1:], keys[:-1])).to_pylist()), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield pa.RecordBatch.from_pydict({"key": [keys[a].as_py()], "first": [int(ids[a])], "ids": [",".join(map(str, ids[a:b].tolist()))]})

    @leave("conversation_trie")
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for now, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if now != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})

    packed = ends.select("shard", "conv_id").repartitionByRange("shard", "conv_id").sortWithinPartitions("shard", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def _heavy_trie(heavy: list, added: dict, ends: dict) -> list[tuple]:
    """Rows of the heavy prefixes: their own level-order trie, with what the shards below them add."""
    order = sorted(heavy, key=lambda r: r.depth)
    place: dict[bytes, int] = {}
    level: list = []
    levels = [0]
    while len(levels) < 2 or levels[-1] > levels[-2]:  # children in the order of their parents
        depth = len(levels) - 1
        level = sorted((r for r in order if r.depth == depth), key=lambda r: (place.get(bytes(r.up)) if r.up else -1, bytes(r.key)))
        for r in level:
            place[bytes(r.key)] = len(place)
        levels.append(len(place))
    rows = sorted(order, key=lambda r: place[bytes(r.key)])
    n_heavy = np.zeros(len(rows), np.int64)
    for r in rows[1:]:
        n_heavy[place[bytes(r.up)]] += 1
    more = [added.get(bytes(r.key), (0, 0, 0)) for r in rows]
    n_children = n_heavy + [m[2] for m in more]
    leaves = np.array([m[0] for m in more], np.int64) + (n_children == 0)
    saved = np.array([m[1] + (r.n_convs - 1) * r.words for r, m in zip(rows, more)], np.int64)
    leaves, saved = roll_up(louds(n_heavy), 1, leaves, saved, np.array(levels[:-1]))
    return [
        (r.conv_id, r.depth, rows[place[bytes(r.up)]].conv_id if r.up else None, r.n_convs, int(n_children[k]), int(leaves[k]), int(saved[k]), ends.get(bytes(r.key), ends_digest([])))
        for k, r in enumerate(rows)
    ]


def prefix_trie(turns: DataFrame, heavy_nodes: int = HEAVY_NODES, least_heavy: int = LEAST_HEAVY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the empty one included.

    A null role or text counts as empty, a null turn comes first, turns that tie in one conversation are ordered
    by their digest (repeated rows are turns of their own), and rows without conv_id are no conversation's.
    ``c - c % 20`` takes the sign of c.  Texts of any length are hashed and counted in the JVM.  Other columns
    than the four are not read, whatever their names.  An empty table has the root alone, without members (its
    conv_id is null).  A single conversation's turns are read by one task, in order and one batch at a time.
    """
    spark = turns.sparkSession
    rows = stash(rebuilt(stash(digested(turns), "turns")), "rebuilt")
    prefixes = _prefixes(rows).groupBy("key").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("words").alias("words")
    )
    most = max(least_heavy, rows.count() // heavy_nodes)
    heavy = prefixes.where((F.col("n_convs") > most) | (F.col("depth") == 0)).collect()  # heavy_nodes and the root at most
    if not heavy:
        return spark.createDataFrame([(None, 0, None, 0, 0, 1, 0, ends_digest([]))], _NODE)
    known = spark.sparkContext.broadcast({bytes(r.key): r.conv_id for r in heavy})
    shares = stash(_shares(rows, known), "shares")
    light = stash(_shard_tries(shares.where("digest IS NOT NULL"), known, shard_rows), "nodes")
    sums = light.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
    added = {bytes(r.up): (r.leaves, r.saved, r.children) for r in sums.collect()}
    ends = {bytes(r.key): r.ends_sha256 for r in _ends_of_heavy(shares.where("digest IS NULL")).collect()}
    top = spark.createDataFrame(_heavy_trie(heavy, added, ends), _NODE)
    return top.unionByName(light.drop("up"))
