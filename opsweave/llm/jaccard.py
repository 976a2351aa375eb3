"""N-gram Jaccard join with signature trees.

1. Documents of equal shingle sets are one class, known by a fingerprint of the set.
2. Shingle hashes are counted in buckets.  A shingle of one document links nothing, so a document
   survives only if shingles that others have too could make up the overlap it needs; its prefix
   of rarest shingles then names the blocks in which every linked document must meet it.
3. Documents that share a prefix shingle and have sizes near enough form candidate groups.
4. Each group is joined exactly by a signature tree: nodes hold OR-combined token bitmaps and
   size ranges, and a dual traversal leaves out node pairs whose maximum possible overlap is too
   small or whose documents are connected already.  Groups beyond ``GROUP_DOCS`` are dealt into
   parts: each part is joined together with a few pivots of its group, then those pairs of parts
   that are not one component yet are joined in full.

The result is exact up to collisions of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opsweave.llm.common import ascii_lower, by_number, bytes_of, leave, pack_sorted, pack_uint, stash, unpack_sorted, unpack_uint, width_of, words_of
from opsweave.llm.components import connected_components
from opsweave.llm.rolling import window_hashes
from opsweave.llm.substring_dedup import bucket_bits

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles that a task gathers before it sends them off.
CHUNK_SHINGLES = 1_000_000
#: Documents, and shingles, that one task joins by a tree.
GROUP_DOCS = 1_500
GROUP_SHINGLES = 1_000_000
PIVOTS = 48
LEAF = 32
FANOUT = 4
MIN_BITS, MAX_BITS = 512, 16_384


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the text's word shingles; fewer words make one shingle."""
    found = words_of(ascii_lower(text)) if text else []
    return np.unique(window_hashes(found, min(words, len(found)))) if found else np.zeros(0, np.uint64)


def shingle_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_print) for every row; ``set_print`` is null for an empty set."""

    @leave("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints = [], []
            for body in bytes_of(batch.column(1)):
                shingles = shingle_set(body, words)
                sizes.append(len(shingles))
                prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "n_shingles", "set_print"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_print binary")


def needed(size: int | np.ndarray, percent: int = PERCENT):
    """The least overlap with which a set of this size can link: the other set has it at best."""
    return (percent * size + 99) // 100


_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary()), ("totals", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])


def _chunk_rows(number: int, ids: list[int], sets: list[np.ndarray], bits: int) -> Iterator[dict]:
    """A chunk's distinct hashes by bucket, with the documents that own each, and its documents."""
    sizes = np.array([len(s) for s in sets], np.int64)
    table = np.concatenate([np.array(ids, np.int64), sizes]).astype("<i8").tobytes()
    yield {"bucket": -1 - number, "chunk": number, "docs": table, "hashes": b"", "counts": b"", "owners": b""}
    hashes = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    unique, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    width = width_of(np.array([len(sets)]))
    count_width = width_of(counts)
    buckets, begins = np.unique(unique >> np.uint64(64 - bits), return_index=True)
    for bucket, a, b in zip(buckets.tolist(), begins, [*begins[1:], len(unique)]):
        last = first[b] if b < len(first) else len(hashes)
        yield {
            "bucket": bucket,
            "chunk": number,
            "docs": None,
            "hashes": pack_sorted(unique[a:b]),
            "counts": bytes([count_width]) + pack_uint(counts[a:b], count_width),
            "owners": bytes([width]) + pack_uint(owners[first[a] : last], width),
        }


@leave("jaccard")
def _shared_shingles(key: tuple, group: pa.Table) -> pa.Table:
    """Of a bucket, the hashes that at least two sets have, given back to their chunks."""
    chunks = group["chunk"].to_pylist()
    if key[0].as_py() < 0:
        empty = pa.array([None] * len(chunks), pa.binary())
        return pa.Table.from_arrays([group["chunk"], group["docs"], empty, empty, empty, empty], schema=_BACK)
    hashes = [unpack_sorted(x) for x in group["hashes"].to_pylist()]
    counts = [unpack_uint(x[1:], x[0]).astype(np.int64) for x in group["counts"].to_pylist()]
    everything, weights = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    sums = np.add.reduceat(weights[order], np.flatnonzero(head))
    totals = np.empty(len(order), np.int64)
    totals[order] = sums[np.cumsum(head) - 1]
    out: dict[str, list] = {name: [] for name in _BACK.names}
    at = 0
    for chunk, mine, count, packed in zip(chunks, hashes, counts, group["owners"].to_pylist()):
        total = totals[at : at + len(mine)]
        at += len(mine)
        keep = total > 1
        if not keep.any():
            continue
        owners = unpack_uint(packed[1:], packed[0])[np.repeat(keep, count)]
        for name, value in (("chunk", chunk), ("docs", None), ("hashes", pack_sorted(mine[keep])), ("totals", total[keep].astype("<u4").tobytes()), ("counts", count[keep].astype("<u4").tobytes()), ("owners", bytes([packed[0]]) + pack_uint(owners, packed[0]))):
            out[name].append(value)
    return pa.table(out, schema=_BACK)


def survivors(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, size, prefix, shingles): documents that may link, with those of their shingles that
    others share, rarest first, packed as 64-bit integers; the first ``prefix`` name their blocks.

    Of equal sets in a chunk the document with the smallest id stands for all.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    bits = bucket_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    @leave("jaccard")
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, sets, seen = TaskContext.get().partitionId() << 24, 0, [], [], {}
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                shingles = shingle_set(body, words)
                mark = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                if not len(shingles):
                    continue
                at = seen.setdefault(mark, len(ids))
                if at < len(ids):
                    ids[at] = min(ids[at], doc)
                    continue
                ids.append(doc)
                sets.append(shingles)
                held += len(shingles)
                if held >= CHUNK_SHINGLES:
                    yield from (pa.RecordBatch.from_pylist([r], _SENT) for r in _chunk_rows(number, ids, sets, bits))
                    number, held, ids, sets, seen = number + 1, 0, [], [], {}
        if ids:
            yield from (pa.RecordBatch.from_pylist([r], _SENT) for r in _chunk_rows(number, ids, sets, bits))

    @leave("jaccard")
    def collect(key: tuple, group: pa.Table) -> pa.Table:
        table = np.frombuffer(next(d for d in group["docs"].to_pylist() if d is not None), "<i8")
        ids, sizes = np.split(table, 2)
        owners, hashes, totals = [], [], []
        for packed, count, owner, total in zip(*(group[n].to_pylist() for n in ("hashes", "counts", "owners", "totals"))):
            if packed is None:
                continue
            count = np.frombuffer(count, "<u4")
            hashes.append(np.repeat(unpack_sorted(packed), count))
            totals.append(np.repeat(np.frombuffer(total, "<u4"), count))
            owners.append(unpack_uint(owner[1:], owner[0]).astype(np.int64))
        out = []
        if hashes:
            owner, hashed, total = np.concatenate(owners), np.concatenate(hashes), np.concatenate(totals)
            shared = np.bincount(owner, minlength=len(ids))
            alive = shared >= needed(sizes, percent)
            keep = alive[owner]
            owner, hashed, total = owner[keep], hashed[keep], total[keep]
            order = np.lexsort((hashed, total, owner))
            owner, hashed = owner[order], hashed[order]
            for i in np.flatnonzero(alive).tolist():
                a, b = np.searchsorted(owner, [i, i + 1])
                # Shingles of this document alone come first in its prefix and name no block.
                prefix = int(sizes[i] - needed(sizes[i], percent) + 1 - (sizes[i] - shared[i]))
                out.append((int(ids[i]), int(sizes[i]), prefix, hashed[a:b].tobytes()))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "size": pa.array(columns[1], pa.int64()), "prefix": pa.array(columns[2], pa.int32()), "shingles": pa.array(columns[3], pa.binary())})

    sent = rows.mapInArrow(send, "bucket long, chunk long, docs binary, hashes binary, counts binary, owners binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared_shingles, "chunk long, docs binary, hashes binary, totals binary, counts binary, owners binary")
    return shared.groupBy("chunk").applyInArrow(collect, "doc_id long, size long, prefix int, shingles binary")


def candidate_edges(alive: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) edges that connect any two survivors that share a prefix shingle and whose sizes are
    near enough, with a number of edges in proportion to the prefixes."""

    @leave("jaccard")
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(2).to_numpy()
            tokens = [np.frombuffer(x, "<i8", count=int(n)) for x, n in zip(batch.column(3).to_pylist(), prefixes)]
            if tokens:
                take = pa.array(np.repeat(np.arange(len(tokens)), prefixes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), batch.column(0).take(take), batch.column(1).take(take)], ["token", "doc_id", "size"])

    # Sizes that may link differ by one step at most; a hair wider for the sake of rounding.
    step = float(np.log(100.0 / percent)) * 1.000001
    members = alive.mapInArrow(blocks, "token long, doc_id long, size long").withColumn("step", F.floor(F.log("size") / F.lit(step)))
    hubs = members.groupBy("token", "step").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
    stars = members.join(hubs.where("hub <> last"), ["token", "step"]).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    above = hubs.select("token", (F.col("step") - 1).alias("step"), F.col("hub").alias("b"))
    steps = hubs.select("token", "step", F.col("hub").alias("a")).join(above, ["token", "step"]).select("a", "b")
    return stars.union(steps).where("a <> b").distinct()


class SignatureTree:
    """A tree over shingle sets; ``links`` walks it against itself."""

    def __init__(self, ids: list[int], sizes: list[int], sets: list[np.ndarray], labels: list[int], parts: list[int] | None, percent: int):
        order = sorted(range(len(ids)), key=lambda i: (int(np.log2(sizes[i] + 1)), int(sets[i][0]) if len(sets[i]) else 0, ids[i]))
        self.ids = [ids[i] for i in order]
        self.sizes = np.array([sizes[i] for i in order], np.int64)
        self.sets = [sets[i] for i in order]
        self.parts = None if parts is None else [parts[i] for i in order]
        self.percent = percent
        self.parent = list(range(len(ids)))
        first: dict[int, int] = {}
        for at, i in enumerate(order):
            self.parent[at] = first.setdefault(labels[i], at)
        most = max(map(len, sets))
        bits = min(MAX_BITS, max(MIN_BITS, 1 << (2 * most - 1).bit_length()))
        flags = np.zeros((len(ids), bits), bool)
        for i, tokens in enumerate(self.sets):
            flags[i, (tokens & np.uint64(bits - 1)).astype(np.int64)] = True
        bitmaps = np.packbits(flags, axis=1).view(np.uint64)
        excess = np.array([len(s) for s in self.sets], np.int64) - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        #: levels[0] are documents, then leaves of LEAF documents, then FANOUT nodes to a node.
        self.levels = [(bitmaps, self.sizes, self.sizes, excess, 1)]
        while len(self.levels) == 1 or len(self.levels[-1][0]) > 1:
            maps, low, high, spare, span = self.levels[-1]
            width = LEAF if len(self.levels) == 1 else FANOUT
            cuts = np.arange(0, len(maps), width)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts), span * width)
            )

    def root(self, at: int) -> int:
        while self.parent[at] != at:
            self.parent[at] = self.parent[self.parent[at]]
            at = self.parent[at]
        return at

    def _one(self, level: int, node: int) -> int:
        """The component of a node's documents if they have a single one, else -1."""
        span = self.levels[level][4]
        first = self.root(node * span)
        for at in range(node * span + 1, min((node + 1) * span, len(self.ids))):
            if self.root(at) != first:
                return -1
        return first

    def _possible(self, level: int, a: int, b: int) -> bool:
        """Whether some document of a and some of b can overlap enough."""
        maps, low, high, spare, _ = self.levels[level]
        if self.percent * low[a] > 100 * high[b] or self.percent * low[b] > 100 * high[a]:
            return False
        most = int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(spare[a], spare[b])
        return (100 + self.percent) * min(most, high[a], high[b]) >= self.percent * (low[a] + low[b])

    def links(self) -> list[tuple[int, int]]:
        """Linked pairs that connect all that links connect: one for each merge of components."""
        found: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if a != b and not self._possible(level, a, b):
                continue
            one = self._one(level, a)
            if one >= 0 and (a == b or one == self._one(level, b)):
                continue
            if level == 1:
                self._leaves(a, b, found)
                continue
            children = len(self.levels[level - 1][0])
            left = range(a * FANOUT, min((a + 1) * FANOUT, children))
            right = range(b * FANOUT, min((b + 1) * FANOUT, children))
            # Last in, first out: nodes against themselves come first and connect the most.
            pairs = [(level - 1, i, j) for i in left for j in right if a != b or i <= j]
            stack += sorted(pairs, key=lambda p: p[1] == p[2])
        return found

    def _leaves(self, a: int, b: int, found: list[tuple[int, int]]) -> None:
        maps, sizes, _, spare, _ = self.levels[0]
        left, right = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
        most = np.bitwise_count(maps[left, None] & maps[None, right]).sum(axis=2, dtype=np.int64) + np.minimum(spare[left, None], spare[None, right])
        both = sizes[left, None] + sizes[None, right]
        most = np.minimum(most, np.minimum(sizes[left, None], sizes[None, right]))
        for i, j in np.argwhere((100 + self.percent) * most >= self.percent * both).tolist():
            i, j = i + a * LEAF, j + b * LEAF
            if i >= j and a == b or self.parts is not None and self.parts[i] == self.parts[j]:
                continue
            first, second = self.root(i), self.root(j)
            if first == second:
                continue
            common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
            if 100 * common >= self.percent * (int(sizes[i] + sizes[j]) - common):
                self.parent[max(first, second)] = min(first, second)
                found.append((self.ids[i], self.ids[j]))


def _joined(groups: DataFrame, keys: list[str], percent: int, across: bool) -> DataFrame:
    """(a, b) verified links within each group of (doc_id, size, shingles, label, part); with
    ``across`` only between parts, as those within are known."""

    @leave("jaccard")
    def join(key: tuple, group: pa.Table) -> pa.Table:
        sets = [np.sort(np.frombuffer(x, "<u8")) for x in group["shingles"].to_pylist()]
        parts = group["part"].to_pylist() if across else None
        tree = SignatureTree(group["doc_id"].to_pylist(), group["size"].to_pylist(), sets, group["label"].to_pylist(), parts, percent)
        links = tree.links()
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return groups.select(*keys, *[c for c in ("doc_id", "size", "shingles", "label", "part") if c not in keys]).groupBy(*keys).applyInArrow(join, "a long, b long")


def linked_components(alive: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) for the survivors that have links."""
    candidates = connected_components(candidate_edges(alive, percent)).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "candidate")
    grouped = alive.join(candidates, "doc_id")
    sizes = grouped.groupBy("candidate").agg(F.count("*").alias("docs"), F.sum(F.octet_length("shingles") / 8).alias("held"))
    parts = F.ceil(F.greatest(F.col("docs") / GROUP_DOCS, F.col("held") / GROUP_SHINGLES)).cast("int")
    sizes = sizes.where("docs > 1").withColumn("parts", parts)
    members = grouped.join(sizes, "candidate").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    members = stash(members.select("candidate", "parts", "part", "docs", "doc_id", "size", "shingles"), "members")

    # Every part of a large group is joined alone, but for about PIVOTS of the group's documents,
    # which stand in all its parts: what links to one of them is connected across parts.
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.col("docs")) < PIVOTS)
    stands = F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = members.withColumn("label", F.col("doc_id")).withColumn("part", F.explode(stands))
    found = stash(_joined(first, ["candidate", "part"], percent, False), "links")
    components = connected_components(found)
    large = members.where("parts > 1")
    if large.isEmpty():
        return components

    # Pairs of parts with more than one component between them are joined in full.
    named = components.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label")
    known = large.join(named, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    spread = known.groupBy("candidate", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = spread.select("candidate", F.col("part").alias("part_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    open_pairs = spread.join(other, "candidate").where("part < part_b and not (low = high and low_b = high_b and low = low_b)")
    open_pairs = stash(open_pairs.select("candidate", F.col("part").alias("part_a"), "part_b"), "pairs")
    if open_pairs.isEmpty():
        return components
    sides = open_pairs.select("candidate", F.col("part_a").alias("part"), "part_a", "part_b").union(open_pairs.select("candidate", F.col("part_b").alias("part"), "part_a", "part_b"))
    across = _joined(known.join(sides, ["candidate", "part"]), ["candidate", "part_a", "part_b"], percent, True)
    return connected_components(found.union(across))


def similar_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``.

    A-Z is lower-cased; ``component_id`` is the smallest id reachable by links.  Null and empty
    texts link with nothing.  Rows with a null id are left unlinked, with a null component; rows
    that repeat an id are linked by it.  An empty table gives no rows.
    """
    classes = stash(shingle_classes(df, id_col, text, words), "classes")
    leaders = classes.where("set_print is not null and doc_id is not null").groupBy("set_print").agg(F.min("doc_id").alias("leader"))
    alive = survivors(df, id_col, text, words, percent)
    alive = stash(alive.join(leaders.select(F.col("leader").alias("doc_id")), "doc_id", "left_semi"), "survivors")
    components = linked_components(alive, percent)
    # Written down, so that the join below has a shuffle on either side and Spark can split a hot class.
    named = stash(leaders.join(components, F.col("leader") == F.col("node"), "left").select("set_print", F.coalesce("component", "leader").alias("component_id")), "named")
    return classes.join(named, "set_print", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, with all their columns, whatever their
    names; rows with a null id stay, and so do rows that repeat such an id; an empty table stays empty."""
    rows, (id_at, text_at) = by_number(df, id_col, text)
    gone = similar_components(rows, id_at, text_at, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return rows.join(gone, F.col(id_at).cast("long") == F.col("gone"), "left_anti").toDF(*df.columns)
