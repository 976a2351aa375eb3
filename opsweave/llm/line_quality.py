"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before and after
it; forward-backward marginals, weighted by line length, make up the document's quality, which one
logistic curve then calibrates.  The model is fitted on whole labelled documents, at most
``SAMPLE_DOCS`` with ``SAMPLE_LINES`` lines in all.  Features see the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import by_number, bytes_of, leave, stash

#: Labelled documents, and lines of all of them together, that the model is fitted on at most.
SAMPLE_DOCS = 4_000
SAMPLE_LINES = 200_000
STEPS = 250
RATE = 0.05
PENALTY = 1e-3
#: Lines that are scored at once, and cells of the table (documents by their longest one's lines)
#: that forward-backward fills at once.
BATCH_LINES = 8_000
TABLE_CELLS = 80_000

_CLASSES = ("upper", "lower", "digit", "space", "bang", "pipe", "markup", "point", "other", "high")
_CLASS_OF = np.full(256, 8, np.uint8)
_CLASS_OF[ord("A") : ord("Z") + 1] = 0
_CLASS_OF[ord("a") : ord("z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2
_CLASS_OF[[9, 10, 11, 12, 13, 32]] = 3
_CLASS_OF[[ord("!"), ord("?")]] = 4
_CLASS_OF[ord("|")] = 5
_CLASS_OF[[ord(c) for c in "#$%&*<>{}=+~^_\\"]] = 6
_CLASS_OF[[ord(c) for c in ".,;:'\"-()"]] = 7
_CLASS_OF[128:] = 9

FEATURES = (*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "distinct", "longest", "ends_in_point", "seen_before")
WIDTH = len(FEATURES)


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line); a null or empty text is one empty line."""
    data = text or b""
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    own = np.zeros((len(lines), WIDTH))
    if data:
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        kinds = _CLASS_OF[np.frombuffer(data, np.uint8)]
        owner = np.repeat(np.arange(len(lines)), sizes + 1)[: len(data)]
        counts = np.bincount(owner * 10 + kinds, minlength=len(lines) * 10).reshape(-1, 10).astype(float)
        line_breaks = starts[1:] - 1
        counts[owner[line_breaks], 3] -= 1
        own[:, :10] = counts / np.maximum(1, sizes)[:, None]
    own[:, 10] = np.log1p(sizes)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        own[i, 11] = n
        own[i, 13] = len(set(words)) / n if n else 1.0
        own[i, 14] = max(map(len, words)) if n else 0
        own[i, 15] = line.endswith((b".", b"?", b":"))
        own[i, 16] = n > 0 and line in seen
        seen.add(line)
    own[:, 12] = np.minimum(40, (sizes + 1) / np.maximum(1, own[:, 11]))
    own[:, 11] = np.log1p(own[:, 11])
    own[:, 14] = np.log1p(own[:, 14])
    return own, sizes


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A constant, a line's features, and those of the lines before and after it (zeros outside)."""
    none = np.zeros((1, own.shape[1]))
    return np.hstack([np.ones((len(own), 1)), own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


@dataclass
class LineCrf:
    """Weights of label good against bad, transition scores [from, to], and the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, scores: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """P(good) of every line of each document, and the sum of pair marginals [from, to]."""
        order = np.argsort([-len(s) for s in scores], kind="stable")
        lengths = np.array([len(scores[i]) for i in order])
        longest = int(lengths[0]) if len(lengths) else 0
        padded = np.zeros((len(scores), longest))
        for row, i in enumerate(order):
            padded[row, : len(scores[i])] = scores[i]
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # documents with more than t lines
        forward = np.zeros((longest, len(scores), 2))
        backward = np.zeros((longest, len(scores), 2))
        if longest:
            forward[0, :, 1] = padded[:, 0]
        for t in range(1, longest):
            n = active[t]
            before = forward[t - 1, :n]
            forward[t, :n, 0] = np.logaddexp(before[:, 0] + self.moves[0, 0], before[:, 1] + self.moves[1, 0])
            forward[t, :n, 1] = np.logaddexp(before[:, 0] + self.moves[0, 1], before[:, 1] + self.moves[1, 1]) + padded[:n, t]
        for t in range(longest - 2, -1, -1):
            n = active[t + 1]
            good = backward[t + 1, :n, 1] + padded[:n, t + 1]
            for state in (0, 1):
                backward[t, :n, state] = np.logaddexp(self.moves[state, 0] + backward[t + 1, :n, 0], self.moves[state, 1] + good)
        both = forward + backward
        total = np.logaddexp(both[0, :, 0], both[0, :, 1]) if longest else np.zeros(len(scores))
        good = np.exp(both[:, :, 1] - total[None, :])
        pairs = np.zeros((2, 2))
        for t in range(longest - 1):
            n = active[t + 1]
            for a in (0, 1):
                for b in (0, 1):
                    step = forward[t, :n, a] + self.moves[a, b] + b * padded[:n, t + 1] + backward[t + 1, :n, b] - total[:n]
                    pairs[a, b] += np.exp(step).sum()
        out: list[np.ndarray] = [np.zeros(0)] * len(scores)
        for row, i in enumerate(order):
            out[i] = good[: lengths[row], row]
        return out, pairs

    def raw_quality(self, owns: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the marginals of each document, as a log-odds."""
        lengths = np.array([len(o) for o in owns])
        scores = np.split(self.emissions_of(owns), np.cumsum(lengths)[:-1]) if owns else []
        mean = np.zeros(len(owns))
        order = np.argsort(-lengths, kind="stable")  # documents of like length share a table
        first = 0
        while first < len(order):
            some = order[first : first + max(1, TABLE_CELLS // int(lengths[order[first]]))]
            found, _ = self.marginals([scores[i] for i in some])
            for i, p in zip(some, found):
                mean[i] = np.average(p, weights=sizes[i] + 1.0)
            first += len(some)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def emissions_of(self, owns: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([with_neighbours((own - self.mean) / self.scale) for own in owns]) @ self.weights

    def quality(self, owns: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw_quality(owns, sizes) + self.shift)))


def fit(owns: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> LineCrf:
    """Maximum likelihood of all lines of a document having its label, by Adam; then the calibration."""
    stacked = np.concatenate(owns)
    scale = stacked.std(axis=0)
    model = LineCrf(stacked.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(1 + 3 * WIDTH), np.zeros((2, 2)))
    inputs = np.concatenate([with_neighbours((own - model.mean) / model.scale) for own in owns])
    counts = np.array([len(o) for o in owns])
    cuts = np.cumsum(counts)[:-1]
    truth = np.repeat(labels, counts).astype(float)
    moved = np.array([[(counts - 1)[labels == 0].sum(), 0.0], [0.0, (counts - 1)[labels == 1].sum()]])
    target = inputs.T @ truth
    values = np.zeros(inputs.shape[1] + 4)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        model.weights, model.moves = values[:-4], values[-4:].reshape(2, 2)
        found, pairs = model.marginals(np.split(inputs @ model.weights, cuts))
        slope = np.concatenate([target - inputs.T @ np.concatenate(found), (moved - pairs).ravel()]) / len(stacked) - PENALTY * values
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        values = values + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.moves = values[:-4], values[-4:].reshape(2, 2)
    raw = model.raw_quality(owns, sizes)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, a little ridge on the slope
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((labels - p) * raw).sum() - 1e-3 * a, (labels - p).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
    model.slope, model.shift = max(a, 1e-3), b
    return model


def is_held_out(doc_id: Column) -> Column:
    """True for the third of ids that no label is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text: str = "text", sample_lines: int = SAMPLE_LINES
) -> LineCrf | None:
    """The model, or None where no usable label is left (an empty table, null or other labels).

    The sample is the ``sample_docs`` labelled ids with the smallest hash among those not held out; one
    row stands for rows that repeat an id.  Documents are taken whole, in this order, as long as they
    fit into ``sample_lines`` together; one that does not is passed over.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("_labelled"), body.alias("_text"))
    # The sample has at most `sample_docs` rows of two numbers.
    joined = rows.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_labelled")), "_labelled")
    sample = stash(joined.groupBy("_labelled").agg(F.first("_quality").alias("_quality"), F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")), "sample")
    sizes = sample.select("_labelled", F.size(F.split("_text", "\n")).alias("n")).orderBy(F.xxhash64("_labelled"), "_labelled").collect()  # at most `sample_docs` rows
    taken, left = [], sample_lines
    for r in sizes:
        if r["n"] <= left:
            taken.append(r["_labelled"])
            left -= r["n"]

    @leave("line_quality")
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, sizes = [], []
            for body in bytes_of(batch.column(1)):
                own, size = line_features(body)
                blobs.append(own.astype("<f4").tobytes())
                sizes.append(size.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], ["quality", "features", "sizes"])

    picked = documents.sparkSession.createDataFrame([(i,) for i in taken], sample.select("_labelled").schema)
    found = sample.join(F.broadcast(picked), "_labelled").select("_quality", "_text").mapInArrow(features, "quality int, features binary, sizes binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["features"], r["quality"]))  # the same model whatever the order of tasks
    owns = [np.frombuffer(r["features"], "<f4").reshape(-1, WIDTH).astype(float) for r in found]
    return fit(owns, [np.frombuffer(r["sizes"], "<i8") for r in found], np.array([r["quality"] for r in found]))


def score(documents: DataFrame, model: LineCrf | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the quality of every text from 0 to 1.  Null counts as empty; without a model
    every score is 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @leave("line_quality")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = shared.value
        for column in batches:
            if crf is None:
                yield pa.array(np.full(len(column), 0.5))
                continue
            out, owns, sizes, held = [], [], [], 0
            for body in bytes_of(column):
                own, size = line_features(body)
                owns.append(own)
                sizes.append(size)
                held += len(own)
                if held >= BATCH_LINES:
                    out.append(crf.quality(owns, sizes))
                    owns, sizes, held = [], [], 0
            if owns:
                out.append(crf.quality(owns, sizes))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return documents.withColumn(out, F.arrow_udf(run, "double")(F.col(text).cast("string")))


def predict(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``, repeated ones too.

    A null id is not held out; null and empty texts are scored as one empty line; an empty table gives
    no rows; other columns are ignored.
    """
    scored = score(documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), train(documents, labels, id_col=id_col, text=text))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose score is at least 0.5, with all their columns, repeated rows too;
    an empty table stays empty."""
    rows, (id_at, text_at) = by_number(documents, id_col, text)
    scored = score(rows, train(rows, labels, id_col=id_at, text=text_at), text_at, "score")
    return scored.where("score >= 0.5").drop("score").toDF(*documents.columns)
