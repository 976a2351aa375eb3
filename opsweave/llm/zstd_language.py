"""Language identification by compression: the language whose dictionary makes a text smallest.

One zstandard raw-content dictionary for each language holds sampled training texts.  A text is cut into blocks
(a block's own history must not outweigh the dictionary), every block is compressed with every dictionary, and
the sizes are summed over the whole text.  Narrow margins between the two smallest sums are rejections.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import CACHES, bytes_of, leave

#: Bytes of a language's dictionary, and of all dictionaries together: with many languages each gets less.
DICTIONARY_BYTES = 96 << 10
ALL_DICTIONARIES = 32 << 20
#: Characters of a training text that a dictionary takes at most, and how many times what fills it is drawn.
SAMPLE_CHARS = 4 << 10
SPARE = 4
#: Bytes of a block.
BLOCK = 512
#: Greedy matches of four bytes and more, anywhere in the dictionary.
PARAMETERS = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 18, "hash_log": 16, "chain_log": 17, "search_log": 4, "target_length": 16}
#: Margin (share of the smallest sum by which the next is larger) at which the score is one half; below it the
#: prediction is marked as rejected.
NARROW = 0.02
#: Remainder of crc32(id) modulo ``FOLDS`` that is held out.
FOLDS = 5
UNDETERMINED = "und"

_compressors: dict[int, list[zstandard.ZstdCompressor]] = {}
CACHES.append(_compressors.clear)


def held_out(id_col: str) -> Column:
    """A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def letters(text: Column) -> Column:
    """What is compared: lower-cased letters and their marks; everything between them is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the rows that are not held out and have both letters and language,
    the language with most rows first.

    Of each language ``SPARE`` times the texts that fill a dictionary are drawn by a hash (the rate follows from a
    count over all rows), and the dictionary takes of each, in order of that hash, one stretch of ``SAMPLE_CHARS``.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), letters(docs[f"`{text}`"].cast("string")).alias("text"), docs[f"`{lang}`"].cast("string").alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64("id", "text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    room = max(1 << 10, min(DICTIONARY_BYTES, ALL_DICTIONARIES // len(counts)))
    texts = SPARE * -(-room // SAMPLE_CHARS) + 16
    rates = docs.sparkSession.createDataFrame([(name, min(1.0, texts / n)) for name, n in counts.items()], "lang string, rate double")
    drawn = rows.join(F.broadcast(rates), "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    # A stretch that starts where the hash says, so that beginnings of texts do not stand for all of them.
    start = F.pmod(F.shiftright("draw", 20), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    found: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.select("lang", "draw", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).collect():
        found.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    # The end of a raw dictionary is the nearest to the text: what is cut off is its start.
    join = lambda parts: " ".join(part for _, part in sorted(parts, reverse=True)).encode()[-room:]
    return {name: join(found[name]) for name in sorted(found, key=lambda name: (-counts[name], name))}


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    parameters = zstandard.ZstdCompressionParameters(write_content_size=False, **PARAMETERS)
    out = []
    for data in dictionaries:
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
    return out


def smallest(text: bytes, models: list[zstandard.ZstdCompressor]) -> tuple[int, float]:
    """The number of the dictionary with the smallest sum (of equal ones the first) and the score from 0 to 1."""
    blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
    sizes = [sum(len(model.compress(block)) for block in blocks) for model in models]
    if len(sizes) == 1:
        return 0, 1.0
    best = min(sizes)
    at = sizes.index(best)
    margin = (min(sizes[:at] + sizes[at + 1 :]) - best) / best
    return at, margin / (margin + NARROW)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row.

    ``rejected`` marks predictions with a margin under ``NARROW`` (score under one half).  A text that is null or has
    no letter (Unicode category L) is ``und`` with score 0, as is every text when no language was learned.  Very
    long texts are read whole, block by block; repeated rows are predicted each.  A null id is held out.  Other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    names = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionaries.values()))

    @leave("zstd_language")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not _compressors:
            _compressors[0] = compressors(shared.value)
        for column in batches:
            found = [smallest(t, _compressors[0]) if t else (None, 0.0) for t in bytes_of(column)]
            at, score = zip(*found) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array([UNDETERMINED if k is None else names[k] for k in at], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    plain = letters(docs[f"`{text}`"].cast("string"))
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.when(plain.rlike(r"\p{L}") & F.lit(bool(names)), plain).alias("plain"))
    found = rows.select("doc_id", F.arrow_udf(run, "lang_pred string, score double")("plain").alias("found"))
    score = F.col("found.score")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("found.lang_pred").alias("lang_pred"), score.alias("score"), (score < 0.5).alias("rejected"))


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` with dictionaries learned from the rows of ``docs`` that are not held out."""
    return predict(docs, fit(docs))
