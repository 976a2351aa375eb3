"""Retrieval over a text and vector corpus: inverted index, lexical and vector search, fusion, MMR.

Queries come in batches and every search is one job over all of them.  Vectors meet queries in blocks of
bounded size, each task keeps its best ``k`` a query, and a window over what is left gives the result.
Lexical search is in ``postings``, indexed vector search in ``ivf``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from opsweave.functions.text import spaced_words, tokens

LEAST_SIMILARITY = 0.05
#: Queries that are broadcast at once; more are searched block after block.
QUERY_BLOCK = 4096
#: Queries and vectors whose similarities a task holds at once.
QUERY_TILE, DOC_TILE = 512, 2048
SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 0.6, 0.4
#: Digits of a score that decide an order, so that it does not hang on summation order.
DIGITS = 9


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(term, doc_id): distinct terms of each document, or of its first ``most`` tokens.

    Terms are made distinct inside the row, so nothing shuffles unless rows repeat an id.
    """
    words = tokens(F.col(text))
    if most is not None:
        words = F.slice(words, 1, most)
    return docs.select(F.explode(F.array_distinct(words)).alias("term"), F.col(id_col).alias("doc_id"))


def remove_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The postings without those of the ids in ``gone``."""
    return index.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*index.columns)


def vacuum(index: DataFrame, live: DataFrame, rare: int = 3) -> DataFrame:
    """Terms with fewer than ``rare`` documents keep live documents only; empty terms go."""
    alive = live.select("doc_id", F.lit(True).alias("_live")).dropDuplicates(["doc_id"])
    counts = index.groupBy("term").agg(F.countDistinct("doc_id").alias("_docs"))
    marked = index.join(counts, "term").join(alive, "doc_id", "left")
    return marked.where((F.col("_docs") >= rare) | F.col("_live")).select(*index.columns)


def top_k(scored: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query, equal scores by id, with their rank from 1."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round(score, DIGITS)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, least: float) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        found_ids, found = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        best, best_ids = np.zeros((len(q), k)), np.zeros((len(q), k), np.int64)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            right = [i for i, v in enumerate(rows) if v is not None and len(v) == q.shape[1] and None not in v]
            if not right:
                continue
            ids = batch.column(0).to_numpy()[right]
            for first in range(0, len(right), DOC_TILE):
                v = np.array([rows[i] for i in right[first : first + DOC_TILE]], float)
                norms = np.linalg.norm(v, axis=1)
                v = v / np.where(norms > 0, norms, 1.0)[:, None]
                for a in range(0, len(q), QUERY_TILE):
                    z = slice(a, a + QUERY_TILE)
                    sims = np.concatenate([found[z], q[z] @ v.T], axis=1)
                    docs = np.concatenate([found_ids[z], np.broadcast_to(ids[first : first + DOC_TILE], (len(sims), len(v)))], axis=1)
                    order = np.lexsort((docs, -np.round(sims, DIGITS)), axis=1)[:, :k]
                    best[z, : order.shape[1]], best_ids[z, : order.shape[1]] = np.take_along_axis(sims, order, 1), np.take_along_axis(docs, order, 1)
                width = min(k, found.shape[1] + len(v))
                found, found_ids = best[:, :width].copy(), best_ids[:, :width].copy()
        keep = found > least
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, keep.sum(axis=1))), pa.array(found_ids[keep]), pa.array(found[keep])], ["query_id", "doc_id", "score"]
        )

    return vectors.mapInArrow(run, "query_id long, doc_id long, score double")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vector: str = "embedding", least: float = LEAST_SIMILARITY, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine search, similarities above ``least``.

    ``queries`` has query_id and a vector.  A zero vector is like none (0); vectors that are null, have
    nulls or another length are left out.  Queries are read ``block`` at a time, ``block`` vectors being
    the most that the driver holds or broadcasts.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector).cast("array<double>").alias("v")).where("doc_id is not null")
    asked = queries.where(F.col(vector).isNotNull() & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v"))
    n = asked.count()
    parts = 1 if n <= block else -(-2 * n // block)  # dealt by hash, so planned at half the bound
    out = None
    for part in range(parts):
        got = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
        if not got:
            continue
        width = max(len(r["v"]) for r in got)
        got = [r for r in got if len(r["v"]) == width and None not in r["v"]]
        matrix = np.array([r["v"] for r in got], float)
        norms = np.linalg.norm(matrix, axis=1)
        found = _search_block(rows, np.array([r["query_id"] for r in got], np.int64), matrix / np.where(norms > 0, norms, 1.0)[:, None], k, least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(out, k)


def fuse(semantic: DataFrame, lexical: DataFrame, semantic_weight: float = SEMANTIC_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """(query_id, doc_id, score): weighted sum of both scores; one union and one aggregation."""
    both = semantic.select("query_id", "doc_id", (F.col("score") * semantic_weight).alias("score")).unionByName(
        lexical.select("query_id", "doc_id", (F.col("score") * lexical_weight).alias("score"))
    )
    return both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def fused_candidates(semantic: DataFrame, lexical: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score): both searches' rows fused, those of at least ``max(threshold / 2, 0.1)``."""
    return fuse(semantic, lexical).where(F.col("score") >= max(0.5 * threshold, 0.1))


def hybrid_search(semantic: DataFrame, lexical: DataFrame, k: int, threshold: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` of the ``3 k`` candidates that either search gives, fused."""
    return top_k(fused_candidates(semantic, lexical, threshold), k)


def diversified(semantic: DataFrame, lexical: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.3, weight: float = 0.5) -> DataFrame:
    """(query_id, doc_id, rank): hybrid search whose last step is ``mmr`` where a query has more than ``k`` fused
    candidates, and the fused order where it has not.

    Relevance in ``mmr`` is the cosine of query and document; one without a vector counts as 0.
    """
    fused = top_k(fused_candidates(semantic, lexical, threshold), 6 * k)  # 3 k of either search at the most
    sizes = fused.groupBy("query_id").agg((F.count("*") > k).alias("_many"))
    marked = fused.join(sizes, "query_id")
    v = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["doc_id"])
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_asked")).dropDuplicates(["query_id"])
    rows = marked.where("_many").join(v, "doc_id", "left").join(q, "query_id", "left")
    picked = mmr(rows.select("query_id", "doc_id", cosine("_asked", "embedding").alias("score"), "embedding"), k, weight)
    return picked.unionByName(marked.where(~F.col("_many")).select("query_id", "doc_id", "rank"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays; 0 where one is null, zero or of another length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.when(F.size(a) == F.size(b), F.try_divide(dot, size)), F.lit(0.0))


def mmr(candidates: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """(query_id, doc_id, rank): greedy choice by ``weight * score - (1 - weight) * max similarity to
    those chosen``.  ``candidates`` has query_id, doc_id, score and a vector (null: similar to none); a group
    is one query's candidates, a bounded number."""

    def choose(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("score", "descending"), ("doc_id", "ascending")])
        rows = group["embedding"].to_pylist()
        width = max((len(x) for x in rows if x), default=1)
        v = np.array([x if x and len(x) == width else [0.0] * width for x in rows], float)
        norms = np.linalg.norm(v, axis=1)
        v = v / np.where(norms > 0, norms, 1.0)[:, None]
        score, ids = group["score"].to_numpy(), group["doc_id"].to_numpy()
        closest, left, chosen = np.zeros(len(ids)), np.ones(len(ids), bool), []
        while left.any() and len(chosen) < k:
            value = np.where(left, np.round(weight * score - (1 - weight) * closest, DIGITS), -np.inf)
            at = int(value.argmax())
            chosen.append(at)
            left[at] = False
            closest = np.maximum(closest, v @ v[at]) if len(chosen) > 1 else v @ v[at]
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(chosen), pa.int64()), "doc_id": ids[chosen], "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    rows = candidates.select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"), F.col("score").cast("double"), F.col("embedding").cast("array<double>"))
    return rows.groupBy("query_id").applyInArrow(choose, "query_id long, doc_id long, rank int")


def rerank(candidates: DataFrame, query: str = "query", text: str = "text", first: int = 100) -> DataFrame:
    """Adds ``reranked``: 0.6 of the score (0.5 where it is null) and 0.4 of the share of a query's distinct words, as white
    space separates them, that are among the text's first 100.  A query without words has no share."""
    asked = F.array_distinct(spaced_words(F.lower(F.coalesce(query, F.lit("")))))
    seen = F.slice(spaced_words(F.lower(F.coalesce(text, F.lit("")))), 1, first)
    share = F.size(F.array_intersect(asked, seen)) / F.greatest(F.size(asked), F.lit(1))
    return candidates.withColumn("reranked", F.lit(0.6) * F.coalesce("score", F.lit(0.5)) + F.lit(0.4) * share)


def best_reranked(candidates: DataFrame, k: int = 5, least: float = 0.1, query: str = "query", text: str = "text") -> DataFrame:
    """(query_id, doc_id, reranked, rank, text): candidates over ``least`` by their reranked score, ties by doc_id, numbered;
    with ``k`` None all.  Candidates of a query are bounded by the search before."""
    scored = rerank(candidates, query, text).where(F.col("reranked") > least)
    order = Window.partitionBy("query_id").orderBy(F.round("reranked", 9).desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "reranked", "rank", text)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


# What makes a query ask for an overview, and the words that then lift or lower a document.
OVERVIEW_QUERY = ("介绍", "平台", "概述", "什么是", "简介", "功能", "特性", "总览")
OVERVIEW_SOURCE = ("总览", "平台", "介绍", "核心")
OVERVIEW_CONTENT = ("平台简介", "核心功能", "平台概述", "平台是")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def document_priority(query: Column, source: Column, text: Column, score: Column, names: tuple[str, ...] = ()) -> Column:
    """Ten times the score, and what a document gains or loses by what its query asks for.  ``names``: further
    words of a text's first 500 characters that make it an overview."""
    query, source, text = (F.coalesce(x, F.lit("")) for x in (query, F.lower(source), F.lower(text)))
    overview = (
        F.when(_any_of(source, OVERVIEW_SOURCE), 200)
        .when(_any_of(F.substring(text, 1, 500), (*names, *OVERVIEW_CONTENT)), 150)
        .when(F.contains(source, F.lit("故障诊断")) | F.contains(F.substring(text, 1, 200), F.lit("故障")), -100)
        .when(_any_of(source, ("部署", "配置")), -30)
        .otherwise(0)
    )
    other = F.when(F.contains(query, F.lit("故障")) & _any_of(source, ("故障", "诊断")), 50).when(F.contains(query, F.lit("部署")) & F.contains(source, F.lit("部署")), 50).otherwise(0)
    return F.when(_any_of(query, OVERVIEW_QUERY), overview).otherwise(other) + 10 * score


def context_parts(ranked: DataFrame, budget: int = 4000, least_left: int = 200, margin: int = 10, names: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``place`` (from 1, by priority), ``part`` (head and content) and ``cut``; rows beyond the budget go.

    ``ranked`` has query_id, query, doc_id, source, text, score.  A part is a head with place, source and score, a
    line end and the content.  The first document that finds no more than ``least_left`` characters ends the
    context; one that does not fit is cut to what is left, with three dots.
    """
    priority = document_priority(F.col("query"), F.col("source"), F.col("text"), F.col("score"), names)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("_priority", DIGITS)), F.desc(F.round("score", DIGITS)), "doc_id")
    so_far = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("text", F.lit(""))
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" - 来源: "), "source")).otherwise("")
    score = F.when(F.col("score") != 0, F.format_string(" - 相关性: %.2f", F.col("score"))).otherwise("")
    placed = ranked.withColumn("_priority", priority).withColumn("place", F.row_number().over(order))
    headed = placed.withColumn("_head", F.concat(F.lit("[文档"), F.col("place").cast("string"), source, score, F.lit("]")))
    before = F.coalesce(F.sum(F.length("_head") + 1 + F.length(text)).over(so_far), F.lit(0))  # whole so far: a cut one ends the context
    left = headed.withColumn("_left", budget - before - F.length("_head") - margin)
    kept = left.withColumn("_least", F.min("_left").over(up_to)).where(F.col("_least") > least_left)
    cut = F.length(text) > F.col("_left")
    content = F.when(cut, F.concat(F.substring(text, F.lit(1), F.col("_left").cast("int")), F.lit("..."))).otherwise(text)
    return kept.withColumn("part", F.concat("_head", F.lit("\n"), content)).withColumn("cut", cut).drop("_priority", "_head", "_left", "_least")


def answer_confidence(ranked: DataFrame, answer_chars: Column) -> DataFrame:
    """(query_id, confidence): 0.3 for three sources, 0.4 of the mean of the three best scores, 0.15
    for 500 characters of answer."""
    best = F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("best")
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max(answer_chars).alias("chars"), best)
    value = F.lit(0.3) * F.least(F.col("n") / 3, F.lit(1.0)) + F.lit(0.4) * F.col("best") + F.lit(0.15) * F.least(F.col("chars") / 500, F.lit(1.0))
    return counts.where("best is not null").select("query_id", value.alias("confidence"))


def md_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 800) -> DataFrame:
    """(doc_id, chunk_index, n_chars, chunk_id, chunk): paragraphs gathered into chunks of ``most``
    characters; a longer paragraph is a chunk by itself.

    One fold over a row's paragraphs, inside the row.
    """
    paragraphs = F.filter(F.split(text, "\n+"), lambda p: F.trim(p) != "")

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last) + 1 + F.length(p) <= most)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws("\n", last, p)))
        return F.when(fits, joined).otherwise(F.concat(done, F.array(p)))

    chunks = F.aggregate(paragraphs, F.array().cast("array<string>"), add)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_id"), "chunk")
