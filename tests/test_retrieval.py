"""Retrieval operators against plain versions: IVF, posting blocks, MMR, context assembly."""

import random
import re

import __spark_entry__ as E
import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.operators import hierarchy, ivf, postings, retrieval

QUERIES = E.queries()
K = 10


def found_by(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    return out


# ---- indexed vector search ----


def clustered(spark, n=3000, width=16, centres=25):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(centres, width))
    v = c[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, width))
    v[100:1100] = v[100]  # a third of all rows is one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(n, [0.0] * width), (n + 1, None), (n + 2, [1.0]), (n + 3, [None] * width), (None, [1.0] * width)]
    return spark.createDataFrame(rows + odd, "doc_id long, embedding array<double>").repartition(7)


@pytest.fixture(scope="module")
def given(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")


@pytest.fixture(params=["given", "made"])
def vectors(request, spark, given):
    return given if request.param == "given" else clustered(spark)


def asked_of(vectors):
    return vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def test_ivf_exact_is_the_full_scan(vectors):
    want = found_by(retrieval.vector_search(vectors, asked_of(vectors), K))
    index = ivf.build(vectors, K)
    for probes in (1, 3):
        assert found_by(ivf.search(index, asked_of(vectors), K, probes=probes, exact=True)) == want
    assert found_by(ivf.search(index, asked_of(vectors), K, exact=True, block=7)) == want


def test_ivf_recall(vectors):
    want = found_by(retrieval.vector_search(vectors, asked_of(vectors), K))
    found = found_by(ivf.search(ivf.build(vectors, K), asked_of(vectors), K))
    hits = sum(score >= want[q][-1][1] for q, rows in found.items() for _, score in rows)  # equal scores count alike
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ivf_probes_few_cells_of_clustered_vectors(spark):
    index = ivf.build(clustered(spark), K)
    assert index.probes <= len(index.centroids) / 3
    assert index.rows.select("doc_id").distinct().count() == index.rows.count() == 3001  # every vector, once


def test_ivf_saved_and_loaded(spark, given, tmp_path):
    index = ivf.build(given, K)
    index.save(f"file://{tmp_path}/index")
    again = ivf.Index.load(spark, f"file://{tmp_path}/index")
    assert found_by(ivf.search(again, asked_of(given), K, probes=2)) == found_by(ivf.search(index, asked_of(given), K, probes=2))
    plan = again.rows.where(F.col("cell").isin(1, 2))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*cell", plan)


def test_ivf_of_nothing(spark, given):
    empty = given.limit(0)
    assert ivf.build(empty) is None and ivf.search(None, asked_of(given), K).count() == 0
    assert ivf.search(ivf.build(given), asked_of(empty), K).count() == 0


# ---- lexical search ----


def plain_lexical(docs, queries, k):
    out = {}
    for q, text in queries:
        terms = set(re.findall(r"\w+", (text or "").lower()))
        if q is None or not terms:
            continue
        scored = [(-len(terms & set(re.findall(r"\w+", (t or "").lower()))), d) for d, t in docs if d is not None]
        rows = [(d, round(-n / len(terms), 6)) for n, d in sorted(x for x in scored if x[0])[:k]]
        if rows:
            out[q] = rows
    return out


@pytest.mark.parametrize("block_docs, query_terms", [(4096, 4_000_000), (3, 50), (64, 200)])
def test_lexical_blocks(spark, block_docs, query_terms):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(6000)]
    docs = [(i, " ".join(rng.sample(words, rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(None, "w1 w2"), (2000, None), (2001, ""), (2002, "!! ..")]
    queries = [(i, docs[i][1].upper()) for i in range(0, 300, 9)] + [(5000, None), (5001, "nowhere"), (None, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    blocks = postings.posting_blocks(frame, block_docs=block_docs)
    found = postings.lexical_search(blocks, spark.createDataFrame(queries, "query_id long, text string"), K, query_terms=query_terms)
    assert found_by(found) == plain_lexical(docs, queries, K)


def test_blocks_are_an_index(spark, data_dir, tmp_path):
    """Blocks that were written down hold the postings of the inverted index."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    postings.posting_blocks(docs, block_docs=50).write.parquet(f"file://{tmp_path}/blocks")
    got = set()
    for r in spark.read.parquet(f"file://{tmp_path}/blocks").collect():
        places, at = np.frombuffer(r.places, "<u2"), 0
        for term, n in zip(r.terms, r["counts"]):
            got |= {(term, r.doc_ids[p]) for p in places[at : at + n]}
            at += n
    assert got == {tuple(r) for r in retrieval.inverted_index(docs).collect()}


# ---- MMR and the context ----


def plain_mmr(candidates, k):
    """Greedy choice as by definition; candidates: (doc_id, relevance, vector) in order."""
    left, chosen = sorted(candidates, key=lambda c: (-round(c[1], 12), c[0])), []
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    while left and len(chosen) < k:
        value = [0.5 * c[1] - 0.5 * max((cos(c[2], x[2]) for x in chosen), default=0.0) for c in left]
        chosen.append(left.pop(max(range(len(left)), key=lambda i: (round(value[i], 9), -i))))
    return [c[0] for c in chosen]


def test_hybrid_with_mmr(spark, data_dir, given):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    asked = asked_of(given)
    lexical = postings.lexical_search(postings.posting_blocks(docs), docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"), 3 * K)
    semantic = retrieval.vector_search(given, asked, 3 * K)
    vectors = {r.doc_id: np.array(r.embedding, float) for r in given.collect()}
    fused = {}
    for r in retrieval.fused_candidates(semantic, lexical).collect():
        fused.setdefault(r.query_id, []).append((r.doc_id, r.score))
    got = {}
    for r in QUERIES["hybrid_mmr"](spark, data_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert set(got) == set(fused)
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    zero = np.zeros(64)
    for q, rows in fused.items():
        if len(rows) > K:
            asked_v = unit(vectors.get(q, zero))
            assert got[q] == plain_mmr([(d, float(asked_v @ unit(vectors.get(d, zero))), vectors.get(d, zero)) for d, _ in rows], K)
        else:
            assert got[q] == [d for d, _ in sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))]


def plain_context(rows, budget=4000):
    parts, used = [], 0
    for i, r in enumerate(rows, 1):
        head = f"[文档{i}" + (f" - 来源: {r['source']}" if r["source"] else "") + (f" - 相关性: {r['score']:.2f}" if r["score"] else "") + "]"
        room = budget - used - len(head) - 10
        if room <= 200:
            break
        text = r["text"] if len(r["text"]) <= room else r["text"][:room] + "..."
        parts.append((r["doc_id"], f"{head}\n{text}"))
        used += len(parts[-1][1])
    return parts


def test_context(spark):
    rng = random.Random(4)
    rows = []
    for q in range(30):
        for i in range(8):
            rows.append({"query_id": q, "query": "why", "doc_id": 8 * q + i, "source": rng.choice(["", "a", "long source name"]), "text": "字" * rng.randrange(2500), "score": round(0.9 - 0.07 * i, 2)})
    schema = "query_id long, query string, doc_id long, source string, text string, score double"
    found = retrieval.context_parts(spark.createDataFrame(rows, schema)).orderBy("query_id", "place").collect()
    for q in range(30):
        assert [(r.doc_id, r.part) for r in found if r.query_id == q] == plain_context([r for r in rows if r["query_id"] == q])


def test_priority(spark):
    schema = "query string, source string, text string, score double, want double"
    rows = [
        ("平台是什么", "核心.md", "x", 0.5, 205.0),
        ("平台介绍", "a.md", "平台简介 ...", 0.5, 155.0),
        ("平台介绍", "a.md", "Tool name", 0.0, 150.0),
        ("平台介绍", "故障诊断.md", "x", 0.5, -95.0),
        ("平台介绍", "部署.md", "x", 1.0, -20.0),
        ("故障原因", "诊断.md", "x", 0.2, 52.0),
        ("怎样部署", "部署.md", "x", 0.2, 52.0),
        ("why", None, None, 0.2, 2.0),
    ]
    frame = spark.createDataFrame(rows, schema)
    value = retrieval.document_priority(F.col("query"), F.col("source"), F.col("text"), F.col("score"), names=("tool name",))
    assert all(r.got == pytest.approx(r.want) for r in frame.select("want", value.alias("got")).collect())


def test_coarse_is_the_best_of_each_chosen_cluster(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(300)} | {300: None, 301: [0.0] * 4, 302: [1.0, None, 0.0, 0.0]}
    members = spark.createDataFrame([(i, i % 4, v) for i, v in vectors.items()] + [(400, None, [1.0] * 4)], "doc_id long, cluster int, embedding array<double>").repartition(5)
    asked = [(q, rng.normal(size=4).tolist(), c) for q, c in zip(range(1000, 1040), ["simple", "moderate", "complex", None] * 10)]
    chosen = [(q, c) for q, _, _ in asked for c in (q % 4, (q + 1) % 4)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, class string")
    for block in (4096, 7):
        out = hierarchy.coarse(queries, spark.createDataFrame(chosen, "query_id long, cluster int"), members, complexity="class", block=block)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # no row for each query and member
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
        for q, v, c in asked:
            want = []
            for cluster in (q % 4, (q + 1) % 4):
                scores = []
                for i, w in vectors.items():
                    if i % 4 == cluster:
                        w = np.zeros(4) if w is None or None in w else np.array(w)
                        scores.append((-round(float(w @ v / (np.linalg.norm(w) or 1) / np.linalg.norm(v)), 9), i))
                want += [(i, round(-s, 6)) for s, i in sorted(scores)[: {"simple": 3, "complex": 8}.get(c, 5)]]
            assert sorted(i for i, _ in got[q]) == sorted(i for i, _ in want)
            assert all(abs(s - dict(want)[i]) < 2e-6 for i, s in got[q])


def test_confidence_reads_the_search_once(spark):
    rows = [(1, 0.9, 1, "a" * 600), (1, 0.6, 2, "b"), (1, 0.3, 3, "c"), (1, 0.1, 4, "d"), (2, 0.5, 1, "e" * 100)]
    out = retrieval.answer_confidence(spark.createDataFrame(rows, "query_id long, score double, rank int, text string"), F.length("text"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id: round(r.confidence, 9) for r in out.collect()} == {1: round(0.3 + 0.4 * 0.6 + 0.15, 9), 2: round(0.1 + 0.2 + 0.03, 9)}
