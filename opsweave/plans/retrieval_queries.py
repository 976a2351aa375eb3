"""Queries of the retrieval operators over documents and embeddings.

Query sets are the rows whose id is divisible by 50; a document's query is its whole text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsweave.functions import text as X
from opsweave.operators import hierarchy as H, ivf, postings, retrieval as R, store
from opsweave.plans.catalog import query
from opsweave.sources.shared import shared_dir
from opsweave.sources.tables import read_table

K = 10
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_INDEX = f"toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents), idx AS (SELECT doc_id, unnest(list_distinct(t)) AS term FROM toks)"
_LEXICAL = (
    _INDEX
    + f""", q AS (SELECT doc_id AS query_id, list_distinct({_TOKENS}) AS t FROM documents WHERE doc_id % 50 = 0),
    qt AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM q), hit AS (SELECT query_id, doc_id, count(*) / max(n) AS score FROM qt JOIN idx USING (term) GROUP BY ALL)"""
)
_VECTOR = """sim AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


def _best(of: str, k: int) -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {of} QUALIFY rank <= {k}"


def _documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


def _index(spark, d):
    return R.inverted_index(_documents(spark, d))


def _lexical(spark, d, k):
    return postings.lexical_search(postings.posting_blocks(_documents(spark, d)), _questions(spark, d), k)


def _questions(spark, d):
    return _documents(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _asked(spark, d):
    return _vectors(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@query("inverted_index", f"WITH {_INDEX} SELECT term, doc_id FROM idx")
def inverted_index(spark, d):
    return _index(spark, d)


@query("postings_delete", f"WITH {_INDEX} SELECT term, doc_id FROM idx WHERE doc_id % 7 <> 0")
def postings_delete(spark, d):
    return R.remove_documents(_index(spark, d), _documents(spark, d).where("doc_id % 7 = 0"))


@query(
    "postings_vacuum",
    f"WITH {_INDEX} SELECT term, doc_id FROM idx QUALIFY count(*) OVER (PARTITION BY term) >= 3 OR doc_id % 7 <> 0",
)
def postings_vacuum(spark, d):
    return R.vacuum(_index(spark, d), _documents(spark, d).where("doc_id % 7 <> 0"))


@query("lexical_search", f"WITH {_LEXICAL}, best AS ({_best('hit', K)}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM best")
def lexical_search(spark, d):
    return _lexical(spark, d, K).withColumn("score", F.round("score", 6))


@query("vector_search", f"WITH {_VECTOR}, near AS (SELECT * FROM sim WHERE score > 0.05), best AS ({_best('near', K)}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM best")
def vector_search(spark, d):
    return R.vector_search(_vectors(spark, d), _asked(spark, d), K).withColumn("score", F.round("score", 6))


@query(
    "hybrid_search",
    f"""WITH {_LEXICAL}, {_VECTOR}, near AS (SELECT * FROM sim WHERE score > 0.05), s AS ({_best('near', 3 * K)}), l AS ({_best('hit', 3 * K)}),
    fused AS (SELECT query_id, doc_id, sum(part) AS score FROM (SELECT query_id, doc_id, score * 0.6::DOUBLE AS part FROM s UNION ALL SELECT query_id, doc_id, score * 0.4::DOUBLE FROM l) GROUP BY ALL),
    good AS (SELECT * FROM fused WHERE score >= 0.15), best AS ({_best('good', K)}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM best""",
)
def hybrid_search(spark, d):
    semantic = R.vector_search(_vectors(spark, d), _asked(spark, d), 3 * K)
    return R.hybrid_search(semantic, _lexical(spark, d, 3 * K), K).withColumn("score", F.round("score", 6))


@query("hybrid_mmr")
def hybrid_mmr(spark, d):
    vectors, asked = _vectors(spark, d), _asked(spark, d)
    return R.diversified(R.vector_search(vectors, asked, 3 * K), _lexical(spark, d, 3 * K), vectors, asked, K)


@query("ivf_search")
def ivf_search(spark, d):
    vectors = _vectors(spark, d)
    return ivf.search(ivf.build(vectors, K), _asked(spark, d), K).withColumn("score", F.round("score", 6))


@query("ivf_search_exact", f"WITH {_VECTOR}, near AS (SELECT * FROM sim WHERE score > 0.05), best AS ({_best('near', K)}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM best")
def ivf_search_exact(spark, d):
    return ivf.search(ivf.build(_vectors(spark, d), K), _asked(spark, d), K, probes=2, exact=True).withColumn("score", F.round("score", 6))


@query("mmr_rerank")
def mmr_rerank(spark, d):
    vectors = _vectors(spark, d)
    found = R.vector_search(vectors, _asked(spark, d), 3 * K)
    return R.mmr(found.join(vectors, "doc_id").select("query_id", "doc_id", "score", "embedding"), K)


@query(
    "context_budget",
    f"""WITH {_LEXICAL}, best AS ({_best('hit', K)}),
    p AS (SELECT b.query_id, doc_id, d.text, b.score, d.source, row_number() OVER (PARTITION BY b.query_id ORDER BY round(10 * b.score, 9) DESC, round(b.score, 9) DESC, doc_id) AS place FROM best b JOIN documents d USING (doc_id)),
    h AS (SELECT *, '[文档' || place || CASE WHEN coalesce(source, '') <> '' THEN ' - 来源: ' || source ELSE '' END || CASE WHEN score <> 0 THEN printf(' - 相关性: %.2f', score) ELSE '' END || ']' AS head FROM p),
    l AS (SELECT *, 4000 - coalesce(sum(length(head) + 1 + length(text)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(head) - 10 AS room FROM h)
    SELECT query_id, doc_id, place, length(text) > room AS cut, CAST(length(head) + 1 + CASE WHEN length(text) > room THEN room + 3 ELSE length(text) END AS BIGINT) AS n_chars
    FROM l QUALIFY min(room) OVER (PARTITION BY query_id ORDER BY place) > 200""",
)
def context_budget(spark, d):
    documents = read_table(spark, d, "documents").select("doc_id", "text", "source")
    asked = _questions(spark, d).withColumnRenamed("text", "query")
    found = _lexical(spark, d, K).join(documents, "doc_id").join(asked, "query_id")
    return R.context_parts(found).select("query_id", "doc_id", "place", "cut", F.length("part").cast("long").alias("n_chars"))


@query(
    "answer_confidence",
    f"""WITH {_LEXICAL}, best AS ({_best('hit', K)}), n AS (SELECT query_id, count(*) AS n, avg(score) FILTER (rank <= 3) AS top, max(length(text)) AS chars FROM best JOIN documents USING (doc_id) GROUP BY query_id)
    SELECT query_id, round(0.3 * least(n / 3, 1.0) + 0.4 * top + 0.15 * least(chars / 500, 1.0), 6) AS confidence FROM n""",
)
def answer_confidence(spark, d):
    found = _lexical(spark, d, K).join(_documents(spark, d), "doc_id")
    return R.answer_confidence(found, F.length("text")).withColumn("confidence", F.round("confidence", 6))


@query(
    "text_structure",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, contains(text, '```') AS has_code,
    len(regexp_extract_all(text, '\[[^\]]*\]\([^)]*\)')) AS n_links, len(regexp_extract_all(text, '(?m)^#{1,6}\s')) AS n_titles,
    (SELECT count(*) FROM (SELECT unnest(['# ', '## ', '### ', '```', '- ', '* ', '1. ', '[', '](', '**', '|']) AS s) WHERE contains(text, s)) >= 2 AS markdown FROM documents""",
)
def text_structure(spark, d):
    text = F.col("text")
    parts = X.structure(text)
    return _documents(spark, d).select("doc_id", *[parts[c].alias(c) for c in ("n_words", "n_chars", "n_lines", "has_code", "n_links", "n_titles")], X.is_markdown(text).alias("markdown"))


@query(
    "cache_keys",
    "WITH t AS (SELECT doc_id, list_distinct(list_filter(" + _TOKENS + ", lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + """))) AS w FROM documents),
    s AS (SELECT doc_id, unnest(w) AS word FROM t), b AS (SELECT doc_id, word FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, word) <= 8)
    SELECT doc_id, sha256(coalesce(k, '')) AS cache_key FROM documents LEFT JOIN (SELECT doc_id, string_agg(word, '|' ORDER BY word) AS k FROM b GROUP BY doc_id) USING (doc_id)""",
)
def cache_keys(spark, d):
    return _documents(spark, d).select("doc_id", X.cache_key(F.coalesce("text", F.lit(""))).alias("cache_key"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(
    "cache_keys_in_session",
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter({_TOKENS}, lambda x: length(x) > 1 AND x NOT IN ({_STOP})))) AS word FROM documents),
    b AS (SELECT doc_id, word FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, word) <= 8),
    k AS (SELECT doc_id, string_agg(word, '|' ORDER BY word) AS k FROM b GROUP BY doc_id),
    u AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})))) AS word FROM documents),
    c AS (SELECT doc_id, word FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, word) <= 3),
    x AS (SELECT doc_id + 1 AS doc_id, string_agg(word, '|' ORDER BY word) AS ctx FROM c GROUP BY doc_id)
    SELECT doc_id, sha256(coalesce(k, '') || coalesce('|ctx:' || ctx, '')) AS cache_key FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN x USING (doc_id)""",
)
def cache_keys_in_session(spark, d):
    # The document before plays the exchange before.
    docs = _documents(spark, d)
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    return docs.join(before, "doc_id", "left").select("doc_id", X.cache_key(F.coalesce("text", F.lit("")), before=F.col("before")).alias("cache_key"))


_SPACED = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '\\s+'), lambda x: x <> '')"


@query(
    "reranked",
    f"""WITH {_LEXICAL}, best AS ({_best('hit', 3 * K)}),
    w AS (SELECT doc_id, list_distinct({_SPACED.format('text')}) AS asked, {_SPACED.format('text')}[1:100] AS seen FROM documents),
    s AS (SELECT b.query_id, b.doc_id, 0.6 * b.score + 0.4 * len(list_intersect(q.asked, v.seen)) / greatest(len(q.asked), 1) AS reranked FROM best b JOIN w q ON q.doc_id = b.query_id JOIN w v ON v.doc_id = b.doc_id)
    SELECT query_id, doc_id, round(reranked, 6) AS reranked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(reranked, 9) DESC, doc_id) AS INT) AS rank FROM s WHERE reranked > 0.1""",
)
def reranked(spark, d):
    return _reranked(spark, d).withColumn("reranked", F.round("reranked", 6)).drop("text")


def _reranked(spark, d):
    asked = _questions(spark, d).withColumnRenamed("text", "query")
    found = _lexical(spark, d, 3 * K).select("query_id", "doc_id", "score")
    return R.best_reranked(found.join(_documents(spark, d), "doc_id").join(asked, "query_id"), k=None)


@query("reranked_diverse")
def reranked_diverse(spark, d):
    return H.diverse(_reranked(spark, d), 0.7, 5).select("query_id", "doc_id", "rank")


@query("text_chunks")
def text_chunks(spark, d):
    return R.md_chunks(_documents(spark, d)).drop("chunk")


@query(
    "store_upsert",
    f"WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), t AS (SELECT md5(text) AS doc_id, len(list_distinct({_TOKENS})) AS n_terms FROM d) SELECT doc_id, n_terms FROM t WHERE n_terms > 0",
)
def store_upsert(spark, d):
    """Documents of even ids are stored, then all documents are upserted."""
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    docs = _documents(spark, d).join(vectors, "doc_id", "left").select("doc_id", F.col("text").alias("content"), F.col("doc_id").cast("string").alias("metadata"), "embedding")
    folder = f"{shared_dir(spark)}/opsweave-store-{uuid.uuid4().hex}"
    store.build(docs.where("doc_id % 2 = 0"), folder)
    store.upsert(docs, folder)
    return store.load(spark, folder, "postings").groupBy("doc_id").agg(F.count("*").alias("n_terms"))
