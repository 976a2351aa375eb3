"""Queries of staged retrieval and of query analysis.

Clusters are the labels of the vectors; a vector's text is that of the document of its number.  Questions
are conversation turns behind a beginning by their number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import hierarchy as H, postings, retrieval as R
from opsweave.plans.catalog import query
from opsweave.sources import tables as T

BEGINNINGS = ("what is kubernetes ", "how to deploy the service ", "configure prometheus alert ", "troubleshoot network error ", "count the pods ", "why does docker image fail ", "show code for ", "guide for storage volume ")
_ASKED = f"asked AS (SELECT conv_id, turn, {list(BEGINNINGS)}[(conv_id + turn) % {len(BEGINNINGS)} + 1] || text AS q FROM conversations)"


def _asked(spark, d):
    start = F.element_at(F.array(*map(F.lit, BEGINNINGS)), ((F.col("conv_id") + F.col("turn")) % len(BEGINNINGS) + 1).cast("int"))
    return T.read_table(spark, d, "conversations").select("conv_id", "turn", F.concat(start, "text").alias("q"))


def _has(words: str) -> str:
    return rf"regexp_matches(lower(q), '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


_CLASS = "CASE " + " ".join(f"WHEN {_has('|'.join(p))} THEN '{n}'" for n, p in H.COMPLEXITY) + " ELSE 'simple' END"
_DOMAINS = "list_filter([" + ", ".join(f"CASE WHEN {_has(w)} THEN '{n}' END" for n, w in H.DOMAINS) + "], lambda x: x IS NOT NULL)"
_KINDS = " || ".join(f"CASE WHEN {_has(w)} THEN {list(n)} ELSE [] END" for w, n in H.PREFERRED)


@query(
    "query_routing",
    f"WITH {_ASKED}, r AS (SELECT conv_id, turn, {_CLASS} AS complexity, array_to_string({_DOMAINS}, ',') AS domains, array_to_string({_KINDS}, ',') AS preferred FROM asked) SELECT *, CASE complexity WHEN 'simple' THEN 500 WHEN 'moderate' THEN 800 ELSE 1200 END AS budget FROM r",
)
def query_routing(spark, d):
    r = H.route(F.col("q"))
    return _asked(spark, d).select("conv_id", "turn", r["complexity"].alias("complexity"), F.array_join(r["domains"], ",").alias("domains"), F.array_join(r["preferred"], ",").alias("preferred"), r["budget"].alias("budget"))


def _score(words) -> str:
    return "(" + " + ".join(["0.0::DOUBLE", *(f"CAST(contains(lower(q), '{w}') AS INT) / {len(words)}::DOUBLE" for w in words)]) + ")"


_INTENT = f"""{_ASKED}, raw AS (SELECT *, [{', '.join(f'least({_score(w)}, 1.0)' for w, _ in H.INTENTS.values())}] AS s FROM asked),
    nrm AS (SELECT conv_id, turn, q, CASE WHEN list_sum(s) > 0 THEN list_transform(s, lambda x: x / list_sum(s)) ELSE [0.0, 0.0, 0.0, 0.0, 1.0] END AS s FROM raw),
    top AS (SELECT conv_id, turn, q, list_position(s, list_max(s)) AS pos, list_max(s) AS conf FROM nrm),
    best AS (SELECT conv_id, turn, q, ({list(H.INTENTS)})[pos] AS intent, conf, ({[w for _, w in H.INTENTS.values()]})[pos] AS base FROM top)"""


@query("intent_scores", f"WITH {_INTENT} SELECT conv_id, turn, intent, round(conf, 6) AS confidence, round(base::DOUBLE * (1.0 + (conf - 0.5) * 0.4), 6) AS weight FROM best")
def intent_scores(spark, d):
    rows = _asked(spark, d).select("conv_id", "turn", H.best_intent(H.intents(F.col("q"))).alias("b"))
    return rows.select("conv_id", "turn", F.col("b.intent").alias("intent"), F.round("b.score", 6).alias("confidence"), F.round(H.intent_weight(F.col("b.intent"), F.col("b.score")), 6).alias("weight"))


_FORMS = "CASE intent " + " ".join(f"WHEN '{n}' THEN [" + ", ".join(f"replace('{t}', '{{}}', q)" for t in ts) + "]" for n, ts in H.EXPANSIONS.items()) + " ELSE [] END"


@query("query_expansion", f"WITH {_INTENT} SELECT conv_id, turn, array_to_string(([q] || {_FORMS})[1:5], '|') AS forms FROM best")
def query_expansion(spark, d):
    rows = _asked(spark, d).withColumn("intent", H.best_intent(H.intents(F.col("q")))["intent"])
    return rows.select("conv_id", "turn", F.array_join(H.expansions(F.col("q"), F.col("intent")), "|").alias("forms"))


@query("template_class", f"WITH {_ASKED} SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(q), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in H.TEMPLATES) + " ELSE 'default' END AS class FROM asked")
def template_class(spark, d):
    return _asked(spark, d).select("conv_id", "turn", H.template_class(F.col("q")).alias("class"))


@query("pseudo_embedding")
def pseudo_embedding(spark, d):
    return T.read_table(spark, d, "documents").select("doc_id", H.pseudo_embedding(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_VD = f"WITH {T.VECTOR_DOCUMENTS_SQL}"
_COS = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE list_cosine_similarity({a}, {b}) END"
_TECH = " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in H.TECH_TERMS)
_QUALITY = rf"""qual AS (SELECT doc_id, cluster, e, text, length(text) AS n, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w, list_avg(e) AS m FROM vd WHERE text IS NOT NULL),
    qd AS (SELECT doc_id, cluster, e, text, 0.15 * CASE WHEN n < 50 THEN 0.2 WHEN n < 200 THEN 0.6 WHEN n < 800 THEN 1.0 WHEN n < 2000 THEN 0.8 ELSE 0.6 END
      + 0.25 * (0.2 * CAST(contains(text, '```') AS INT) + 0.1 * CAST(n - length(replace(text, chr(10), '')) > 3 AS INT) + 0.2 * CAST(contains(text, '#') OR contains(text, '*') OR contains(text, '-') OR contains(text, '1.') AS INT))
      + 0.15 * CASE WHEN n = 0 THEN 0.0 WHEN len(w) < 3 THEN 0.3 ELSE least(1.0, 0.7 * len(list_distinct(w)) / len(w) + 0.3 * ({_TECH}) / {len(H.TECH_TERMS)}.0) END
      + 0.25 * least(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e) / 0.1, 1.0) AS quality FROM qual)"""


def _members(spark, d):
    rows = T.vector_documents(spark, d).where("text is not null")
    return rows.withColumn("quality", H.quality_score(F.col("text"), F.col("embedding")))


def _queries(spark, d):
    return T.vector_documents(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@query("quality_score", f"{_VD}, {_QUALITY} SELECT doc_id, round(CAST(quality AS DOUBLE), 6) AS quality FROM qd")
def quality_score(spark, d):
    return _members(spark, d).select("doc_id", F.round("quality", 6).alias("quality"))


_CLUSTERS = """comp AS (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM qd) GROUP BY ALL),
    cen AS (SELECT cluster, list(x ORDER BY pos) AS c FROM comp GROUP BY cluster), sz AS (SELECT cluster, avg(quality) AS q, count(*) AS n FROM qd GROUP BY cluster),
    cl AS (SELECT * FROM cen JOIN sz USING (cluster) WHERE n >= (SELECT CASE WHEN count(*) >= 5 THEN 3 ELSE 1 END FROM sz)),
    qs AS (SELECT doc_id AS query_id, e AS qe FROM vd WHERE doc_id % 50 = 0),
    tc AS (SELECT query_id, cluster, 0.7 * list_cosine_similarity(qe, c) + 0.3 * q AS score FROM qs, cl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cluster) <= 3)"""


@query("cluster_topk", f"{_VD}, {_QUALITY}, {_CLUSTERS} SELECT query_id, cluster, round(CAST(score AS DOUBLE), 6) AS score FROM tc")
def cluster_topk(spark, d):
    return H.top_clusters(_queries(spark, d), H.cluster_table(_members(spark, d)), 3).select("query_id", "cluster", F.round("score", 6).alias("score"))


_COARSE = """co AS (SELECT query_id, doc_id, list_cosine_similarity(qe, e) AS score FROM tc JOIN qs USING (query_id) JOIN qd USING (cluster)
    QUALIFY row_number() OVER (PARTITION BY query_id, tc.cluster ORDER BY round(list_cosine_similarity(qe, e), 9) DESC, doc_id) <= 5)"""


@query("coarse_retrieval", f"{_VD}, {_QUALITY}, {_CLUSTERS}, {_COARSE} SELECT query_id, doc_id, round(score, 6) AS score FROM co")
def coarse_retrieval(spark, d):
    members = _members(spark, d)
    chosen = H.top_clusters(_queries(spark, d), H.cluster_table(members), 3)
    return H.coarse(_queries(spark, d), chosen, members).withColumn("score", F.round("score", 6))


_FINE = """vs AS (SELECT query_id, doc_id, list_cosine_similarity(qe, e) AS score FROM qs, vd WHERE list_cosine_similarity(qe, e) > 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20),
    fi AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, 0.6::DOUBLE * score AS s FROM co UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE * score FROM vs) GROUP BY ALL),
    fb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fi QUALIFY rank <= 10)"""


def _fine(spark, d, members):
    asked = _queries(spark, d)
    found = H.coarse(asked, H.top_clusters(asked, H.cluster_table(members), 3), members)
    return H.fine(found, R.vector_search(T.vector_documents(spark, d), asked, 20), 10)


@query("fine_retrieval", f"{_VD}, {_QUALITY}, {_CLUSTERS}, {_COARSE}, {_FINE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fb")
def fine_retrieval(spark, d):
    return _fine(spark, d, _members(spark, d)).withColumn("score", F.round("score", 6))


_RERANKED = """rr AS (SELECT query_id, doc_id, text, 0.35 * fb.score + 0.25 * quality + 0.15 * 0.5 + 0.15 * CASE WHEN contains(lower(text), 'network') THEN 0.3 ELSE 0.0 END + 0.10 * 0.5 AS score FROM fb JOIN qd USING (doc_id))"""


def _reranked(spark, d):
    members = _members(spark, d)
    rows = _fine(spark, d, members).join(members.select("doc_id", "text", "quality"), "doc_id")
    none, empty = F.array().cast("array<string>"), F.lit(None).cast("array<struct<pattern:string,confidence:double>>")
    hints, found = F.array(F.lit("network")), F.array().cast("array<struct<concept:string,domain:string,frequency:int>>")
    by_type = H.type_match(none, none, F.coalesce(empty, F.array().cast("array<struct<pattern:string,confidence:double>>")))
    by_domain = H.domain_match(hints, F.col("text"), F.lit("none"), found)
    by_structure = H.structure_match(F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.lit(0))
    return rows.select("query_id", "doc_id", "text", H.final_score(F.col("score"), F.col("quality"), by_type, by_domain, by_structure).alias("score"))


@query("hierarchical_rerank", f"{_VD}, {_QUALITY}, {_CLUSTERS}, {_COARSE}, {_FINE}, {_RERANKED} SELECT query_id, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM rr")
def hierarchical_rerank(spark, d):
    return _reranked(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_FIRST50 = r"list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1:50])"


def _walk(source: str, alike: float, k: int) -> str:
    return f"""fold(query_id, nth, ids, ws) AS (SELECT DISTINCT query_id, 0::BIGINT, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[][]) FROM {source}
      UNION ALL SELECT j.query_id, j.nth, CASE WHEN j.ok THEN list_append(j.ids, j.doc_id) ELSE j.ids END, CASE WHEN j.ok THEN list_append(j.ws, j.w) ELSE j.ws END FROM (
        SELECT f.query_id, s.nth, f.ids, f.ws, s.doc_id, s.w,
          len(f.ids) < {k} AND len(list_filter(f.ws, lambda x: len(x) > 0 AND len(s.w) > 0 AND len(list_intersect(x, s.w)) / CAST(len(list_distinct(x || s.w)) AS DOUBLE) > {alike})) = 0 AS ok
        FROM fold f JOIN {source} s ON s.query_id = f.query_id AND s.nth = f.nth + 1) j),
      last AS (SELECT query_id, unnest(arg_max(ids, nth)) AS doc_id FROM fold GROUP BY query_id)"""


@query(
    "hierarchical_search",
    f"{_VD.replace('WITH', 'WITH RECURSIVE')}, {_QUALITY}, {_CLUSTERS}, {_COARSE}, {_FINE}, {_RERANKED},"
    + f""" rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rr),
    kept AS (SELECT * FROM rk WHERE score >= 0.3 AND length(trim(text)) >= 20 QUALIFY row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) = 1),
    src AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, {_FIRST50} AS w FROM kept), {_walk('src', 0.8, 5)}
    SELECT query_id, doc_id FROM last""",
)
def hierarchical_search(spark, d):
    ranked = R.top_k(_reranked(spark, d), 10)
    return H.final_filter(ranked, F.lit(0.3), 5).select("query_id", "doc_id")


_QWORDS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(form), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> ''))"
_DWORDS = _QWORDS.replace("form", "text")


@query(
    "multi_query_retrieve",
    f"""WITH RECURSIVE {_INTENT}, forms AS (SELECT conv_id * 100 + turn AS query_id, unnest(([q] || {_FORMS})[1:5]) AS form, generate_subscripts(([q] || {_FORMS})[1:5], 1) AS i FROM best WHERE conv_id % 50 = 0),
    ft AS (SELECT query_id, i, {_QWORDS} AS t FROM forms), qt AS (SELECT query_id, i, len(t) AS n, unnest(t) AS term FROM ft), idx AS (SELECT doc_id, unnest({_DWORDS}) AS term FROM documents),
    hit AS (SELECT query_id, i, doc_id, count(*) / max(n)::DOUBLE AS score FROM qt JOIN idx USING (term) GROUP BY query_id, i, doc_id),
    h10 AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, i ORDER BY round(score, 9) DESC, doc_id) <= 10),
    bd AS (SELECT query_id, doc_id, max(score) AS score FROM h10 GROUP BY ALL), tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bd QUALIFY rank <= 20),
    un AS (SELECT query_id, doc_id, rank, text FROM tp JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) = 1),
    src AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, {_FIRST50} AS w FROM un), {_walk('src', 0.6, 5)} SELECT query_id, doc_id FROM last""",
)
def multi_query_retrieve(spark, d):
    """Every way to ask a question is searched; the best of all, each text once, unlike each other."""
    docs = T.read_table(spark, d, "documents").select("doc_id", "text")
    asked = _asked(spark, d).where("conv_id % 50 = 0").withColumn("intent", H.best_intent(H.intents(F.col("q")))["intent"])
    forms = asked.select((F.col("conv_id") * 100 + F.col("turn")).alias("asked"), F.posexplode(H.expansions(F.col("q"), F.col("intent"))).alias("i", "text"))
    forms = forms.select((F.col("asked") * 8 + F.col("i")).alias("query_id"), "text")  # five forms at most
    found = postings.lexical_search(postings.posting_blocks(docs), forms, 10)
    found = found.groupBy(F.floor(F.col("query_id") / 8).alias("query_id"), "doc_id").agg(F.max("score").alias("score"))
    best = R.top_k(found, 20).join(docs, "doc_id")
    return H.diverse(H.distinct_content(best), 0.6, 5).select("query_id", "doc_id")


@query("distinct_content", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) = 1")
def distinct_content(spark, d):
    docs = T.read_table(spark, d, "documents").select("lang", "doc_id", F.col("doc_id").alias("rank"), "text")
    return H.distinct_content(docs, key="lang").select("lang", "doc_id")


@query("first_words_jaccard", f"WITH w AS (SELECT doc_id, {_FIRST50} AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w || b.w)) AS DOUBLE) ELSE 0.0 END, 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def first_words_jaccard(spark, d):
    rows = T.read_table(spark, d, "documents").select("doc_id", H.first_words(F.col("text")).alias("w"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return rows.join(after, "doc_id").select("doc_id", F.round(H.word_jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query(
    "dynamic_thresholds",
    f"WITH {_ASKED}, n AS (SELECT count(*) AS n FROM documents), c AS (SELECT conv_id, turn, {_CLASS} AS class FROM asked) SELECT conv_id, turn, round(CAST(CASE WHEN n > 1000 THEN 0.4 WHEN n > 500 THEN 0.35 ELSE 0.3 END AS DOUBLE), 6) AS base, round(CAST(CASE WHEN n > 1000 THEN 0.5 WHEN n > 500 THEN 0.45 ELSE 0.4 END * CASE class WHEN 'simple' THEN 1.1 WHEN 'complex' THEN 0.9 ELSE 1.0 END AS DOUBLE), 6) AS final FROM c, n",
)
def dynamic_thresholds(spark, d):
    n = F.lit(T.read_table(spark, d, "documents").count())
    t = H.thresholds(n, H.route(F.col("q"))["complexity"])
    return _asked(spark, d).select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in t.items()])


@query("leader_clusters")
def leader_clusters(spark, d):
    return H.leader_clusters(T.vector_documents(spark, d))
