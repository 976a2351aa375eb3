"""Queries of the markdown operators: documents as markdown, by sentence."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions import text as X
from opsweave.operators import markdown as M
from opsweave.plans.catalog import ORACLE_SQL, query
from opsweave.sources import tables as T

_MD = f"WITH {T.MARKDOWN_SQL}"
_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
_TERMS = ", ".join(f"({i}, '{t}', '{d}')" for i, (t, d) in enumerate((t, d) for d, levels in M.CONCEPTS.items() for level in levels for t in level))
_CONCEPTS = rf"""terms(i, concept, domain) AS (VALUES {_TERMS}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM md),
    wc AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
    ca AS (SELECT doc_id, i, concept, domain, CAST(n AS INT) AS frequency FROM wc JOIN terms ON word = concept
      UNION ALL SELECT doc_id, i, concept, domain, CAST(len(regexp_extract_all(lower(text), '\b' || concept || '\b')) AS INT) FROM md, terms WHERE contains(concept, '-')),
    con AS (SELECT doc_id, i, concept, domain, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, i) AS nth FROM ca WHERE frequency > 0 QUALIFY nth <= 20)"""


def _times(text: str, *needles: str) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{n}', ''))) // {len(n)}" for n in needles) + ")"


def _extract(kind: str) -> str:
    parts = " || ".join(f"regexp_extract_all(text, '{p}')" for p in M.EXTRACTS[kind])
    return f"least(10, len(list_distinct({parts})))"


_COUNTS = rf"""{_WORDS} AS n_words, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, CAST(floor({_times('text', '```')} / 2) AS INT) AS n_code,
    len(regexp_extract_all(text, '(?m)^\s*(?:[-*+]|\d+\.)\s+')) AS n_lists, {_times('text', '](')} AS n_links, {_times('text', '![')} AS n_images"""


def _docs(spark, d):
    return T.markdown_docs(spark, d)


@query("md_blocks")
def md_blocks(spark, d):
    return M.blocks(_docs(spark, d))


@query("md_chunks")
def md_chunks(spark, d):
    return M.scaled_weights(M.chunks(_docs(spark, d))).drop("content")


@query("md_ingest")
def md_ingest(spark, d):
    plain = T.read_table(spark, d, "documents").where("doc_id % 2 = 1").select("doc_id", "text")
    docs = _docs(spark, d).where("doc_id % 2 = 0").unionByName(plain)
    return M.ingest(docs, X.is_markdown(F.col("text"))).select("doc_id", "chunk_index", "chunk_id", "document_type", F.length("content").alias("n_chars"))


def _level(k: int) -> str:
    over = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
    at = f"last_value(CASE WHEN level = {k} THEN line_no END IGNORE NULLS) {over}"
    reset = f"last_value(CASE WHEN level < {k} THEN line_no END IGNORE NULLS) {over}"
    return f"CASE WHEN level >= {k} AND {at} > coalesce({reset}, -1) THEN last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) {over} END"


@query(
    "title_paths",
    _MD
    + rf""", ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM md),
    tt AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2)) AS title FROM ln WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+)$'))
    SELECT doc_id, line_no, level, array_to_string(list_filter([{', '.join(_level(k) for k in range(1, 7))}], lambda x: x IS NOT NULL), ' > ') AS path FROM tt""",
)
def title_paths(spark, d):
    return M.title_paths(_docs(spark, d)).withColumn("path", F.array_join("path", " > "))


@query("md_counts", _MD + f" SELECT doc_id, {_COUNTS}, CAST(length(regexp_replace(text, '(?m)^# .*$', '', 'g')) AS INT) AS rest FROM md")
def md_counts(spark, d):
    rows = _docs(spark, d)
    return rows.select("doc_id", *[c.alias(n) for n, c in M.counts(F.col("text")).items()], F.length(F.regexp_replace("text", "(?m)^# .*$", "")).alias("rest"))


@query("md_title_map", _MD + r" SELECT doc_id, len(regexp_extract_all(text, '(?m)^# .*\S.*$')) AS n1, len(regexp_extract_all(text, '(?m)^## .*\S.*$')) AS n2 FROM md")
def md_title_map(spark, d):
    titles = M.title_map(F.col("text"))
    many = lambda k: F.coalesce(F.size(F.try_element_at(F.col("titles"), F.lit(k))), F.lit(0))
    return _docs(spark, d).withColumn("titles", titles).select("doc_id", many(1).alias("n1"), many(2).alias("n2"))


@query("technical_concepts", _MD + f", {_CONCEPTS} SELECT doc_id, concept, domain, frequency FROM con")
def technical_concepts(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(M.concepts(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(
    "domain_tags",
    _MD
    + f", {_CONCEPTS}, s AS (SELECT doc_id, domain, sum(frequency) AS f, min(nth) AS place FROM con WHERE nth <= 10 GROUP BY ALL) SELECT doc_id, domain, CAST(f AS BIGINT) AS frequency, least(CAST(f AS DOUBLE) / 5, 1.0) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, place) <= 3",
)
def domain_tags(spark, d):
    tags = M.domain_tags(F.slice(M.concepts(F.col("text")), 1, 10))
    rows = _docs(spark, d).select("doc_id", F.explode(tags).alias("t")).select("doc_id", "t.*")
    return rows.withColumn("frequency", F.col("frequency").cast("long"))


@query("concept_contexts", _MD + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM md) SELECT doc_id, CAST(least(2, count(*) FILTER (contains(lower(line), 'pods'))) AS INT) AS n FROM l GROUP BY doc_id")
def concept_contexts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(M.contexts(F.col("text"), F.lit("pods"))).alias("n"))


@query("text_extracts", _MD + " SELECT doc_id, " + ", ".join(f"{_extract(k)} AS {k}" for k in M.EXTRACTS) + " FROM md")
def text_extracts(spark, d):
    return _docs(spark, d).select("doc_id", *[F.size(M.extracts(F.col("text"), k)).alias(k) for k in M.EXTRACTS])


_HARD = " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in M.ADVANCED_TERMS)


@query(
    "text_quality",
    _MD
    + rf""", {_CONCEPTS}, dep AS (SELECT doc_id, (least(sum(frequency) / 20.0, 1.0) + least(count(*) / 10.0, 1.0)) / 2 AS depth FROM con GROUP BY doc_id),
    c AS (SELECT doc_id, text, {_COUNTS}, {_extract('commands')} AS cmd, {_extract('configs')} AS cfg, regexp_matches(text, '(?m)^#{{1,6}}\s+') AS ti, contains(text, '```yaml') AS la FROM md),
    x AS (SELECT *, 0.6 * ({_HARD}) / greatest(n_words / 100.0, 1.0) + 0.4 * least(n_code / 5.0, 1.0) AS hard FROM c)
    SELECT doc_id, round(CASE WHEN n_chars = 0 THEN 0.0 WHEN n_words = 0 THEN 0.3 ELSE 0.7 * least({_times('text', '```', '- ', '# ')} / greatest(n_lines / 10.0, 1.0), 1.0) + 0.3 * least(n_words / 500.0, 1.0) END, 6) AS readability,
      round(coalesce(depth, 0.0), 6) AS depth,
      round(((CAST(ti AS INT) + CAST(la AS INT) + CAST(cmd > 0 AS INT) + CAST(cfg > 0 AS INT)) / 4.0 + (CAST(n_code > 0 AS INT) + CAST(n_lists > 0 AS INT) + CAST(n_words > 50 AS INT)) / 4.0) / 2, 6) AS completeness,
      CASE WHEN n_words = 0 OR hard < 0.2 THEN 'simple' WHEN hard < 0.5 THEN 'moderate' WHEN hard < 0.8 THEN 'complex' ELSE 'expert' END AS complexity FROM x LEFT JOIN dep USING (doc_id)""",
)
def text_quality(spark, d):
    text = F.col("text")
    c = M.counts(text)
    rows = _docs(spark, d).select("doc_id", "text", *[v.alias(n) for n, v in c.items()], M.concepts(text).alias("found"))
    n = {k: F.col(k) for k in c}
    done = M.completeness(
        F.rlike(text, F.lit(r"(?m)^#{1,6}\s+")), F.contains(text, F.lit("```yaml")), F.size(M.extracts(text, "commands")), F.size(M.extracts(text, "configs")), n["n_code"], F.lit(0), n["n_lists"], n["n_words"]
    )
    return rows.select(
        "doc_id",
        F.round(M.readability(text, n["n_words"], n["n_lines"]), 6).alias("readability"),
        F.round(M.technical_depth(F.col("found")), 6).alias("depth"),
        F.round(done, 6).alias("completeness"),
        M.content_complexity(text, n["n_words"], n["n_code"]).alias("complexity"),
    )


@query(
    "enhanced_weights",
    "WITH tq AS (" + ORACLE_SQL["text_quality"] + """)
    SELECT doc_id, round(greatest(0.5, least(2.0, (0.4 + 0.3 * (doc_id % 7)) * CASE WHEN depth > 0.7 THEN 1.2 WHEN depth > 0.5 THEN 1.1 ELSE 1.0 END
        * CASE complexity WHEN 'moderate' THEN 1.05 WHEN 'complex' THEN 1.1 WHEN 'expert' THEN 1.15 ELSE 1.0 END))::DOUBLE, 6) AS semantic_weight,
      round(greatest(0.5, least(2.0, (0.4 + 0.4 * (doc_id % 5)) * CASE WHEN completeness > 0.8 THEN 1.15 WHEN completeness > 0.6 THEN 1.05 ELSE 1.0 END))::DOUBLE, 6) AS structural_weight FROM tq""",
)
def enhanced_weights(spark, d):
    # The weights before follow from the number, so that both ends of the range are met.
    rows = text_quality(spark, d).withColumns({"semantic_weight": 0.4 + 0.3 * (F.col("doc_id") % 7), "structural_weight": 0.4 + 0.4 * (F.col("doc_id") % 5)})
    out = M.enhanced_weights(rows, F.col("depth"), F.col("completeness"), F.col("complexity"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("semantic_weight", "structural_weight")])


@query(
    "content_patterns",
    _MD
    + f""", c AS (SELECT doc_id, CAST(floor({_times('text', '```')} / 2) AS INT) AS n_code, {_extract('configs')} AS cfg, {_times('lower(text)', *M.TROUBLE)} AS t2, {_times('lower(text)', *M.TROUBLE_FULL)} AS t4, {_times('text', '1. ', '2. ', '3. ')} AS st FROM md),
    p AS (SELECT doc_id, false AS whole, 'code_intensive' AS pattern, n_code / 8.0 AS v, n_code > 2 AS ok FROM c UNION ALL SELECT doc_id, false, 'troubleshooting', t2 / 8.0, t2 > 2 FROM c
      UNION ALL SELECT doc_id, true, 'code_intensive', n_code / 10.0, n_code > 3 FROM c UNION ALL SELECT doc_id, true, 'troubleshooting', t4 / 10.0, t4 > 3 FROM c
      UNION ALL SELECT doc_id, true, 'step_oriented', st / 15.0, st > 5 FROM c UNION ALL SELECT doc_id, true, 'configuration_guide', (cfg + n_code) / 8.0, cfg > 2 OR n_code > 1 FROM c)
    SELECT doc_id, whole, pattern, round(CAST(least(v, 1.0) AS DOUBLE), 6) AS confidence FROM p WHERE ok""",
)
def content_patterns(spark, d):
    text = F.col("text")
    rows = _docs(spark, d).select("doc_id", "text", M.counts(text)["n_code"].alias("n_code"), F.size(M.extracts(text, "configs")).alias("cfg"))
    out = None
    for full in (False, True):
        part = rows.select("doc_id", F.lit(full).alias("whole"), F.explode(M.content_patterns(text, F.col("n_code"), F.col("cfg"), full)).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "whole", "p.pattern", F.round("p.confidence", 6).alias("confidence"))


@query(
    "document_complexity",
    _MD
    + r""", c AS (SELECT doc_id, length(text) AS n, CAST(regexp_matches(text, '(?m)^#{1,6}\s+') AS INT) + CAST(contains(text, '```') AS INT) + CAST(regexp_matches(text, '(?m)^\s*(?:[-*+]|\d+\.)\s+') AS INT) AS k FROM md)
    SELECT doc_id, CASE WHEN n < 1000 THEN 'simple' WHEN n > 5000 OR k >= 2 THEN 'complex' WHEN n > 2000 OR k >= 1 THEN 'moderate' ELSE 'simple' END AS class FROM c""",
)
def document_complexity(spark, d):
    return _docs(spark, d).select("doc_id", M.document_complexity(F.col("text")).alias("class"))


@query(
    "document_match",
    _MD
    + f""", {_CONCEPTS}, dom AS (SELECT doc_id, list_distinct(list(domain)) AS ds FROM con GROUP BY doc_id), tr AS (SELECT doc_id, {_times('lower(text)', *M.TROUBLE)} > 2 AS t FROM md)
    SELECT doc_id, round(least(2.0, 1.0 + CASE WHEN t THEN 0.3 ELSE 0 END + coalesce(0.3 * len(list_intersect(ds, ['kubernetes', 'docker'])) / greatest(2, len(ds)), 0)), 6) AS score FROM tr LEFT JOIN dom USING (doc_id)""",
)
def document_match(spark, d):
    text = F.col("text")
    patterns = F.transform(M.content_patterns(text, F.lit(0), F.lit(0)), lambda p: p["pattern"])
    domains = F.array_distinct(F.transform(M.concepts(text), lambda c: c["domain"]))
    asked = F.array(F.lit("kubernetes"), F.lit("docker"))
    score = M.document_match(F.lit("troubleshoot_query"), patterns, asked, domains, F.lit("simple"), F.lit(0.0), F.lit(0.0))
    return _docs(spark, d).select("doc_id", F.round(score, 6).alias("score"))


@query("markdown_majority", _MD + ", f AS (SELECT (SELECT count(*) FROM (SELECT unnest(['# ', '## ', '### ', '```', '- ', '* ', '1. ', '[', '](', '**', '|']) AS s) WHERE contains(text, s)) >= 2 AS m FROM md) SELECT avg(CAST(m AS INT)) > 0.5 AS majority FROM f")
def markdown_majority(spark, d):
    return _docs(spark, d).agg((F.avg(X.is_markdown(F.col("text")).cast("int")) > 0.5).alias("majority"))


@query(
    "tidy_markdown",
    _MD + r" SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^(#{1,6})[ \t]*([^#\s])', '\1 \2', 'g'))) AS tidy FROM md",
)
def tidy_markdown(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.tidy_markdown(F.col("text"))).alias("tidy"))


@query("quick_structure", _MD + r" SELECT doc_id, contains(text, '```') AS has_code, regexp_matches(text, '\|[^\n]*\|') AS has_table, regexp_matches(text, '(?m)^\s*(?:[-*+]|\d+\.)\s') AS has_list, len(regexp_extract_all(text, '(?m)^#{1,6}\s')) AS n_titles, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '```(\w+)', 1))), ',') AS languages FROM md")
def quick_structure(spark, d):
    s = X.quick_structure(F.col("text"))
    return _docs(spark, d).select("doc_id", *[c.alias(n) for n, c in s.items()]).withColumn("languages", F.array_join("languages", ","))
