"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from opsweave.llm import bpe, conversation_trie, exact_dedup, fertility, jaccard, licenses, line_quality, merkle, packing, sharding, substring_dedup, wrapper, zstd_language
from opsweave.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: crc32 of a decimal number in SQL, beside ``crc_table``, a list made by its rule; ``{}`` is the number.
CRC_TABLE = """
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
      SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
      FROM (SELECT unnest(range(256)) AS i)))"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


@query(
    "op1_exact_dedup",
    """
    WITH h AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM h WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


@query("op3_bpe")
def op3_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.digest_removals(table(spark, sf_dir, "documents"))


@query("op4_jaccard_join")
def op4_jaccard_join(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@query("op10_line_crf")
def op10_line_crf(spark, sf_dir):
    return line_quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_fertility_rules")
def op9_fertility_rules(spark, sf_dir):
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_wrapper_induction")
def op7_wrapper_induction(spark, sf_dir):
    return wrapper.extract(table(spark, sf_dir, "pages"))


def _field(name: str, value: str = "") -> str:
    value = value or f"{name}::VARCHAR"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


_SHA = "sha256({} || {} || {} || {} || {})"
_LEAF = _SHA.format(*map(_field, ("doc_id", "source", "lang", "n_chars", "text")))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHANGED = _SHA.format(*map(_field, ("doc_id", "source", "lang", "n_chars")), _field("text", _LOWERED))


@query(
    "op11_merkle_manifest",
    # Levels 0 to 19 are the languages', 20 to 39 those from subroots to the root.
    f"""
    WITH RECURSIVE {CRC_TABLE},
    rows AS (
      SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF} AS leaf,
             CASE WHEN doc_id IS NOT NULL AND ({CRC.format("doc_id")}) % 3 = 0 THEN {_CHANGED} END AS changed
      FROM documents, crc_table),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows),
    climb(level, tree, pos, hash, n) AS (
      SELECT 0, tree, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
      UNION ALL
      SELECT level + 1, tree, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), max((n + 7) // 8) FROM climb WHERE n > 1 GROUP BY level, tree, pos // 8),
    subroots AS (SELECT tree, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM climb WHERE n = 1),
    upper(level, pos, hash, n) AS (
      SELECT 20, place, hash, (SELECT count(*) FROM subroots) FROM subroots
      UNION ALL
      SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), max((n + 7) // 8) FROM upper WHERE n > 1 GROUP BY level, pos // 8),
    nodes AS (SELECT level, tree, pos, hash, n FROM climb WHERE n > 1 UNION ALL SELECT level, NULL, pos, hash, n FROM upper WHERE n > 1),
    steps AS (
      SELECT x.level, x.tree, x.pos, coalesce(string_agg(y.hash, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
             coalesce(string_agg(y.hash, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
      FROM nodes x JOIN nodes y ON x.level = y.level AND x.tree IS NOT DISTINCT FROM y.tree AND x.pos // 8 = y.pos // 8 GROUP BY ALL),
    paths AS (
      SELECT v.tree, v.pos, list(s.l || ',' || s.r ORDER BY s.level) AS path
      FROM (SELECT v.*, u.place FROM leaves v JOIN subroots u USING (tree)) v
      LEFT JOIN steps s ON (s.level < 20 AND s.tree = v.tree AND s.pos = v.pos // (8::BIGINT ** s.level)::BIGINT)
                        OR (s.level >= 20 AND s.pos = v.place // (8::BIGINT ** (s.level - 20))::BIGINT)
      GROUP BY ALL),
    folded AS (
      SELECT v.doc_id, v.leaf, u.hash AS subroot, (SELECT hash FROM upper WHERE n = 1) AS root,
             sha256(replace(array_to_string(p.path, ''), ',', '')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(changed, leaf), coalesce(list_filter(path, lambda x: x IS NOT NULL), [])),
                         lambda h, s: sha256(split_part(s, ',', 1) || h || split_part(s, ',', 2))) AS folded_root
      FROM leaves v JOIN subroots u USING (tree) JOIN paths p ON p.tree = v.tree AND p.pos = v.pos)
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op12_zstd_language")
def op12_zstd_language(spark, sf_dir):
    return zstd_language.identify(table(spark, sf_dir, "documents"))


@query(
    "op13_conversation_trie",
    f"""
    WITH {CRC_TABLE},
    turns AS (
      SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({{'digest': digest, 'words': words}} ORDER BY turn NULLS FIRST, digest) AS t FROM turns GROUP BY 1),
    heads AS (SELECT conv_id, own.t, ({CRC.format("conv_id")}) % 4 AS h FROM own, crc_table),
    rebuilt AS (
      SELECT c.conv_id, list_concat(coalesce(d.t[1:c.h], []), c.t[c.h + 1:]) AS t
      FROM heads c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 20),
    prefixes AS (
      SELECT conv_id, d AS depth, md5(array_to_string(list_transform(t[1:d], lambda x: x.digest), ',')) AS key,
             CASE WHEN d > 0 THEN md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.digest), ',')) END AS up,
             CASE WHEN d > 0 THEN t[d].words ELSE 0 END AS words, d = len(t) AS ends
      FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
    nodes AS (
      SELECT key, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM prefixes GROUP BY 1, 2),
    children AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY 1),
    whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (key)),
    sums AS (
      SELECT p.key, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
      FROM whole n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
           s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM whole n JOIN sums s USING (key) LEFT JOIN nodes u ON u.key = n.up
    """,
)
def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))
