"""Markdown documents: blocks, title paths, chunks with weights, and what a text says about itself.

Blocks and chunks need a line-by-line reading of one document, which is a small helper inside
``mapInArrow``; everything about whole texts is column functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_CHUNK = 800
TITLE = re.compile(r"(#{1,6})\s+(.+)$")
ITEM = re.compile(r"(\s*)([-*+]|\d+\.)\s+(.+)$")
RULE = re.compile(r"[|\-\s:]+$")
LANGUAGE = re.compile(r"```(\w+)?")

# What kinds of blocks, levels of titles and languages of code weigh.
KIND_WEIGHTS = {"title": 1.4, "code_block": 1.2, "list": 1.1, "table": 1.3, "quote": 1.0, "paragraph": 1.0}
TITLE_WEIGHTS = {1: 1.5, 2: 1.3, 3: 1.2, 4: 1.1, 5: 1.05, 6: 1.0}
IMPORTANT_LANGUAGES = frozenset(("python", "yaml", "bash", "sql", "dockerfile"))


@dataclass
class Block:
    kind: str
    content: str
    start: int
    level: int = 0
    language: str | None = None


def _opens(lines: list[str], at: int) -> str:
    """The kind of block that a line which is not blank begins."""
    line = lines[at].strip()
    if TITLE.match(lines[at]):
        return "title"
    if line.startswith("```"):
        return "code_block"
    if ITEM.match(lines[at]):
        return "list"
    if line.startswith(">"):
        return "quote"
    if "|" in line and at + 1 < len(lines) and "|" in lines[at + 1] and RULE.match(lines[at + 1].strip()):
        return "table"
    return "paragraph"


def _breaks_paragraph(lines: list[str], at: int) -> bool:
    line = lines[at].strip()
    return not line or line[0] in "#>" or line.startswith("```") or bool(ITEM.match(lines[at])) or "|" in line and at + 1 < len(lines) and "|" in lines[at + 1]


def blocks_of(text: str) -> list[Block]:
    """The blocks of a document.  The opening line of a fence that never closes is dropped, and so is a
    line that neither opens a block nor may stand in a paragraph."""
    lines, found, at = text.split("\n"), [], 0
    # The next line that closes a fence, for every line, so that open fences cost no second look.
    closing, following = [-1] * (len(lines) + 1), -1
    for i in range(len(lines) - 1, -1, -1):
        following = i if lines[i].strip() == "```" else following
        closing[i] = following
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind, first = _opens(lines, at), at
        if kind == "title":
            signs, title = TITLE.match(lines[at]).groups()
            found.append(Block(kind, title.strip(), first, len(signs)))
            at += 1
        elif kind == "code_block":
            end = closing[at + 1]
            if end < 0:
                at += 1
                continue
            language = LANGUAGE.match(lines[at])
            found.append(Block(kind, "\n".join(lines[at + 1 : end]), first, 0, language and language[1]))
            at = end + 1
        else:
            held = []
            indent = len(lines[at]) - len(lines[at].lstrip())
            while at < len(lines):
                line = lines[at].strip()
                if kind == "paragraph":
                    if _breaks_paragraph(lines, at):
                        break
                    held.append(line)
                elif not line:
                    pass
                elif kind == "list" and (ITEM.match(lines[at]) or len(lines[at]) - len(lines[at].lstrip()) > indent):
                    held.append(lines[at])
                elif kind == "quote" and line.startswith(">"):
                    held.append(line[1:].strip())
                elif kind == "table" and "|" in line:
                    held.append(line)
                else:
                    break
                at += 1
            at = max(at, first + 1)
            if held:
                found.append(Block(kind, (" " if kind == "paragraph" else "\n").join(held), first))
    return found


def title_path(path: list[tuple[int, str]], block: Block) -> list[tuple[int, str]]:
    """The (level, title) stack after a title."""
    return [p for p in path if p[0] < block.level] + [(block.level, block.content)]


def _split_at(held: list[Block]) -> int:
    """Where a full chunk is cut: after the last paragraph, else list or quote, else code, else midway."""
    for kinds in (("paragraph",), ("list", "quote"), ("code_block",)):
        for i in range(len(held) - 1, -1, -1):
            if held[i].kind in kinds:
                return i + 1
    return len(held) // 2


def _shown(block: Block) -> str:
    if block.kind == "title":
        return "#" * block.level + " " + block.content
    return f"```{block.language or ''}\n{block.content}\n```" if block.kind == "code_block" else block.content


def _semantic(held: list[Block]) -> float:
    total = 0.0
    for b in held:
        weight = KIND_WEIGHTS[b.kind]
        if b.kind == "title":
            weight *= TITLE_WEIGHTS[b.level]
        elif (b.language or "").lower() in IMPORTANT_LANGUAGES:
            weight *= 1.2
        total += weight * len(b.content)
    return total / max(1, sum(len(b.content) for b in held))


def _structural(held: list[Block], path: list[str]) -> float:
    depth = max(0.8, 1.2 - 0.1 * len(path)) if path else 1.0
    special = 1.0 + sum({"table": 0.1, "code_block": 0.05}.get(b.kind, 0.0) for b in held)
    return depth * (1.0 + 0.05 * len({b.kind for b in held})) * special


def chunks_of(text: str, most: int = MAX_CHUNK) -> list[dict]:
    """Chunks of about ``most`` characters: a title begins a new one once the current is more than half
    full; a full one is cut at a good place, whose last block also opens the next."""
    out: list[tuple[list[Block], list[str]]] = []
    held: list[Block] = []
    size = 0
    path: list[tuple[int, str]] = []
    for block in blocks_of(text):
        if block.kind == "title":
            if held and size > most // 2:
                out.append((held, [t for _, t in path]))
                held, size = [], 0
            path = title_path(path, block)
        if held and size + len(block.content) > most and (cut := _split_at(held)):
            out.append((held[:cut], [t for _, t in path]))
            held = held[cut - 1 :]
            size = sum(len(b.content) for b in held)
        held.append(block)
        size += len(block.content)
    if held:
        out.append((held, [t for _, t in path]))
    rows = []
    for i, (blocks, titles) in enumerate(out):
        content = "\n\n".join([f"[上下文: {' > '.join(titles)}]"] * bool(titles) + [_shown(b) for b in blocks])
        rows.append(
            {
                "chunk_index": i,
                "total_chunks": len(out),
                "relative_position": i / max(1, len(out) - 1),
                "chunk_id": hashlib.md5(content.encode()).hexdigest(),
                "content": content,
                "title_path": titles,
                "element_types": [b.kind for b in blocks],
                "languages": sorted({b.language for b in blocks if b.language}),
                "semantic_weight": _semantic(blocks),
                "structural_weight": _structural(blocks, titles),
            }
        )
    return rows


_BLOCKS = "doc_id long, block_no int, kind string, level int, language string, start_line int, content string"
_CHUNKS = (
    "doc_id long, chunk_index int, total_chunks int, relative_position double, chunk_id string, content string, title_path array<string>, element_types array<string>,"
    " languages array<string>, semantic_weight double, structural_weight double"
)


def _per_document(docs: DataFrame, id_col: str, text: str, schema: str, rows_of) -> DataFrame:
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[k]) for c, k in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := [{"doc_id": doc} | r for r in rows_of(body)]:
                    yield pa.RecordBatch.from_pylist(found, kinds)

    return rows.mapInArrow(run, schema)


def blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a block: (doc_id, block_no, kind, level, language, start_line, content)."""
    return _per_document(
        docs, id_col, text, _BLOCKS, lambda body: [{"block_no": i, "kind": b.kind, "level": b.level, "language": b.language, "start_line": b.start, "content": b.content} for i, b in enumerate(blocks_of(body))]
    )


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_CHUNK) -> DataFrame:
    """One row a chunk, with its raw weights."""
    return _per_document(docs, id_col, text, _CHUNKS, lambda body: chunks_of(body, most))


def scaled_weights(chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Weights brought to [0.5, 1] within each document; where all are equal they stay as they are."""
    every = Window.partitionBy(key)
    out = {}
    for c in ("semantic_weight", "structural_weight"):
        low, high = F.min(c).over(every), F.max(c).over(every)
        out[c] = F.when(high > low, 0.5 + 0.5 * (F.col(c) - low) / (high - low)).otherwise(F.col(c))
    return chunked.withColumns(out)


def enhanced_weights(chunked: DataFrame, depth: Column, completeness: Column, complexity: Column) -> DataFrame:
    """Weights raised by technical depth, completeness and complexity, within [0.5, 2]."""
    by_depth = F.when(depth > 0.7, 1.2).when(depth > 0.5, 1.1).otherwise(1.0)
    by_class = F.when(complexity == "moderate", 1.05).when(complexity == "complex", 1.1).when(complexity == "expert", 1.15).otherwise(1.0)
    by_parts = F.when(completeness > 0.8, 1.15).when(completeness > 0.6, 1.05).otherwise(1.0)

    def held(value: Column) -> Column:
        return F.greatest(F.lit(0.5), F.least(F.lit(2.0), value))

    return chunked.withColumns({"semantic_weight": held(F.col("semantic_weight") * by_depth * by_class), "structural_weight": held(F.col("structural_weight") * by_parts)})


def ingest(docs: DataFrame, markdown: Column, id_col: str = "doc_id", text: str = "text", most: int = MAX_CHUNK) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, content, document_type): markdown by chunks, other texts whole."""
    flagged = docs.where(F.col(text).isNotNull()).withColumn("_markdown", markdown)
    parts = chunks(flagged.where("_markdown"), id_col, text, most).select("doc_id", "chunk_index", "chunk_id", "content", F.lit("markdown").alias("document_type"))
    whole = flagged.where("not _markdown").select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("chunk_index"), F.md5(F.col(text)).alias("chunk_id"), F.col(text).alias("content"), F.lit("text").alias("document_type"))
    return parts.unionByName(whole)


def title_paths(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, level, path): title lines with the titles above them, by windows over the lines.

    A level's latest title counts only if no title of a smaller level stands between.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    signs = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    titles = lines.withColumn("level", F.length(signs)).where("level > 0").withColumn("title", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)

    def latest(of: Column, value: Column) -> Column:
        return F.last(F.when(of, value), ignorenulls=True).over(so_far)

    parts = []
    for k in range(1, 7):
        at = latest(F.col("level") == k, F.col("line_no"))
        reset = latest(F.col("level") < k, F.col("line_no"))
        parts.append(F.when((F.col("level") >= k) & at.isNotNull() & (reset.isNull() | (at > reset)), latest(F.col("level") == k, F.col("title"))))
    return titles.select("doc_id", "line_no", "level", F.array_compact(F.array(*parts)).alias("path"))


# ---- what a whole text says about itself ----

# Words of technical domains, by how special they are.
CONCEPTS = {
    "kubernetes": (
        ("kubernetes", "k8s", "kubectl", "pod", "deployment", "service", "namespace", "configmap", "secret"),
        ("cluster", "node", "container", "yaml", "manifest", "helm", "operator", "crd"),
        ("admission-controller", "mutating-webhook", "validating-webhook", "custom-resource"),
    ),
    "docker": (("docker", "dockerfile", "container", "image", "registry"), ("build", "run", "push", "pull", "tag", "volume", "network"), ("multi-stage", "buildkit", "layer-caching")),
    "monitoring": (("prometheus", "metric", "alert", "monitor"), ("query", "dashboard", "notification", "threshold", "scrape"), ("prometheus-operator", "service-monitor", "alertmanager")),
    "networking": (("network", "ip", "port", "protocol", "tcp", "udp", "http", "https"), ("firewall", "proxy", "load-balancer", "ingress", "dns"), ("network-policy", "service-mesh", "cni", "bgp")),
    "security": (("security", "auth", "authorization", "authentication", "rbac"), ("certificate", "tls", "ssl", "token", "secret", "key"), ("oauth", "oidc", "jwt", "pki", "mtls")),
}
# Words of hard matters, of trouble, and of queries' kinds.
ADVANCED_TERMS = ("operator", "custom-resource", "admission-controller", "service-mesh", "crd")
TROUBLE = ("error", "problem", "issue", "failed")
TROUBLE_FULL = ("error", "problem", "issue", "failed", "debug", "故障", "问题", "错误")
# What counts as a command, a configuration file, an endpoint, an error.
EXTRACTS = {
    "commands": (
        r"kubectl\s+[a-zA-Z\-]+(?:\s+[a-zA-Z0-9\-\.]+)*",
        r"docker\s+[a-zA-Z\-]+(?:\s+[a-zA-Z0-9\-\.]+)*",
        r"helm\s+[a-zA-Z\-]+(?:\s+[a-zA-Z0-9\-\.]+)*",
        r"curl\s+[^\n]+",
        r"wget\s+[^\n]+",
        r"ssh\s+[^\n]+",
        r"scp\s+[^\n]+",
    ),
    "configs": (r"[a-zA-Z0-9\-_]+\.ya?ml", r"[a-zA-Z0-9\-_]+\.json", r"[a-zA-Z0-9\-_]+\.conf", r"[a-zA-Z0-9\-_]+\.ini", r"[a-zA-Z0-9\-_]+\.properties", r"Dockerfile", r"docker-compose\.ya?ml"),
    "endpoints": (r"https?://[a-zA-Z0-9\-\.]+(?::[0-9]+)?(?:/[a-zA-Z0-9\-\._/]*)?", r"/api/v[0-9]+/[a-zA-Z0-9\-\._/]*", r"/[a-zA-Z0-9\-_]+/v[0-9]+/[a-zA-Z0-9\-\._/]*"),
    "errors": (r"(?i)Error:?\s*[^\n]+", r"(?i)Exception:?\s*[^\n]+", r"(?i)Failed:?\s*[^\n]+", r"(?i)\d{3}\s+(?:Bad Request|Unauthorized|Forbidden|Not Found|Internal Server Error)", r"(?i)exit code\s+\d+"),
}
_NAME = r"[a-zA-Z0-9\-_]"  # as the configs' patterns have it
# Of each pattern what a text must have one of, so that most texts need no search; errors, of any case, are searched for.
NEEDED = {
    "commands": (("kubectl",), ("docker",), ("helm",), ("curl",), ("wget",), ("ssh",), ("scp",)),
    "configs": ((".yaml", ".yml"), (".json",), (".conf",), (".ini",), (".properties",), ("Dockerfile",), ("docker-compose.",)),
    "endpoints": (("http",), ("/api/v",), ("/v",)),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(text: Column, *needles: str) -> Column:
    """How often the needles occur, each counted without overlaps."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(n), F.lit("")))) / len(n) for n in needles), F.lit(0)).cast("int")


def concepts(text: Column, most: int = 20) -> Column:
    """(concept, domain, frequency) of the domains' words, the most frequent first, else in list order.

    Words are read once; only the words with a hyphen are searched for in the text.
    """
    rows = [(i, term, domain) for i, (term, domain) in enumerate((t, domain) for domain, levels in CONCEPTS.items() for level in levels for t in level)]
    simple = [*dict.fromkeys(t for _, t, _ in rows if "-" not in t)]
    uses = [F.array(*[F.struct(F.lit(i).alias("place"), F.lit(domain).alias("domain")) for i, t, domain in rows if t == term]) for term in simple]
    places = F.map_from_arrays(F.array(*map(F.lit, simple)), F.array(*uses))

    def counts_as(place: Column, term: Column, domain: Column, many: Column) -> Column:
        return F.struct((-many).alias("less"), place.alias("place"), term.alias("concept"), domain.alias("domain"), many.alias("frequency"))

    def counted(lowered: Column) -> Column:
        words = F.filter(F.regexp_extract_all(lowered, F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: w.isin(simple))

        def of(words: Column) -> Column:
            def used(term: Column) -> Column:
                return _let(F.size(F.filter(words, lambda w: w == term)), lambda n: F.transform(F.element_at(places, term), lambda x: counts_as(x["place"], term, x["domain"], n)))

            found = [F.flatten(F.transform(F.array_distinct(words), used))]
            for i, term, domain in rows:
                if "-" in term:
                    many = F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(rf"(?U)\b{re.escape(term)}\b"))).otherwise(0)
                    found.append(F.filter(F.array(counts_as(F.lit(i), F.lit(term), F.lit(domain), many)), lambda x: x["frequency"] > 0))
            return F.array_sort(F.concat(*found))

        return _let(words, of)

    best = F.slice(_let(F.lower(text), counted), 1, most)
    return F.transform(best, lambda x: F.struct(x["concept"].alias("concept"), x["domain"].alias("domain"), x["frequency"].alias("frequency")))


def contexts(text: Column, term: Column, most: int = 2) -> Column:
    """Lines that have the term, with the line before and after, over 10 characters, cut at 200."""

    def around(lines: Column) -> Column:
        beside = F.transform(lines, lambda line, i: F.when(F.contains(F.lower(line), F.lower(term)), F.trim(F.array_join(F.slice(lines, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))))
        return F.transform(F.slice(F.filter(beside, lambda x: F.length(x) > 10), 1, most), lambda x: F.substring(x, 1, 200))

    return _let(F.split(text, "\n"), around)


def _quick(pattern: str) -> str:
    """A pattern that finds the same in Java without recursion and second looks.

    Java repeats a group by recursion, a frame for each word of a command, and by a loop where nothing may be given
    back; at a pattern's end nothing ever is.  A name before a dot begins where its characters begin or where the match
    before ended: a later start has the same end.
    """
    if pattern.startswith(_NAME + r"+\."):
        pattern = rf"(?:(?<!{_NAME})|\G){_NAME}++" + pattern[len(_NAME) + 1 :]
    return pattern + "+" if pattern.endswith(")*") else pattern


def extracts(text: Column, kind: str, most: int = 10) -> Column:
    """Distinct matches of a kind's patterns in order of first sight, pattern by pattern."""
    found = []
    for i, pattern in enumerate(EXTRACTS[kind]):
        matches = F.regexp_extract_all(text, F.lit(f"({_quick(pattern)})"), F.lit(1))
        if kind in NEEDED:
            has = reduce(or_, (F.contains(text, F.lit(t)) for t in NEEDED[kind][i]))
            matches = F.when(~has, F.array().cast("array<string>")).otherwise(matches)
        found.append(matches)
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def counts(text: Column) -> dict[str, Column]:
    """Words, characters, lines, code blocks, list items, links and images."""
    return {
        "n_words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")),
        "n_chars": F.length(text),
        "n_lines": F.size(F.split(text, "\n")),
        "n_code": F.floor(F.regexp_count(text, F.lit("```")) / 2).cast("int"),
        "n_lists": F.regexp_count(text, F.lit(r"(?m)^\s*(?:[-*+]|\d+\.)\s+")),
        "n_links": occurrences(text, "]("),
        "n_images": occurrences(text, "!["),
    }


def title_map(text: Column) -> Column:
    """Titles by level."""
    titles = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}[ \t]+\S.*)$"), F.lit(1))
    levels = F.array_sort(F.array_distinct(F.transform(titles, lambda t: F.length(F.regexp_extract(t, "^(#+)", 1)))))
    return F.map_from_entries(F.transform(levels, lambda k: F.struct(k, F.transform(F.filter(titles, lambda t: F.length(F.regexp_extract(t, "^(#+)", 1)) == k), lambda t: F.trim(F.regexp_replace(t, "^#+", ""))))))


def readability(text: Column, n_words: Column, n_lines: Column) -> Column:
    parts = occurrences(text, "```", "- ", "# ")
    value = 0.7 * F.least(parts / F.greatest(n_lines / 10, F.lit(1.0)), F.lit(1.0)) + 0.3 * F.least(n_words / 500, F.lit(1.0))
    return F.when(F.length(text) == 0, 0.0).when(n_words == 0, 0.3).otherwise(value)


def technical_depth(found: Column) -> Column:
    """From the number and the frequencies of concepts."""
    total = F.aggregate(found, F.lit(0), lambda s, c: s + c["frequency"])
    return F.when(F.size(found) > 0, (F.least(total / 20, F.lit(1.0)) + F.least(F.size(found) / 10, F.lit(1.0))) / 2).otherwise(F.lit(0.0))


def completeness(has_titles: Column, has_languages: Column, n_commands: Column, n_configs: Column, n_code: Column, n_tables: Column, n_lists: Column, n_words: Column) -> Column:
    def share(*tests: Column) -> Column:
        return sum((t.cast("int") for t in tests), F.lit(0)) / len(tests)

    return (share(has_titles, has_languages, n_commands > 0, n_configs > 0) + share(n_code > 0, n_tables > 0, n_lists > 0, n_words > 50)) / 2


def content_complexity(text: Column, n_words: Column, n_code: Column) -> Column:
    hits = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in ADVANCED_TERMS), F.lit(0))
    score = 0.6 * hits / F.greatest(n_words / 100, F.lit(1.0)) + 0.4 * F.least(n_code / 5, F.lit(1.0))
    return F.when((n_words == 0) | (score < 0.2), "simple").when(score < 0.5, "moderate").when(score < 0.8, "complex").otherwise("expert")


def document_complexity(text: Column) -> Column:
    """simple, moderate or complex by length and layout."""
    parts = (F.rlike(text, F.lit(r"(?m)^#{1,6}\s+")).cast("int") + F.contains(text, F.lit("```")).cast("int") + F.rlike(text, F.lit(r"(?m)^\s*(?:[-*+]|\d+\.)\s+")).cast("int"))
    n = F.length(text)
    return F.when(n < 1000, "simple").when((n > 5000) | (parts >= 2), "complex").when((n > 2000) | (parts >= 1), "moderate").otherwise("simple")


def content_patterns(text: Column, n_code: Column, n_configs: Column, full: bool = False) -> Column:
    """(pattern, confidence) of what a text is about; ``full`` looks for four patterns, else two."""
    lowered = F.lower(text)
    trouble = occurrences(lowered, *(TROUBLE_FULL if full else TROUBLE))
    steps = occurrences(text, "1. ", "2. ", "3. ")
    code_from, trouble_from, most = (3, 3, 10) if full else (2, 2, 8)
    found = [("code_intensive", n_code > code_from, n_code / most), ("troubleshooting", trouble > trouble_from, trouble / most)]
    if full:
        found += [("step_oriented", steps > 5, steps / 15), ("configuration_guide", (n_configs > 2) | (n_code > 1), (n_configs + n_code) / 8)]
    return F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("pattern"), F.least(value, F.lit(1.0)).alias("confidence"))) for name, test, value in found]), lambda x: x.isNotNull())


def domain_tags(found: Column, most: int = 3, full_at: int = 5) -> Column:
    """(domain, frequency, confidence): the domains with the most concept words; ties by first sight."""
    order = F.array_distinct(F.transform(found, lambda c: c["domain"]))
    summed = F.transform(
        order, lambda d, i: F.struct((-F.aggregate(F.filter(found, lambda c: c["domain"] == d), F.lit(0), lambda s, c: s + c["frequency"])).alias("less"), i.alias("place"), d.alias("domain"))
    )
    return F.transform(F.slice(F.array_sort(summed), 1, most), lambda x: F.struct(x["domain"].alias("domain"), (-x["less"]).alias("frequency"), F.least(-x["less"] / full_at, F.lit(1.0)).alias("confidence")))


def document_match(query_type: Column, patterns: Column, query_domains: Column, domains: Column, complexity: Column, depth: Column, complete: Column) -> Column:
    """1 and what a document's kind, domains, complexity, depth and completeness add, at most 2."""
    word = {"code_query": ("code", 0.2), "troubleshoot_query": ("troubleshoot", 0.3), "tutorial_query": ("step", 0.2), "config_query": ("config", 0.25)}

    def named(part: str) -> Column:
        return F.size(F.filter(patterns, lambda p: F.contains(p, F.lit(part))))

    by_kind = F.lit(0.0)
    for kind, (part, value) in word.items():
        by_kind = F.when(query_type == kind, value * named(part)).otherwise(by_kind)
    both = F.when((F.size(query_domains) > 0) & (F.size(domains) > 0), 0.3 * F.size(F.array_intersect(query_domains, domains)) / F.greatest(F.size(query_domains), F.size(domains))).otherwise(F.lit(0.0))
    by_class = F.when(complexity == "moderate", 0.05).when(complexity == "complex", 0.1).when(complexity == "expert", 0.15).otherwise(0.0)
    return F.least(F.lit(2.0), 1.0 + by_kind + both + by_class + 0.1 * depth + 0.1 * complete)
