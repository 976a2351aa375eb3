"""Blocks and chunks of markdown against plain versions, by line and by hand."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from opsweave.operators import markdown as M

PARTS = ["# Top", "## Sub *x*", "#No title", "text one", "more | text", "- item", "  - deeper", "    carried on", "1. first", "> quote", ">", "| a | b |", "|---|---|", "| 1 | 2 |", "```python", "```", "x = 1", "", "   ", "last"]


def plain_blocks(text):
    """(kind, content) by one pass with a rule for each kind, written down line by line."""
    lines, out, i = text.split("\n"), [], 0

    def item(k):
        return M.ITEM.match(lines[k])

    while i < len(lines):
        line = lines[i].strip()
        if not line:
            i += 1
        elif m := M.TITLE.match(lines[i]):
            out.append(("title", m[2].strip()))
            i += 1
        elif line.startswith("```"):
            ends = [k for k in range(i + 1, len(lines)) if lines[k].strip() == "```"]
            if ends:
                out.append(("code_block", "\n".join(lines[i + 1 : ends[0]])))
            i = ends[0] + 1 if ends else i + 1
        elif item(i):
            width = lambda k: len(lines[k]) - len(lines[k].lstrip())
            first, held = i, []
            while i < len(lines) and (not lines[i].strip() or item(i) or width(i) > width(first)):
                held += [lines[i]] if lines[i].strip() else []
                i += 1
            out.append(("list", "\n".join(held)))
        elif line.startswith(">"):
            held = []
            while i < len(lines) and (not lines[i].strip() or lines[i].strip().startswith(">")):
                held += [lines[i].strip()[1:].strip()] if lines[i].strip() else []
                i += 1
            out.append(("quote", "\n".join(held)))
        elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and M.RULE.match(lines[i + 1].strip()):
            held = []
            while i < len(lines) and (not lines[i].strip() or "|" in lines[i]):
                held += [lines[i].strip()] if lines[i].strip() else []
                i += 1
            out.append(("table", "\n".join(held)))
        else:
            held = []
            while i < len(lines) and lines[i].strip():
                now = lines[i].strip()
                if now[0] in "#>" or now.startswith("```") or item(i) or "|" in now and i + 1 < len(lines) and "|" in lines[i + 1]:
                    break
                held.append(now)
                i += 1
            if held:
                out.append(("paragraph", " ".join(held)))
            else:
                i += 1
    return out


def texts():
    rng = random.Random(3)
    return ["", "\n\n", "plain", *("\n".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(150))]


def test_blocks(spark):
    docs = list(enumerate(texts()))
    rows = M.blocks(spark.createDataFrame([*docs, (None, None)], "doc_id long, text string")).collect()
    for doc, text in docs:
        got = [(r.kind, r.content) for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.block_no)]
        assert got == plain_blocks(text)


def test_unclosed_fence_and_nested_list():
    assert [(b.kind, b.content) for b in M.blocks_of("```yaml\nkey: 1\n\n- a\n  - b\n   c\nend")] == [("paragraph", "key: 1"), ("list", "- a\n  - b\n   c"), ("paragraph", "end")]


def test_chunks(spark):
    text = "\n\n".join(["# Title", "a" * 500, "## Part", "b" * 300, "c" * 400, "```sql\n" + "d" * 200 + "\n```", "| a | b |\n|---|---|\n| 1 | 2 |"])
    rows = M.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r.title_path for r in rows] == [["Title"], ["Title", "Part"], ["Title", "Part"]]
    assert rows[0].content == "[上下文: Title]\n\n# Title\n\n" + "a" * 500
    # The code would fill the second chunk: it is cut after its last paragraph, which opens the third.
    assert [r.element_types for r in rows[1:]] == [["title", "paragraph", "paragraph"], ["paragraph", "code_block", "table"]]
    for r in rows:
        assert r.chunk_id == hashlib.md5(r.content.encode()).hexdigest() and r.total_chunks == len(rows)
    weight = (1.4 * 1.5 * 5 + 500) / 505
    assert abs(rows[0].semantic_weight - weight) < 1e-9 and abs(rows[0].structural_weight - 1.1 * 1.1) < 1e-9


def test_chunks_keep_all_blocks():
    """Every block stands in some chunk, in order; only the block at a cut stands twice."""
    for text in texts():
        kinds = [k for c in M.chunks_of(text, 60) for k in c["element_types"]]
        blocks = [b.kind for b in M.blocks_of(text)]
        assert len(blocks) <= len(kinds) <= 2 * len(blocks)


def test_scaled_weights(spark):
    rows = [(1, 1.0, 2.0), (1, 3.0, 2.0), (1, 2.0, 2.0)]
    got = M.scaled_weights(spark.createDataFrame(rows, "doc_id long, semantic_weight double, structural_weight double")).collect()
    assert sorted(r.semantic_weight for r in got) == [0.5, 0.75, 1.0] and {r.structural_weight for r in got} == {2.0}


def test_a_command_of_many_words_is_found(spark):
    long = "kubectl get" + " word-1.x" * 20_000
    rows = [(1, long), (2, f"{long}\nhelm list a\ndocker run b"), (3, None)]
    got = {r.doc_id: r for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", M.extracts(F.col("text"), "commands").alias("found")).collect()}
    assert got[1].found == [long]
    assert got[2].found == [f"{long}\nhelm list a\ndocker run b", "docker run b", "helm list a\ndocker run b"]
    assert got[3].found is None


def test_extracts_are_those_of_the_patterns(spark):
    rng = random.Random(5)
    parts = ["kubectl", "docker", "helm", "Dockerfile", "a.yaml", ".yml", "b_", "-", ".json", "x.conf", "y.ini", ".properties", "docker-compose.yml", " ", "\n", "  ", "é", "/", "9", "http://", "/api/v1", "/v2/"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(300)] + ["a.yamlb.yaml-.json.json", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind in ("commands", "configs", "endpoints"):
        for r in df.select("text", M.extracts(F.col("text"), kind).alias("found")).collect():
            # Python gives the engines' result: these patterns take the leftmost match and as much as they can.
            want = [m[0] for p in M.EXTRACTS[kind] for m in re.finditer(p, r.text, re.ASCII)] if len(r.text) < 1000 else []
            assert r.found == list(dict.fromkeys(want))[:10]


def test_concepts_are_those_of_a_plain_count(spark):
    rng = random.Random(6)
    rows = [(t, domain) for domain, levels in M.CONCEPTS.items() for level in levels for t in level]
    texts = [" ".join(rng.choices([t for t, _ in rows], k=rng.randrange(60))).title() for _ in range(100)] + ["", "no such words", None]
    for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text", M.concepts(F.col("text")).alias("found")).collect():
        lowered = (r.text or "").lower()
        words = re.findall(r"\w+", lowered)
        counts = [len(re.findall(rf"\b{t}\b", lowered)) if "-" in t else words.count(t) for t, _ in rows]
        best = sorted((i for i, n in enumerate(counts) if n), key=lambda i: (-counts[i], i))[:20]
        assert [tuple(x) for x in r.found or []] == [(*rows[i], counts[i]) for i in best]
