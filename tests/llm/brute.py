"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def exact_dedup(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[sha((text or "").translate(_UPPER))].append(doc)
    return {(d, max(ids), len(ids), d == max(ids), h) for h, ids in groups.items() for d in ids}


def substring_dedup(docs, width=20):
    first = {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), (d, i))
    out = set()
    for d, found in words.items():
        gone = [False] * len(found)
        for i in range(len(found) - width + 1):
            if first[tuple(found[i : i + width])] != (d, i):
                gone[i : i + width] = [True] * width
        kept = [w for w, g in zip(found, gone) if not g]
        out.add((d, len(found), sum(gone), sha(" ".join(kept))))
    return out


def library():
    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def ids_bytes(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def bpe(docs):
    tokens = library()
    out = set()
    for d, t in docs:
        ids = tokens.encode(t or "", add_special_tokens=False).ids
        out.add((d, len(ids), hashlib.sha256(ids_bytes(ids)).hexdigest(), sha(tokens.decode(ids, skip_special_tokens=False))))
    return out


def pieces(docs, capacity=2048):
    tokens = library()
    out = set()
    for d, t in docs:
        ids = tokens.encode(t or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.add((d, k, start, len(part), zlib.crc32(ids_bytes(part))))
    return out


def shingles(text, words=5):
    found = WORD.findall((text or "").translate(_UPPER))
    if not found:
        return frozenset()
    n = min(words, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def jaccard_components(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    common = Counter()
    for ids in owners.values():
        common.update(combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {(d, len(s), root(d)) for d, s in sets.items()}


def quality_base(docs):
    out = set()
    for d, t in docs:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = [False] * len(words)
        for i in range(len(words) - 7):
            if windows[tuple(words[i : i + 8])] > 1:
                inside[i : i + 8] = [True] * 8
        n = len(words)
        out.add((d, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(inside), n < 20 or 100 * sum(inside) > 30 * n))
    return out


_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def license_base(docs):
    out = {}
    for d, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_UPPER))
        places, labels = [], set()
        for phrase, label in _PHRASES:
            parts = phrase.split()
            for i in range(len(words)):
                if words[i : i + len(parts)] == parts:
                    places.append(i)
                    labels.add(label)
        out[d] = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    return out


def tree_levels(nodes):
    """All levels of a tree of eight children a node, up to the single node."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to rows of the Merkle manifest."""

    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        head = [field(x) for x in (doc_id, source, lang, n_chars)]
        leaf = changed = sha(*head, field(text))
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            changed = sha(*head, field("".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        by_lang.setdefault(lang, []).append((doc_id, leaf, changed))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree_levels([leaf for _, leaf, _ in by_lang[lang]]) for lang in order]
    top = tree_levels([tree[-1][0] for tree in trees])
    out = []
    for k, (lang, tree) in enumerate(zip(order, trees)):
        for i, (doc_id, leaf, node) in enumerate(by_lang[lang]):
            beside = []
            for levels, at in ((tree, i), (top, k)):
                for level in levels[:-1]:
                    left, right = level[at - at % 8 : at], level[at + 1 : at - at % 8 + 8]
                    beside += left + right
                    node = sha(*left, node, *right)
                    at //= 8
            out.append((doc_id, leaf, tree[-1][0], top[-1][0], sha(*beside), node, node == top[-1][0]))
    return out


def trie(rows):
    """Rows (conv_id, turn, role, text) to the nodes of the conversations' prefix trie."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role.encode())}:", role, text)[:32]
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(found)] for c, found in own.items()}
    nodes = {} if turns else {(): []}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = turns.get(int(c / 20) * 20, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    children, sums = {}, {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key in sorted(nodes, key=len, reverse=True):
        below = [sums[x] for x in children.get(key, [])]
        words = len(key[-1][1].encode().split()) if key else 0
        sums[key] = sum(x for x, _ in below) or 1, sum(x for _, x in below) + (len(nodes[key]) - 1) * words

    def first(key):
        return min((c for c, _ in nodes[key]), default=None)

    return [
        (first(k), len(k), first(k[:-1]) if k else None, len(nodes[k]), len(children.get(k, [])), *sums[k], sha(",".join(map(str, sorted(c for c, end in nodes[k] if end)))))
        for k in nodes
    ]
