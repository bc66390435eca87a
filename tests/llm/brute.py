"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def leaks(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        k = min(n, len(own))
        for at in range(len(own) - k + 1) if k else ():
            windows[tuple(own[at:at + k])].add(str(item))
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for k in {len(w) for w in windows}:
            for at in range(len(own) - k + 1):
                found = windows.get(tuple(own[at:at + k]))
                if found:
                    hit.update(range(at, at + k))
                    names |= found
        out.append((doc, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def shingle_set(text, n=5):
    own = words(text)
    k = min(n, len(own))
    return {tuple(own[at:at + k]) for at in range(len(own) - k + 1)} if k else set()


def groups(pairs, nodes):
    parent = {node: node for node in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {node: root(node) for node in nodes}


def near_classes(docs, threshold=0.8):
    sets = {doc: shingle_set(text) for doc, text in docs}
    ids = [doc for doc in sets if sets[doc]]
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
             if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    return groups(pairs, sets)


def vectors(rows, least=0.98):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    usable = [(i, v, label) for i, v, label in rows if good(v, label)]
    links = defaultdict(set)
    pairs = []
    for i, v, label in usable:
        for j, w, other in usable:
            if i < j and label == other and len(v) == len(w):
                cosine = sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w))
                if cosine >= least:
                    links[i].add(j)
                    links[j].add(i)
                    pairs.append((i, j))
    root = groups(pairs, [i for i, _, _ in rows])
    return sorted((i, len(links[i]), root[i], root[i] == i) for i, _, _ in rows)


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def secrets(text):
    found = [(m.start(), kind, m.end()) for kind, (_, pattern, good) in enumerate(BASE) for m in pattern.finditer(text or "") if good(m)]
    counts = Counter(kind for _, kind, _ in found)
    listed = ",".join(f"{BASE[kind][0]}:{start}:{end}" for start, kind, end in sorted(found))
    return counts[0], counts[1], counts[2], hashlib.sha256(listed.encode()).hexdigest(), listed
