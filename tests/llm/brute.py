"""Plain versions of the corpus operators for small tables: lists of rows in, dictionaries or rows out."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LAST = float("inf")


def order(doc_id):
    return LAST if doc_id is None else doc_id


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def exact(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, text_sha256)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), order(doc_id), doc_id))
    out = []
    for text, members in groups.items():
        keep = min(m[:2] for m in members)[1]
        keep_id = None if keep == LAST else keep
        out += [(m[2], keep_id, len(members), m[1] == keep, sha(text)) for m in members]
    return out


def _key(line: str) -> str:
    line = line.strip(SPACE)
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def lines(rows, least=10):
    """(doc_id, text) -> (doc_id, n_lines, n_dropped, kept text)."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= least:
                holders[_key(line)].add(order(doc_id))
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if len(_key(x)) < least or min(holders[_key(x)]) == order(doc_id)]
        out.append((doc_id, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def jaccard_components(rows, width, threshold):
    """(doc_id, text) -> (doc_id, set size, component)."""
    sets = [shingles(text, width) for _, text in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    links = set()
    for k, s in enumerate(sets):
        for other, shared in Counter(o for g in s for o in where[g] if o > k).items():
            if 100 * shared >= threshold * (len(s) + len(sets[other]) - shared):
                links.add((k, other))
    roots = union_find(len(rows), links)
    least = defaultdict(lambda: LAST)
    for k, root in enumerate(roots):
        least[root] = min(least[root], order(rows[k][0]))
    return [
        (doc_id, len(sets[k]), None if least[roots[k]] == LAST else int(least[roots[k]])) for k, (doc_id, _) in enumerate(rows)
    ]


def targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """source -> target: weights dealt, what exceeds a limit dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] / total >= passes * sizes[s]]
        if not above:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = passes * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def cosine_links(vectors, threshold):
    """(vec_id, vector) -> (vec_id, n_links, component)."""
    import numpy as np

    good = [
        k
        for k, (_, v) in enumerate(vectors)
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    unit = [np.asarray(vectors[k][1], float) / np.linalg.norm(np.asarray(vectors[k][1], float)) for k in good]
    links = [
        (good[a], good[b])
        for a in range(len(good))
        for b in range(a + 1, len(good))
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold
    ]
    degree = Counter(x for pair in links for x in pair)
    roots = union_find(len(vectors), links)
    least = defaultdict(lambda: LAST)
    for k, root in enumerate(roots):
        least[root] = min(least[root], order(vectors[k][0]))
    return [(v[0], degree[k], None if least[roots[k]] == LAST else least[roots[k]]) for k, v in enumerate(vectors)]
