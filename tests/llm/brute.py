"""Plain restatements that the operators are tested against."""

import re

import numpy as np


def word_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def jaccard_links(texts, threshold=0.8):
    sets, links = word_sets(texts), []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links.append((j, i))
    return links


def smallest_reachable(ids, links):
    name = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b], key=lambda i: (ids[i], i))
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return [ids[i] for i in name]


def cosine_links(vectors, threshold=0.9):
    m = np.array(vectors, dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return list(zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True))


def repeated_bytes(texts, k=200):
    """Per text: (bytes, removed, runs, what is left)."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - k + 1):
            seen[r[i : i + k]] = seen.get(r[i : i + k], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - k + 1):
            if seen[r[i : i + k]] > 1:
                gone[i : i + k] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(r)]).sum()) if len(r) else 0
        left = np.frombuffer(r, np.uint8)[~gone[: len(r)]].tobytes()
        out.append((len(r), int(gone.sum()), runs, left))
    return out
