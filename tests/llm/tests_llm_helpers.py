"""Brute-force versions that several tests share."""

import struct
import zlib
from collections import Counter, defaultdict


def brute_near(rows, rule):
    """(doc_id, n_shingles, component_id, kept) by comparing all sets; doc_ids must be distinct or have equal texts."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = rule.words
        sets[i] = frozenset(tuple(w[a:a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    order = lambda i: (i is not None, i or 0)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets, key=order):
        common = Counter(j for x in sets[i] for j in index[x])
        for j, n in common.items():
            if 100 * n >= rule.share * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)), key=order)
                parent[b] = a
        for x in sets[i]:
            index[x].append(i)
    return sorted([(i, len(sets[i]), find(i), find(i) == i) for i, _ in rows], key=str)


def plain_pieces(docs, capacity):
    from test_exact_and_tokens import plain_ids

    out = []
    for (doc_id, _), ids in zip(docs, plain_ids([t or "" for _, t in docs])):
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((doc_id, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out
