"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return SPACE.findall(low)


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_links(sets, percent=75):
    """All pairs of ids with 100 * common >= percent * union, by prefix filtering."""
    count = Counter(x for s in sets.values() for x in s)
    index, links = defaultdict(list), set()
    for i, s in sorted(sets.items()):
        order = sorted(s, key=lambda x: (count[x], x))
        prefix = order[: len(s) - -(-len(s) * percent // 100) + 1]
        for j in {j for x in prefix for j in index[x]}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                links.add((j, i))
        for x in prefix:
            index[x].append(i)
    return links
