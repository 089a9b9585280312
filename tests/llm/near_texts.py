"""Near duplicates by all pairs of shingle sets, for tests."""

import collections


def similar_firsts(texts, width=5, least=0.8):
    """Place of the first text of each group, groups being joined by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                parent[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(texts)):
        groups[top(i)].append(i)
    return sorted(map(min, groups.values()))
