"""Brute-force versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return SPACES.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, n, num, den):
    """Smallest id reachable by links, for (id, text) pairs."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return [(i, len(s), min(least[find(k)])) for k, (i, s) in enumerate(sets)]


def repeats(texts, length):
    """For each text a list of booleans: this byte is in a string of ``length`` bytes that also starts elsewhere."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


def line_dedup(docs, min_lines, min_words):
    """Texts left of (id, text) pairs in order, with the numbers of lines and of lines removed."""
    rows = [[(n, x.translate({9: 32, 13: 32, 12: 32, 11: 32}).strip(" ")) for n, x in enumerate((t or "").split("\n"))] for _, t in docs]
    rows = [[(n, x) for n, x in r if x] for r in rows]
    seen, gone = set(), [set() for _ in docs]
    for size, fits in ((min_lines, lambda run: True), (1, lambda run: len(re.split(" +", run[0])) >= min_words)):
        seen = set()
        for d, r in enumerate(rows):
            for k in range(len(r) - size + 1):
                run = tuple(x for _, x in r[k : k + size])
                if run in seen and fits(run):
                    gone[d].update(n for n, _ in r[k : k + size])
                seen.add(run)
    return [("\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in g) if g else t, len(r), len(g)) for (_, t), r, g in zip(docs, rows, gone, strict=True)]
