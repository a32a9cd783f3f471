"""Slow and plain versions of the operators, for small inputs."""

import itertools
import random

WORDS = ["the", "an", "er", "in", "ou", "ti", "es", "on", "re", "st", "ha", "la", "ed", "or", "al", "ne", "se", "to"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def edit_distance_inside(item, text):
    """Fewest edits that make some part of the text equal to the item."""
    before = [0] * (len(text) + 1)
    for i, ch in enumerate(item, 1):
        now = [i]
        for j in range(1, len(text) + 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (text[j - 1] != ch)))
        before = now
    return min(before)


def repeated_windows(texts, n):
    """Runs of n words that stand in several documents: (document, place) of those that an earlier document has."""
    words = {d: (t or "").lower().split() for d, t in texts if d is not None}
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(d)
    return {(d, i) for d, w in words.items() for i in range(len(w) - n + 1) if min(seen[tuple(w[i : i + n])]) < d}


def pairs(xs):
    return itertools.combinations(xs, 2)


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def similar(a, b, similarity=0.8):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= similarity * len(a | b)


def edited(text, seed, edits):
    """A copy with so many words replaced."""
    r = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)
