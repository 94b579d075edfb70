"""Plain versions of the corpus operators, to hold them against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None, lower: bool = True) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOW) if lower else raw)


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


class Union:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_groups(texts: dict[int, str | None], k: int, num: int, den: int) -> dict[int, int]:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids, u = sorted(sets), Union(sets)
    holders = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            holders[g].append(i)
    shared = Counter((a, b) for l in holders.values() for x, b in enumerate(l) for a in l[:x])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            u.link(a, b)
    return {i: u.find(i) for i in ids}


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def water_fill(sizes: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= most * sizes[s]}
        if not over:
            out |= {s: w[s] * level for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def repeats(texts: dict[int, str | None], n: int) -> dict[int, set[int]]:
    held = {i: words(t, lower=False) for i, t in texts.items()}
    seen = defaultdict(set)
    for i, w in held.items():
        for j in range(len(w) - n + 1):
            seen[tuple(w[j : j + n])].add(i)
    out: dict[int, set[int]] = defaultdict(set)
    for i, w in held.items():
        for j in range(len(w) - n + 1):
            if len(seen[tuple(w[j : j + n])]) > 1:
                out[i].update(range(j, j + n))
    return out


def kneser_ney(texts: list[str], order: int, symbols: int):
    """Interpolated Kneser-Ney over runs of letters, by its definition: p(symbol, the order - 1 symbols before it)."""
    runs = [["\x01"] * (order - 1) + list(r) + ["\x02"] for t in texts for r in re.findall(r"[^\W\d_]+", t.lower())]
    grams = [tuple(r[i - order + 1 : i + 1]) for r in runs for i in range(order - 1, len(r))]
    counts = {order: Counter(grams)}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in {x[-(m + 1) :] for x in grams})
    discount, total, left = {}, {}, {}
    for m, c in counts.items():
        n1, n2 = (sum(v == n for v in c.values()) for n in (1, 2))
        discount[m] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[m], left[m] = Counter(), Counter()
        for g, v in c.items():
            total[m][g[:-1]] += v
            left[m][g[:-1]] += min(v, discount[m])

    def p(symbol, before, m=order):
        if m == 0:
            return 1 / symbols
        context = tuple(before[len(before) - (m - 1) :])
        shorter = p(symbol, before, m - 1)
        if not total[m][context]:
            return shorter
        return max(counts[m][(*context, symbol)] - discount[m], 0) / total[m][context] + left[m][context] / total[m][context] * shorter

    return p
