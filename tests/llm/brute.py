"""Slow, plain versions of the operators, written from their contracts alone."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def fingerprint(text, shingle=3):
    from xxhash import xxh64_intdigest

    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, radius=2):
    """prints: list of (id, fingerprint). The smallest id that each row reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return [least[find(i)] for i in range(len(prints))]


def repeats(texts, size=35):
    """For each text: words, removed words, kept text."""
    docs = [words(t) for t in texts]
    seen = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = {j for i in range(len(d) - size + 1) if seen[tuple(d[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(d), len(gone), " ".join(w for j, w in enumerate(d) if j not in gone)))
    return out


def units(text):
    b = text.encode("utf-16-le", "surrogatepass")
    return [int.from_bytes(b[i : i + 2], "little") for i in range(0, len(b), 2)]


class KneserNey:
    """Interpolated modified Kneser-Ney over code units, floor 1/65536."""

    def __init__(self, texts, order=4):
        self.order, self.a, self.gamma = order, {}, {}
        counts = Counter(g for t in texts for g in self.grams(t or ""))
        for k in range(order, 0, -1):
            n = Counter(counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
            d = {m: min(max(m - (m + 1) * y * n[m + 1] / n[m] if n[m] else 0.5 * m, 0.05), m - 0.05) for m in (1, 2, 3)}
            total, left = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3)]
            self.a |= {g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in counts.items()}
            self.gamma |= {(k, x): left[x] / total[x] for x in total}
            counts = Counter(g[1:] for g in counts)

    def grams(self, text):
        u = [0] * (self.order - 1) + units(text)
        return [tuple(u[i : i + self.order]) for i in range(len(u) - self.order + 1)]

    def p(self, gram):
        p = 1 / 65536
        for k in range(1, self.order + 1):
            g = gram[-k:]
            p = self.a.get(g, 0) + self.gamma.get((k, g[:-1]), 1.0) * p
        return p

    def loss(self, text):
        """Mean negative log probability; None without units."""
        gs = self.grams(text or "")
        return -sum(math.log(self.p(g)) for g in gs) / len(gs) if gs else None


def fewest_bins(sizes, capacity):
    """The true optimum, by exhaustive search over few items."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(b for b in bins if b >= sizes[i])):
            rest = bins.copy()
            rest.remove(room)
            place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def similar(texts, shingle=5, similarity=0.8):
    """For each text the number of the first text that it reaches over links of this Jaccard similarity, and all links."""
    sets, root, pairs = [], list(range(len(texts))), []
    for t in texts:
        ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-9:
            pairs.append((i, j))
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], pairs
