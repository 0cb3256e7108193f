"""Plain Python versions of the operations, from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict

STRIP = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def order(i):
    return -(2**63) if i is None else i


def lines(docs, least=20, often=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    where = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where[key(x)].add(order(i))
    gone = lambda i, x: len(where.get(key(x), ())) >= often and max(where[key(x)]) != order(i)
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if not gone(i, x)]
        out.append((i, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return out


def repeats(docs, size, words):
    """Items covered by windows that start earlier; of words also in the same document."""
    first = {}
    parts = [(order(i), WORD.findall(t or "") if words else (t or "").encode()) for i, t in docs]
    for i, x in parts:
        for s in range(len(x) - size + 1):
            w = tuple(x[s : s + size]) if words else x[s : s + size]
            at = (i, s if words else 0)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for i, x in parts:
        hit = [False] * len(x)
        for s in range(len(x) - size + 1):
            w = tuple(x[s : s + size]) if words else x[s : s + size]
            if first[w] < (i, s if words else 0):
                hit[s : s + size] = [True] * size
        kept = [c for c, h in zip(x, hit, strict=True) if not h]
        spans = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        out.append((None if i == order(None) else i, len(x), sum(hit), spans, " ".join(kept) if words else bytes(kept)))
    return out


def prob_jaccard(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def classes(docs, size=5, threshold=0.8):
    shingles = defaultdict(list)
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in docs:
        parent[order(i)] = order(i)
        w = WORD.findall(t or "")
        if w:
            shingles[order(i)].append(Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))))
    ids = sorted(shingles)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sorted((find(x), find(y)))
            if a != b and any(p.keys() & q.keys() and prob_jaccard(p, q) >= threshold - 1e-12 for p in shingles[x] for q in shingles[y]):
                parent[b] = a
    back = lambda x: None if x == order(None) else x
    return [(i, back(find(order(i)))) for i, _ in docs]


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            covered |= set(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def best_fit(lengths, capacities, overhead, attention):
    """The rule of best fit, item by item; bins are [capacity, time of the last item, lengths]."""
    cost = lambda c: c + overhead + attention * c * c
    bins, out = [], []
    for k, x in enumerate(lengths):
        rooms = [(c - sum(items), -time, b) for b, (c, time, items) in enumerate(bins) if c - sum(items) >= x]
        if rooms:
            b = min(rooms)[2]
        else:

            def rate(c):
                room, filled = c - x, x
                for y in lengths[k + 1 :]:
                    if y <= room:
                        room, filled = room - y, filled + y
                return cost(c) / max(1, filled)

            b = len(bins)
            bins.append([min((c for c in capacities if c >= x), key=lambda c: (rate(c), c)), 0, []])
        out.append((b, sum(bins[b][2])))
        bins[b][2].append(x)
        bins[b][1] = k
    return [b for b, _ in out], [o for _, o in out], [min(c for c in capacities if c >= sum(items)) for _, _, items in bins]


def least_cost(lengths, capacities, overhead, attention):
    """The least cost of any packing, by trying all."""
    cost = lambda u: min(c + overhead + attention * c * c for c in capacities if c >= u)
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(map(cost, bins)))
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= max(capacities):
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]
