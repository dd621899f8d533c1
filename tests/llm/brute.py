"""The operators' results by plain loops over (doc_id, text) rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def katz(rows, order, k_most=5):
    texts = [(i, [*words((t or "").encode().lower().decode()), b"</s>"]) for i, t in rows]
    grams = [Counter() for _ in range(order + 1)]
    history = [Counter() for _ in range(order + 1)]
    for i, ws in texts:
        if remainder(i, 7) != 2:
            padded = ["<s>"] * (order - 1) + ws
            for k in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    g = tuple(padded[k - n + 1 : k + 1])
                    grams[n][g] += 1
                    history[n][g[:-1]] += 1
    total, kinds = sum(grams[1].values()), len(grams[1])
    discounts = [None]
    for n in range(1, order + 1):
        r = Counter(grams[n].values())
        found = None
        if r[1]:
            common = (k_most + 1) * r[k_most + 1] / r[1]
            found = [0] + [((c + 1) * r[c + 1] / (c * r[c]) - common) / (1 - common) if r[c] and common != 1 else 0 for c in range(1, k_most + 1)]
        if not found or not all(0 < d < 1 for d in found[1:]):
            found = [0] + [1 - 0.5 / c for c in range(1, k_most + 1)]
        discounts.append(found)

    def kept(n, c):
        return discounts[n][c] * c if c <= k_most else c - k_most * (1 - discounts[n][k_most])

    unknown = 1 - sum(kept(1, c) for c in grams[1].values()) / total if total else 1.0
    followers = [defaultdict(list) for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g in grams[n]:
            followers[n][g[:-1]].append(g[-1])
    weights = {}

    def weight(n, h):
        if (n, h) not in weights:
            left = 1 - sum(kept(n, grams[n][(*h, w)]) for w in followers[n][h]) / history[n][h]
            weights[n, h] = left / (1 - sum(chance(n - 1, h[1:], w) for w in followers[n][h]))
        return weights[n, h]

    def chance(n, h, w):
        if n == 1:
            return kept(1, grams[1][(w,)]) / total if grams[1][(w,)] else unknown
        if c := grams[n][(*h, w)]:
            return kept(n, c) / history[n][h]
        return chance(n - 1, h[1:], w) * (weight(n, h) if history[n][h] else 1)

    out = []
    for i, ws in texts:
        padded = ["<s>"] * (order - 1) + ws
        base = sum(math.log10((grams[1][(w,)] + 1) / (total + kinds + 1)) for w in ws)
        score = sum(math.log10(chance(order, tuple(padded[k - order + 1 : k]), padded[k])) for k in range(order - 1, len(padded)))
        out.append((i, remainder(i, 7) == 2, len(ws), sum((w,) in grams[1] for w in ws), total, base, score))
    vocabulary = [g[0] for g in grams[1]]
    sums = [sum(chance(order, h, w) for w in [*vocabulary, "never seen"]) for h in [*history[order], ("nor", "this")[: order - 1]][-5:]]
    return out, sums


def shingles(text):
    ws = words((text or "").encode().lower().decode())
    return frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def without_repeats(rows, width=35):
    texts = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal(rows):
    out = []
    for i, t in rows:
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if valid(k, m[0])] for k, p in PATTERNS.items()}
        text = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
        out.append((i, *map(len, found.values()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def statistics(rows):
    out = []
    for i, t in rows:
        t = t or ""
        ws = words(t)
        count = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        again = bytearray(len(ws))
        for k in range(len(ws) - 4):
            if count[tuple(ws[k : k + 5])] > 1:
                again[k : k + 5] = b"\1" * 5
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(ws) < 10 or 100 * sum(again) > 20 * len(ws)
        out.append((i, len(ws), sum(len(w.decode()) for w in ws), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(again), failed))
    return out
