"""Plain forms of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def near_duplicates(rows):
    """rows: (doc_id, text) with distinct ids; (doc_id, set size, component)."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def repeated_spans(rows, length=50):
    docs = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in docs:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def suffix_tree(rows, depth, least, gain, strengths, held=lambda d: zlib.crc32(str(d).encode()) % 7 == 2):
    """(doc_id, held out, tokens, known, training tokens, base score, score)."""
    rule = held
    docs = {d: [*words(t), None] for d, t in rows}
    held = {d: rule(d) for d in docs}
    counts = [Counter() for _ in range(depth + 1)]
    for d, w in docs.items():
        if not held[d]:
            for k in range(depth + 1):
                counts[k].update(tuple(w[i - k : i + 1]) for i in range(k, len(w)))
    total, kinds = sum(counts[0].values()), len(counts[0])
    state = {}

    def p(context, word, upto):
        out = (counts[0][(word,)] + 1) / (total + kinds + 1)
        for k in range(1, upto + 1):
            s = context[len(context) - k :] if k <= len(context) else None
            if s is None or s not in state:
                break
            n = counts[k - 1][s]
            m = n * state[s]
            out = (counts[k][(*s, word)] + m * out) / (n + m)
        return out

    for k in range(1, depth + 1):
        gains = defaultdict(lambda: [0.0] * len(strengths))
        for gram, c in counts[k].items():
            s, n = gram[:-1], counts[k - 1][gram[:-1]]
            if any(counts[j - 1][gram[-1 - j : -1]] < least for j in range(1, k + 1)) or any(counts[j][gram[-1 - j :]] is None for j in range(k)):
                continue
            q = p(s, gram[-1], k - 1)
            for j, a in enumerate(strengths):
                m = n * a
                gains[s][j] += c * math.log((max(c - 1, 0) + m * q) / ((max(n - 1, 0) + m) * q))
        for s, g in gains.items():
            if max(g) > gain:
                state[s] = strengths[g.index(max(g))]
    out = []
    for d, w in docs.items():
        base = sum(math.log10((counts[0][(x,)] + 1) / (total + kinds + 1)) for x in w)
        score = sum(math.log10(p(tuple(w[:i]), x, depth)) for i, x in enumerate(w))
        out.append((d, held[d], len(w), sum(counts[0][(x,)] > 0 for x in w), total, base, score))
    return sorted(out)


def contaminated(rows, items, window=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for i, t in items:
        w = cut.findall((t or "").translate(LOWER))
        for k in range(max(len(w) - window, 0) + 1) if w else ():
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, ids = cut.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    hit.update(range(k, k + m))
                    ids |= wins[tuple(w[k : k + m])]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)
