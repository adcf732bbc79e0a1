"""Plain versions of the operators for small tables, written from their contracts."""

import itertools
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def components(docs, percent=85, width=5):
    """docs: {id: text} -> {id: (n_shingles, component)}"""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    common = defaultdict(int)
    for ids in by_shingle.values():
        for pair in itertools.combinations(sorted(ids), 2):
            common[pair] += 1
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def kneser_ney(train, texts):
    """[(n_tokens, n_known, N, base, score)] of an interpolated modified Kneser-Ney bigram model."""
    import math
    from collections import Counter

    def toks(t):
        return [*words((t or "").translate(LOWER)), "</s>"]

    uni, pair = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        pair.update(zip(["<s>", *w[:-1]], w, strict=True))

    def disc(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        if min(n[:3]) == 0:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *[x if 0 < x < k else 0.5 for k, x in enumerate(d, 1)]]

    left, follow, context = Counter(), defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), c in pair.items():
        left[b] += 1
        follow[a][min(c, 3)] += 1
        context[a] += c
    big, small, v, n = disc(pair.values()), disc(left.values()), len(uni), sum(uni.values())
    types = len(pair)
    gamma = sum(small[min(c, 3)] for c in left.values()) / types if types else 1.0

    def p(a, b):
        q = max(left[b] - small[min(left[b], 3)], 0) / max(types, 1) + gamma / (v + 1)
        if not context[a]:
            return q
        c = pair[a, b]
        mass = sum(big[k] * follow[a][k] for k in (1, 2, 3))
        return max(c - big[min(c, 3)], 0) / context[a] + mass / context[a] * q

    out = []
    for t in texts:
        w = toks(t)
        out.append((
            len(w), sum(uni[x] > 0 for x in w), n,
            sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w),
            sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)),
        ))
    return out, p, uni


def repeats(docs, length=100):
    """{id: text} -> {id: (n_bytes, n_removed, n_spans, kept)}"""
    first, raw, out = {}, {i: (t or "").encode() for i, t in docs.items()}, {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][k : k + length], (i, k))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (i, k):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(text):
    """Base spans (start, kind number, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(d)))
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)
