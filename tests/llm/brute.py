"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def contamination(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def sentences(text):
    out, now = [], []
    for line in (text or "").split("\n"):
        for w in words(line):
            now.append(w)
            if w[-1] in ".!?":
                out.append(now)
                now = []
        if now:
            out.append(now)
            now = []
    return out


def repeated_spans(docs, least=3, enough=40):
    """Numbers of removed sentences by document: all runs of `least` sentences or more, and of two with `enough` words, whatever
    their length, that stand earlier too. docs in the order of their ids."""
    first, gone = {}, {}
    for d, t in docs:
        s, gone[d] = sentences(t), set()
        for i in range(len(s)):
            for j in range(i + 2, min(i + 6, len(s)) + 1):  # a longer run is covered by these
                if j - i >= least or sum(map(len, s[i:j])) >= enough:
                    if first.setdefault(tuple(w for x in s[i:j] for w in x), (d, i)) != (d, i):
                        gone[d].update(range(i, j))
    return {d: sorted(x) for d, x in gone.items()}


def shingles(text, n=3):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs, n=3, percent=90):
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def removed_lines(docs, least=20):
    first = {}
    for d, t in docs:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if re.search(r"[^\x09-\x0D\x20]", line):
                first.setdefault(line, (d, p))
    long = [x for x in first if len(x) >= least]
    near = {b for b in long for a in long if first[a] < first[b] and distance_one(a, b)}
    out = {}
    for d, t in docs:
        lines = t.split("\n") if t is not None else []
        out[d] = [p for p, x in enumerate(lines) if x in first and (x in near or first[x] != (d, p))]
    return out


def unigram(docs):
    train = [t for d, t in docs if crc(d, 7) != 2]
    c = collections.Counter(w for t in train for w in words(t))
    c["\n"] = len(train)
    n, v = sum(c.values()), sum(1 for x in c.values() if x)
    out = {}
    for d, t in docs:
        w = [*words(t), "\n"]
        out[d] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        v = int(x) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(v) <= 255 for v in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def ppm_bits(samples, text, order=3):
    """The code length of a text after training on the samples: escapes of method C, by dictionaries."""

    def fold(t):
        return re.sub(rb"[0-9]", b"0", re.sub(rb"[\x09-\x0D]", b" ", lower(t).encode()))

    tree = collections.defaultdict(collections.Counter)
    for t in samples:
        b = b" " * order + fold(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                tree[b[i - k : i]][b[i]] += 1
    total, b = 0.0, b" " * order + fold(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = tree.get(b[i - k : i])
            if c:
                n = sum(c.values()) + len(c)
                if c[b[i]]:
                    total -= math.log2(c[b[i]] / n)
                    break
                total -= math.log2(len([x for x in c.values() if x]) / n)
        else:
            total += 8
    return total
