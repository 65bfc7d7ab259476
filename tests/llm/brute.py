"""Plain code that the operators are held against."""

import hashlib
import re

import numpy as np


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def components(docs, words=5, percent=80):
    """doc_id: (n_shingles, component_id), from all pairs."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    u, v = sorted((root(a), root(b)))
                    up[v] = u
    return {d: (len(s), root(d)) for d, s in sets.items()}


def contamination(docs, items, window=13):
    """doc_id: (n_words, n_hit, n_items, items_sha256, contaminated), by plain search."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            ways = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in ways:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, window=50):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256), by a table of all windows."""
    first = {}
    raws = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raws):
        for i in range(len(raws[d]) - window + 1):
            first.setdefault(raws[d][i : i + window], d)
    out = {}
    for d, raw in raws.items():
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < d:
                gone[i] += 1
                gone[i + window] -= 1
        off = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~off])
        spans = int((off & ~np.concatenate([[False], off[:-1]])).sum()) if len(off) else 0
        out[d] = (len(raw), int(off.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def secret_spans(text):
    """Base spans by the contract's own patterns."""
    assign = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def personal_spans(text):
    def luhn(digits):
        double = [int(d) * 2 for d in digits[-2::-2]]
        return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in double)) % 10 == 0

    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]


def field_odds(node, edges, strength):
    """Log odds of each node by all labellings."""
    n = len(node)
    total = np.zeros((n, 2))
    for k in range(1 << n):
        label = [(k >> i) & 1 for i in range(n)]
        weight = np.exp(sum(x for x, on in zip(node, label) if on) + sum(s for (a, b), s in zip(edges, strength) if label[a] == label[b]))
        for i, on in enumerate(label):
            total[i, on] += weight
    return np.log(total[:, 1] / total[:, 0])
