"""Personal data: patterns for the plain kinds, and a skip-chain conditional random field for names near them.

The field has a label (name or other) for each token. Neighbours share a chain potential; all mentions of a capitalised
token share a skip potential with one hidden node, however far apart they are, so edges stay linear. That node takes
over what speaks for or against a name at its mentions: once one of them leans to `name`, the disjunction of their
features, else the best of them; what chains tell it counts as their mean. So mentions without a cue don't outvote
one. Tokens alike in their first letters are tied more weakly,
by these nodes. Loopy message passing makes labels agree across the document, so a name that a cue gives away once is
found wherever it returns. A token found more often in lower case than capitalised is no name by its hidden node: it
has a skip edge to its previous mention only, as one cue before "The" would else label each. Its node weights are trained here on generated sentences; it runs on documents that hold a cue, as without
one no node leans to `name` and the outcome is known.

Defined results: a null text counts as empty and has no span; failing matches are dropped without another try inside
them; a document of any length takes time in proportion to its tokens; spans that begin together go by kind, base kinds
first; repeated rows each give theirs; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from tributary.llm.spans import IS_DIGIT, Span, lowered, scan, texts_with, texts_with_run

BASE = ("email", "ip", "card", "phone")
ADDED = ("name",)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outward: the text before it is read once, not from every start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the field ---

TOKEN = re.compile(r"[^\W\d_]+")
OPENS = re.compile(r"[.!?\n]")
# Words that announce a person.
CUES = frozenset("name named contact mr mrs ms dr prof attn signed sincerely regards".split())
CUE_NEEDLES = [w.encode() for w in sorted(CUES)]
CHAIN, SKIP_SAME, SKIP_ALIKE = 0.6, 1.6, 0.8
#: Between a mention and its token's hidden node: beyond what any chain can tell a mention.
TIE = 12.0
ROUNDS = 8


def features(words: list[str], starts_sentence: list[bool], near: list[bool], in_address: list[bool]) -> np.ndarray:
    """Per token: bias, capitalised, capitalised within a sentence, after a cue, near personal data, in an e-mail's name."""
    cap = np.array([w[:1].isupper() and w[1:].islower() for w in words], float)
    inner = cap * ~np.array(starts_sentence, bool)
    low = [w.lower() for w in words]
    cue = np.array([any(low[j] in CUES for j in range(max(0, i - 2), i)) and low[i] not in CUES for i in range(len(words))], float)
    return np.stack([np.ones(len(words)), cap, inner, cue * cap, np.array(near, float) * cap, np.array(in_address, float) * cap], 1)


def _generated() -> tuple[np.ndarray, np.ndarray]:
    """Sentences with and without a person, made by rule, in which names are known."""
    firsts, lasts = "Anna Boris Carla Deniz Emil Farah".split(), "Novak Okoye Perez Quist Rossi Sato".split()
    ways = ("contact {f} {l} at", "name {f} {l} phone", "Dr {f} {l} wrote that", "signed {f} {l} of the office", "when {f} {l} came to the town")
    rest = ("The house of the Old town was open", "In Spring the River ran high", "We saw that London is large", "Contact us for more of the Latest news", "The name of the Game is Chess")
    xs, ys = [], []
    for i, f in enumerate(firsts):
        for j, last in enumerate(lasts):
            for k, way in enumerate(ways):
                words = way.format(f=f, l=last).split()
                is_name = [w in (f, last) for w in words]
                near = [n and (i + j + k) % 2 == 0 for n in is_name]
                address = [n and (i + k) % 3 == 0 for n in is_name]
                xs.append(features(words, [q == 0 for q in range(len(words))], near, address))
                ys.append(np.array(is_name, float))
        for way in rest:
            words = way.split()
            xs.append(features(words, [q == 0 for q in range(len(words))], [False] * len(words), [False] * len(words)))
            ys.append(np.zeros(len(words)))
    return np.concatenate(xs), np.concatenate(ys)


@cache
def weights() -> np.ndarray:
    """Node weights of greatest penalised pseudo-likelihood, by Newton steps."""
    x, y = _generated()
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
    return w


def pass_messages(node: np.ndarray, edges: np.ndarray, strength: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log odds of `name` at each node after loopy sum-product rounds over edges (m, 2) that favour equal labels; share:
    what a message to the second node of an edge counts for there."""
    if not len(edges):
        return node
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    t = np.tanh(np.concatenate([strength, strength]) / 2)
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros(2 * m)
    counts = np.concatenate([share, np.ones(m)])
    for _ in range(ROUNDS):
        belief = node + np.bincount(b, counts * message, len(node))
        into = belief[a] - (counts * message)[back]
        new = 2 * np.arctanh(np.clip(t * np.tanh(np.clip(into, -20, 20) / 2), -0.999999, 0.999999))
        message = 0.5 * message + 0.5 * new
    return node + np.bincount(b, counts * message, len(node))


def names(text: str, base: list[Span]) -> list[Span]:
    words, opens, places = [], [], array("q")
    same: dict[str, str] = {}  # a word that returns is held once
    before = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        words.append(same.setdefault(m[0], m[0]))
        opens.append(not before or OPENS.search(text, before, a) is not None)
        places.extend((a, b))
        before = b
    if not words:
        return []
    at, end = np.array(places).reshape(-1, 2).T
    near, address, covered = np.zeros(len(words), bool), np.zeros(len(words), bool), np.zeros(len(words), bool)
    parts: set[str] = set()
    firsts = np.searchsorted(at, [a for _, a, _ in base]).tolist()
    inside = np.searchsorted(end, [a for _, a, _ in base], "right").tolist()
    behind = np.searchsorted(at, [b for _, _, b in base]).tolist()
    for (kind, a, _), k, lo, hi in zip(base, firsts, inside, behind):
        covered[lo:hi] = True
        near[max(0, k - 3) : k] = True
        if kind == "email":
            parts.update(p for p in re.split(r"[^a-z]+", text[a : text.index("@", a)].lower()) if len(p) > 2)
    if parts:
        address = np.array([w.lower() in parts for w in words])
    seen = features(words, opens, list(near), list(address))
    node = seen @ weights()
    node[covered] = -20
    if not (node > 0).any():
        return []
    cap = [w[:1].isupper() and w[1:].islower() and not c for w, c in zip(words, covered)]
    edges, strength, share = [], [], []

    def tie(a: int, b: int, with_: float, counts: float = 1.0) -> None:
        edges.append((a, b))
        strength.append(with_)
        share.append(counts)

    mentions: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if cap[i]:
            if i and cap[i - 1] and not opens[i]:
                tie(i - 1, i, CHAIN)
            mentions.setdefault(w, []).append(i)
    lower = Counter(w for w in words if w.islower())
    hidden: list[float] = []
    like: dict[str, int] = {}
    for w, at_ in mentions.items():
        if lower[w.lower()] > len(at_):
            for i, j in zip(at_, at_[1:]):
                tie(i, j, SKIP_SAME)
            own = at_[0]
        elif len(at_) > 1:
            own = len(words) + len(hidden)
            best = float(node[at_].max())
            hidden.append(float(seen[at_].max(0) @ weights()) if best > 0 else best)
            node[at_] = 0
            for i in at_:
                tie(i, own, TIE, 1 / len(at_))
        else:
            own = at_[0]
        if len(w) >= 6 and (first := like.setdefault(w[:4], own)) != own:
            tie(first, own, SKIP_ALIKE)
    odds = pass_messages(np.append(node, hidden), np.array(edges, np.int64).reshape(-1, 2), np.array(strength), np.array(share))[: len(words)]
    out: list[Span] = []
    for i in np.flatnonzero(odds > 0):
        if out and i and odds[i - 1] > 0 and out[-1][2] == end[i - 1] and text[end[i - 1] : at[i]].isspace():
            out[-1] = ("name", out[-1][1], int(end[i]))
        else:
            out.append(("name", int(at[i]), int(end[i])))
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    cued = any(m.group().lower() in CUES for m in TOKEN.finditer(text)) if not base else True
    return base, names(text, base) if cued else []


def chosen(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return texts_with(lowered(data), starts, [b"@", *CUE_NEEDLES]) | texts_with_run(IS_DIGIT[data], starts, 1)


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    return scan(docs, chosen, find, BASE, ADDED)
