"""Secret scans: patterns for the plain kinds, and a guess-cost model for values in credential contexts.

The guess cost of a value is the least log10 number of guesses over all ways to cut it into words, dates, repeats,
keyboard walks, sequences and brute-force spans, found by dynamic programming over its positions. A value in a
credential context that costs GUESS_COST or more, and that no base span covers, is added as a `guess` span.

Defined results: a null text counts as empty and has no span; failing matches are dropped without another try inside
them; costs of values of any length take time in proportion to
the length, and eight bytes a letter; spans that begin together go by kind, base
kinds first; repeated rows each give theirs; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tributary.llm.spans import IS_HEX, Span, either_case, lowered, scan, texts_with, texts_with_run

BASE = ("assign", "access", "hex")
ADDED = ("guess",)
#: log10 of guesses from which a value counts as a secret: beyond what an attacker tries online.
GUESS_COST = 8.0

_KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({_KEYWORDS}|{either_case("api")}_?{either_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the runs of [A-Z0-9] that reach 16 with AKIA
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as shorter ones fail
_CONTEXT = "|".join(either_case(w) for w in ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "bearer", "authorization"))
CONTEXT = re.compile(rf"""(?:{_CONTEXT}|{either_case("api")}_?{either_case("key")})["']?\x20*(?:[:=]|\x20{either_case("is")}\x20)\x20*["']?([^\s"'<>,;]+)""")
IN_ADDRESS = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
_NEEDLES = [b"password", b"passwd", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"credential", b"bearer", b"authorization", b"apikey", b"api_key", b"akia"]

# Common parts of passwords, by rank.
WORDS = (
    "password pass word admin login welcome secret master dragon monkey letmein shadow sunshine princess football baseball "
    "superman batman trust love hello freedom whatever michael jordan hunter summer winter spring autumn january february "
    "march april june july august september october november december monday friday sunday test testing guest user root "
    "default changeme temp demo server system oracle mysql linux windows google apple github token key api prod dev "
    "example company secure private access internet computer money star angel flower coffee orange banana blue green "
    "red black white gold silver tiger lion eagle house home family happy lucky magic ninja pirate soccer hockey"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT: dict[str, set[str]] = {}
for _r, _row in enumerate(ROWS):
    for _i, _c in enumerate(_row):
        _near = {_row[j] for j in (_i - 1, _i + 1) if 0 <= j < len(_row)}
        for _s in (_r - 1, _r + 1):
            if 0 <= _s < len(ROWS):
                _near |= {ROWS[_s][j] for j in (_i - 1, _i, _i + 1) if 0 <= j < len(ROWS[_s])}
        _NEXT[_c] = _near
#: Forms of dates, each with its log10 guesses: a year of some 120, or a day of one.
DATES = tuple(
    (re.compile(form), math.log10(n))
    for form, n in (
        (r"(?:19|20)\d\d", 120.0),
        (r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])", 120.0 * 365),
        (r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", 120.0 * 365),
        (r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?\d\d", 120.0 * 365),
    )
)
#: Letters that a repeat's unit has at most, and repetitions up to which every number of them is offered.
UNIT, REPEATS = 4, 16
WALK, WALK_STEP, LINK = math.log10(47 * 3), 0.35, 0.3


def word_cost(part: str) -> float | None:
    """log10 guesses of a known word, more if letters are swapped for digits or cases are odd."""
    low = part.lower()
    plain = low.translate(LEET)
    rank = RANK.get(low) or RANK.get(plain)
    return None if rank is None else math.log10(rank + 1) + (low != plain) + (part not in (low, low.capitalize()))


def repeat_cost(unit: int, times: int) -> float:
    return unit * 1.2 + math.log10(times)


#: The cost of a repeat by unit and times, with its link.
_REPEATS = [[LINK + repeat_cost(unit, max(times, 1)) for times in range(REPEATS + 1)] for unit in range(UNIT + 1)]


@cache
def _words() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for w in WORDS:
        made.add_word(w, len(w))
    made.make_automaton()
    return made


def _parts(s: str) -> Iterator[list[tuple[int, float]]]:
    """For each place but the first, the words, dates and sequences that end there: where they begin, log10 guesses. What is
    held is what can still end: a few parts of a few letters."""
    n, low = len(s), s.lower()
    low = low if len(low) == n else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    found = [_words().iter(low), _words().iter(low.translate(LEET))]
    heads = [next(f, None) for f in found]
    due: dict[int, list[tuple[int, float]]] = {}  # dates by their end
    run = way = 0
    for j in range(1, n + 1):
        out = due.pop(j, [])
        words = set()
        for k in (0, 1):
            while heads[k] is not None and heads[k][0] < j:
                words.add(heads[k][1])
                heads[k] = next(found[k], None)
        for size in words:
            if size >= 3 and (cost := word_cost(s[j - size : j])) is not None:
                out.append((j - size, cost))
        if j > 1:
            step = ord(low[j - 1]) - ord(low[j - 2])
            known = abs(step) == 1 and low[j - 1].isascii() and low[j - 2].isascii() and low[j - 1].isalnum() and low[j - 2].isalnum()
            run = (run + 1 if step == way else 1) if known else 0
            way = step
            for k in range(3, run + 2):  # 26 letters at most
                out.append((j - k, 1.0 + math.log10(k)))
        yield out
        if j < n and s[j].isdigit():  # dates that begin here end later
            for form, cost in DATES:
                if m := form.match(s, j):
                    due.setdefault(m.end(), []).append((j, cost))
        if j == 1 and s[0].isdigit():
            for form, cost in DATES:
                if m := form.match(s):
                    due.setdefault(m.end(), []).append((0, cost))


def guess_cost(s: str) -> float:
    """log10 of the guesses that the cheapest segmentation of s takes; each further segment doubles the work.

    Of repeats all up to REPEATS times and the longest are offered; deep in a run of one letter the letter's own alone, as
    longer units are dearer there."""
    n, low = len(s), s.lower()
    same = [0] * (UNIT + 1)  # how far back from here each letter equals the one a unit before it
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    wide = {c: math.log10(next((k for test, k in kinds if c.isascii() and test(c)), 33)) for c in set(s)}
    best = array("d", [0.0])
    brute = walk = before = math.inf  # the cheapest way whose last segment is a brute-force span, or a walk, still open here
    near = 0
    for i, ending in enumerate(_parts(s), 1):
        brute = min(brute, best[i - 1] + (LINK if i > 1 else 0.0)) + wide[s[i - 1]]
        near = near + 1 if i > 1 and low[i - 1] in _NEXT.get(low[i - 2], ()) else 0
        walk = min(before + WALK_STEP, best[i - 3] + (LINK if i > 3 else 0.0) + WALK + 3 * WALK_STEP) if near >= 2 else math.inf
        before = walk
        least = min(brute, walk)
        for a, cost in ending:
            cost += best[a] + (LINK if a else 0.0)
            if cost < least:
                least = cost
        for unit in range(1, min(UNIT, i - 1) + 1):
            if s[i - 1] != s[i - 1 - unit]:
                same[unit] = 0
                continue
            same[unit] += 1
            most = same[unit] // unit + 1
            if most < 2 or unit > 1 and same[1] > UNIT * REPEATS:
                continue
            costs = _REPEATS[unit]
            for times in range(2, min(most, REPEATS) + 1):
                a = i - unit * times
                cost = best[a] + costs[times] if a else costs[times] - LINK
                if cost < least:
                    least = cost
            if most > REPEATS:
                a = i - unit * most
                least = min(least, best[a] + (LINK if a else 0.0) + repeat_cost(unit, most))
        best.append(least)
    return best[n]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the guess-cost model adds, by code points."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    starts = sorted((x, y) for _, x, y in base)
    reach = list(accumulate((y for _, y in starts), max))  # how far the spans up to each one reach
    added: dict[Span, None] = {}
    for pattern in (CONTEXT, IN_ADDRESS):
        for m in pattern.finditer(text):
            a, b = m.span(1)
            k = bisect_left(starts, (b, -1))
            if not (k and reach[k - 1] > a) and ("guess", a, b) not in added and guess_cost(m[1]) >= GUESS_COST:
                added["guess", a, b] = None
    return base, list(added)


def chosen(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return texts_with(lowered(data), starts, _NEEDLES) | texts_with(data.tobytes(), starts, [b"://"]) | texts_with_run(IS_HEX[data], starts, 32)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    return scan(docs, chosen, find, BASE, ADDED)
