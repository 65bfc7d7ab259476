"""Vector codes, language identification and fill-in-middle against plain code, on odd rows as well."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tributary.llm import codes, infill, language

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, vector string"


def vectors(spark, rows):
    """Vectors with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, x, "c", 1, "v") for i, v, x in rows], VECTORS)


def plain_codes(rows, rounds=2, parts=16, entries=64):
    """By full scans over integers, in order of index."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], x_) for i, v, x_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = {}
    for i, v, _ in kept:
        seeds[i] = min(seeds.get(i, v), v)
    first = [seeds[i] for i in sorted(seeds, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def pick(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                groups[p][pick(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else books[p][k] for k, g in enumerate(groups[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        found = [pick(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    return sorted((str(i), c, e, by_label[label], sha) for i, label, c, e in out)


def test_codes(spark):
    rng = np.random.default_rng(3)
    coarse = lambda: [float(x) for x in rng.integers(-3, 4, 32) / 256]  # noqa: E731 (many equal distances)
    rows = [(i, coarse(), [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, coarse(), None), (200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, 1), (203, [math.inf] + [0.0] * 31, 2), (204, [], 1)]
    rng.shuffle(rows)
    rows = [(None if i is None else int(i), v, None if x is None else int(x)) for i, v, x in rows]
    want = plain_codes(rows)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.report(vectors(spark, rows)).collect())
    assert got == want


def test_codes_of_odd_tables(spark):
    assert codes.report(vectors(spark, [])).collect() == []
    assert codes.report(vectors(spark, [(1, None, 1), (2, [math.nan], 1)])).collect() == []
    rows = [(i, [float(i + k) for k in range(20)], 1) for i in range(5)] + [(9, [1.0] * 16, 1)]  # another length; 20 isn't 16 * n
    got = codes.report(vectors(spark, rows)).collect()
    assert sorted(r["vec_id"] for r in got) == [0, 1, 2, 3, 4] and all(r["error"] == 0 for r in got)
    huge = codes.report(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])).collect()
    assert [r["error"] for r in huge] == [0, 0]


def test_nearest_visits_equal_bounds():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 64, 200):
        book = rng.integers(-4, 5, (n, 3))
        points = rng.integers(-6, 7, (500, 3))
        apart = ((points[:, None] - book[None]) ** 2).sum(2)
        index, best = codes.nearest(book, codes.tree(book), points)
        assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_a_kd_tree_prunes():
    rng = np.random.default_rng(2)
    book = rng.integers(-1000, 1000, (64, 2))
    root = codes.tree(book)

    def leaves(node):
        return [node] if node.children is None else [x for c in node.children for x in leaves(c)]

    assert sorted(np.concatenate([x.entries for x in leaves(root)])) == list(range(64)) and max(len(x.entries) for x in leaves(root)) <= codes.LEAF
    assert all((book[x.entries] >= x.low).all() and (book[x.entries] <= x.high).all() for x in leaves(root))


WORDS = {"en": "the of and with that this from which have been", "fr": "le les des dans avec pour qui être c'était où", "xx": "ζη και το της είναι από με για που στο"}


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((seed * 10_000 + i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(3, 200))), lang))
    return out


DOCS = "doc_id long, text string, lang string, score double, lang_pred string, lot string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, x, 0.0, "l", "l") for d, t, x in rows], DOCS)


def test_language(spark):
    rows = labelled(260, 1)
    odd = [(1, None, "en"), (2, "", "fr"), (3, " 12 -- 3!\n", "en"), (None, "le les des dans", None), (4, "the of and with " * 20_000, None), (5, "ζη", None), (5, "ζη", None)]
    got = {}
    for r in language.identify(documents(spark, [*rows, *odd])).collect():
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["held_out"]))
    held = [(got[d][0][0], x) for d, _, x in rows if got[d][0][2]]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[d][0][:2] for d in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[None][0][0] == "fr" and got[4][0][0] == "en" and len(got[5]) == 2 and got[5][0] == got[5][1]


def test_language_without_labels(spark):
    got = language.identify(documents(spark, [(i, "the of and", None) for i in range(9)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language.identify(documents(spark, [])).collect() == []
    one = language.identify(documents(spark, [(i, "the of and", "en") for i in range(9)])).collect()
    assert {r["lang_pred"] for r in one} == {"en"} and all(r["score"] == pytest.approx(1) for r in one)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = labelled(200, 2)
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    other = [(d, t, "zz" if held(d) else x) for d, t, x in rows]
    a, b = (sorted((r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in language.identify(documents(spark, x)).collect()) for x in (rows, other))
    assert a == b


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    net = language.fit([b"the of and", b"le les des", bytes(range(128))], ["en", "fr", "zz"], epochs=1)
    windows = np.full((4, language.WINDOW), language.PAD, np.int64)
    windows[:, :90] = rng.integers(0, 256, (4, 90))
    windows[2, 3:] = language.PAD
    truth = np.array([0, 1, 2, 1])
    names = ("embed", "kernel", "bias", "top", "top_bias")
    for n in names:
        setattr(net, n, getattr(net, n).astype(np.float64))
    found, _ = language.gradients(net, windows, truth)
    for name, grad in zip(names, found):
        value = getattr(net, name)
        for at in zip(*(x[np.argsort(-np.abs(grad[np.nonzero(grad)]))[:5]] for x in np.nonzero(grad))):
            keep, losses = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = keep + step
                losses.append(language.gradients(net, windows, truth)[1])
            value[at] = keep
            assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-6, rel=1e-3, abs=1e-6)


def test_windows_cover_texts():
    starts = np.array([0, 0, 5, 300, 424, 548, 548 + 129])
    text, begin, end = language.windows_of(starts)
    for i, (a, b) in enumerate(zip(starts, starts[1:])):
        own = [(x, y) for t, x, y in zip(text, begin, end) if t == i]
        assert own[0][0] == a and own[-1][1] == b and all(y - x <= language.WINDOW for x, y in own)
        assert all(p[1] - q[0] == max(language.WIDTHS) - 1 for p, q in zip(own, own[1:]))


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_infill(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ab<>PSM \né𝄞", k=rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "text"), (1000, None), (1001, ""), (1002, "x<P>y"), (1003, "é" * 300_000), (1004, "<<P"), (7, rows[7][1])]
    docs = spark.createDataFrame([(d, t, 3, "plain", "o", "r") for d, t in rows], "doc_id long, text string, n int, form string, output string, restored string")
    made = infill.restore(infill.fill_in_middle(docs))
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["restored"]) for r in made.collect())
    want = []
    for d, t in rows:
        n, form, a, b, out = plain_infill(d, t)
        want.append((str(d), n, form, str(a), str(b), out, t or ""))
    assert got == sorted(want) and {"plain", "psm", "spm"} == {g[2] for g in got}
    assert infill.report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["char", "line", "word"])
def test_units(unit):
    import re

    whole = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]+|[^ \t-\r]+"}[unit]
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("ab<P>S \n\té", k=rng.randint(0, 30)))
        ends = [0, *(m.end() for m in re.finditer(whole, text))]
        found = infill.units(text, unit)
        assert found.n == len(ends) - 1 and [found.end(r) for r in range(found.n + 1)] == ends
        assert [k for k, _ in found.sentinels] == [m.start() for m in re.finditer("<[PSM]>", text)]


def test_infill_by_words_and_lines(spark):
    docs = spark.createDataFrame([(i, f"one two\nthree  {i}\n\nlast") for i in range(60)], "doc_id long, text string")
    for unit in ("line", "word"):
        for r in infill.restore(infill.fill_in_middle(docs, unit=unit, changed=100)).collect():
            assert r["restored"] == r["text"] and r["form"] != "plain" and r["n"] == (4 if unit == "line" else 9)
            cut = {0, len(r["text"]), *(k for k in range(1, len(r["text"])) if (r["text"][k - 1] == "\n" if unit == "line" else r["text"][k - 1].isspace() != r["text"][k].isspace()))}
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= cut
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, unit="page")
