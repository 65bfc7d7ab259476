"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

A word's kernel features are its letter triples in order, of span SPAN at most, weighted DECAY**span, so that inserted
or left-out letters dim a match but don't end it; word ends count as letters. Words are learnt from labelled documents
as bags: words that toxic documents hold far more often than clean ones are positive, words of clean documents are
negative, hard ones first. Near copies among the labelled documents, told by their least shingle hashes, count once, else
whatever they repeat would look telling. Kernel values against landmark words,
whitened by the landmarks' own kernel, feed a linear machine with squared hinge loss. As the kernel is a product of
explicit features, the machine folds back into one weight per triple, which is what is broadcast (1 MB, whatever the
data). A document's score is a logistic function of its words' margins.

The classifier learns from a bounded sample of labelled rows (SAMPLE of each class, in order of a hash of doc_id);
everything else reads all rows and whole texts.

Defined results: a null or empty text gets the score of a document without words; documents with equal texts get equal
scores; without labels of both classes all scores are 0; null labels are left out, of contradicting labels of one
document the toxic one holds; a null doc_id counts as the empty text in the hold-out rule; an empty table gives an
empty result; other columns play no part, and clean_documents returns them as they are, toxicity_score included.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import IS_SPACE, bytes_of, columns, give_back, runs, slices

#: Labelled documents that the classifier learns from at most: toxic, clean.
SAMPLE = (1200, 4800)
THRESHOLD = 0.7
LANDMARKS = 128
#: Times that words of clean documents which the machine gets wrong are added to what it learns from, at most.
TURNS = 4
SPAN, DECAY = 6, 0.7
LENGTH = 26
#: Shingle hashes of a labelled document that near copies are told by.
SKETCH = 32
CACHE_WORDS = 200_000
#: Bytes of text whose words are held at once.
SLICE = 1 << 20

_GAPS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]
_LEET = str.maketrans("013457@$", "oieastas")
_CODES = np.zeros(0x250, np.int64)
for _c in range(0x250):
    if chr(_c).isalpha():
        _CODES[_c] = _c - 96 if 97 <= _c <= 122 else 27 + (_c * 7) % 33
OPEN, CLOSE = 62, 63
FEATURES = 64**3


_THRICE = re.compile(r"(.)\1{2,}")


def plain_word(word: str) -> str:
    """Letters alone; digits that stand for letters become them, thrice repeated letters two."""
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = word.translate(_LEET)
        word = "".join(c for c in word if c.isalpha())
    return _THRICE.sub(r"\1\1", word)


def spaced_out(words: list[str]) -> list[str]:
    """Words written letter by letter, joined."""
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1 and w.isalnum():
            run.append(w)
        else:
            if len(run) > 3:
                out.append("".join(run))
            run = []
    return out


def coded(words: list[str]) -> np.ndarray:
    """Letter codes of each word between its end marks, padded with 0. Words are at most LENGTH - 2 long."""
    most = LENGTH - 2
    points = np.array(words, f"U{most}").view(np.uint32).reshape(len(words), most).astype(np.int64)
    out = np.zeros((len(words), LENGTH), np.int64)
    out[:, 0] = OPEN
    out[:, 1:-1] = np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], 27 + points % 33)
    out[np.arange(len(words)), (points > 0).sum(1) + 1] = CLOSE
    return out


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Feature numbers, which of them exist, and their weight, for each pair of gaps."""
    for a, b, weight in _GAPS:
        x, y, z = codes[:, :-b], codes[:, a : LENGTH - b + a], codes[:, b:]
        yield (x * 64 + y) * 64 + z, z > 0, weight


def norms(codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for _, there, weight in triples(codes):
        total += weight * weight * there.sum(1)
    return np.sqrt(np.maximum(total, 1e-12))


def folded_margin(codes: np.ndarray, fold: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(codes))
    for ids, there, weight in triples(codes):
        total += weight * (fold[ids] * there).sum(1)
    return total / norms(codes) + bias


@dataclass
class Model:
    fold: np.ndarray
    bias: float
    top: np.ndarray  # of a document: intercept, best margin (what is beyond 0.6 tells no more), log of summed high margins

    def parts(self, word: str) -> list[str]:
        """A long word in pieces that overlap by half."""
        most = LENGTH - 2
        return [word] if len(word) <= most else [word[i : i + most] for i in range(0, len(word) - most // 2, most // 2)]

    def margins(self, words: list[str]) -> list[float]:
        """The margin of each raw word; -2 for what holds no word of two letters."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            if len(p := plain_word(w)) > 1:
                for x in self.parts(p):
                    pieces.append(x)
                    owner.append(i)
        out = np.full(len(words), -2.0)
        for k in range(0, len(pieces), 8000):
            np.maximum.at(out, owner[k : k + 8000], folded_margin(coded(pieces[k : k + 8000]), self.fold, self.bias))
        return out.tolist()

    @staticmethod
    def traits(best: np.ndarray, mass: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(best)), 5 * np.clip(best, -0.6, 0.6), 0.3 * np.log1p(mass)], 1)

    def score(self, best: np.ndarray, mass: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.traits(best, mass) @ self.top, -30, 30)))


def document_words(text: str, look: bool) -> set[str]:
    words = text.lower().split()
    found = set(words)
    if look:
        found.update(spaced_out(words))
    return found


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, hinge: bool, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights that minimise squared hinge loss (y of 1 and -1) or logistic loss (y of 1 and 0) with a ridge."""
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(len(w))
    eye[0, 0] = 1e-6
    for _ in range(steps):
        s = x @ w
        if hinge:
            on = y * s < 1
            grad = x[on].T @ (cost[on] * (s[on] - y[on])) + eye @ w
            curve = (x[on] * cost[on, None]).T @ x[on] + eye
        else:
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            grad = x.T @ (cost * (p - y)) + eye @ w
            curve = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + eye
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Landmarks:
    """Nystroem features of words: kernel values against landmark words, whitened."""

    def __init__(self, words: list[str]):
        codes = coded(words)
        size = norms(codes)
        used = np.unique(np.concatenate([ids[there] for ids, there, _ in triples(codes)]))
        self.row = np.full(FEATURES, len(used), np.int64)
        self.row[used] = np.arange(len(used))
        self.used = used
        self.phi = np.zeros((len(used) + 1, len(words)), np.float32)
        for ids, there, weight in triples(codes):
            for i in range(len(words)):
                np.add.at(self.phi[:, i], self.row[ids[i][there[i]]], weight / size[i])
        values, vectors = np.linalg.eigh(self.phi.T @ self.phi)
        keep = values > 1e-6 * values.max()
        self.white = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, words: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(words), 2000):
            codes = coded(words[k : k + 2000])
            total = np.zeros((len(codes), self.phi.shape[1]), np.float32)
            for ids, there, weight in triples(codes):
                rows = np.where(there, self.row[ids], len(self.used))
                for j in range(rows.shape[1]):
                    total += np.float32(weight) * self.phi[rows[:, j]]
            out.append((total / norms(codes)[:, None]) @ self.white)
        return np.concatenate(out) if out else np.zeros((0, self.white.shape[1]))

    def fold(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[self.used] = (self.phi @ (self.white @ w))[:-1]
        return out


def fit(bags: list[list[str]], toxic: np.ndarray, sketches: list[list[int]] | None = None) -> Model | None:
    """bags: the raw words of each labelled document; sketches: what near copies are told by."""
    if len(bags) == 0 or not toxic.any() or toxic.all():
        return None
    blank = Model(np.zeros(FEATURES), 0.0, np.zeros(3))
    number: dict[str, int] = {}
    pieces: dict[str, list[int]] = {}
    plain = []
    for bag in bags:
        ids: list[int] = []
        for w in bag:
            if w not in pieces:
                p = plain_word(w)
                pieces[w] = [number.setdefault(x, len(number)) for x in blank.parts(p)] if len(p) > 1 else []
            ids += pieces[w]
        plain.append(np.unique(np.array(ids, np.int64)))
    del pieces
    words = list(number)
    order = np.array([zlib.crc32(w.encode()) for w in words], np.int64)  # a fixed order that spelling doesn't show
    if sketches is not None:
        own = first_of_copies(sketches)
        plain, toxic = [plain[i] for i in own], toxic[own]
    n_t, n_c = int(toxic.sum()), int((~toxic).sum())
    if not n_t or not n_c:
        return None
    none = [np.zeros(0, np.int64)]
    held = np.bincount(np.concatenate([p for p, t in zip(plain, toxic) if t] + none), minlength=len(words))
    clean = np.bincount(np.concatenate([p for p, t in zip(plain, toxic) if not t] + none), minlength=len(words))
    share = n_t / (n_t + n_c)
    lift = ((held + 0.1) / n_t) / ((clean + 0.5) / n_c)
    with np.errstate(divide="ignore", invalid="ignore"):  # twice the log likelihood ratio of a word's toxic share
        both = held + clean
        surprise = 2 * (np.where(held, held * np.log(held / (both * share)), 0) + np.where(clean, clean * np.log(clean / (both * (1 - share))), 0))
    # of a large sample more is asked, as words that pass by chance grow with its vocabulary
    positive = np.flatnonzero((held >= 3) & (lift >= 15) & (surprise >= 25 * max(1, n_t / 600)))
    positive = positive[np.lexsort((order[positive], -held[positive]))][:600]
    if not len(positive):
        positive = np.lexsort((order, -held, -lift))[:5]
    pool = np.flatnonzero((clean > 0) & (lift < 4))
    pool = np.setdiff1d(pool, positive)
    pool = pool[np.argsort(order[pool], kind="stable")]
    often = pool[np.argsort(-clean[pool], kind="stable")][:800]
    negative = list(dict.fromkeys([*often.tolist(), *pool[:2000].tolist()]))
    spelt = lambda ids: [words[i] for i in ids]
    mass = np.minimum(held[positive], 50).astype(float)
    for turn in range(TURNS):
        spread = positive[:: max(1, len(positive) * 2 // LANDMARKS)][: LANDMARKS // 2]
        chosen = dict.fromkeys([*positive[: LANDMARKS // 4].tolist(), *spread.tolist(), *negative[-(LANDMARKS // 4) :], *often[: LANDMARKS // 4].tolist()])
        marks = Landmarks(spelt(chosen))
        learnt = [*spelt(positive), *spelt(negative), *(bent := stretched(spelt(positive[:60])))]
        y = np.where((np.arange(len(learnt)) < len(positive)) | (np.arange(len(learnt)) >= len(positive) + len(negative)), 1.0, -1.0)
        x = np.concatenate([np.ones((len(learnt), 1)), marks.features(learnt)], 1)
        seen = 1 + np.log1p(clean[negative])
        cost = np.concatenate([mass / mass.sum() * max(1, seen.sum()), seen, np.full(len(bent), 0.5)])
        w = _newton(x, y, cost * 4, True, 1.0)
        model = Model(marks.fold(w[1:]), float(w[0]), np.zeros(3))
        if len(pool):
            margin = margins_of(spelt(pool), model)
            if turn and margin.max() < 0:  # no word of clean documents is on the wrong side
                break
            hard = pool[np.argsort(-margin, kind="stable")[:600]]
            negative = list(dict.fromkeys([*negative, *hard.tolist()]))
    margin = margins_of(words, model)
    rows = [summary(margin[p].tolist()) for p in plain]
    x = Model.traits(*(np.array(v, float) for v in zip(*rows)))
    model.top = _newton(x, toxic.astype(float), np.ones(len(x)), False, 0.05)
    return model


def margins_of(words: list[str], model: Model) -> np.ndarray:
    return np.concatenate([folded_margin(coded(words[k : k + 20_000]), model.fold, model.bias) for k in range(0, len(words), 20_000)])


def stretched(words: list[str]) -> list[str]:
    """Words with a letter put in, at each inner place in turn: what the kernel's gaps are for."""
    out = []
    for k, w in enumerate(words):
        if 5 <= len(w) < LENGTH - 3:
            out += [w[:i] + "xzqjkv"[(i + k) % 6] + w[i:] for i in range(1, len(w))]
    return out


def sketch(text: str) -> list[int]:
    """The SKETCH least hashes of a text's shingles of five words; of fewer words the text's own hash."""
    words = text.lower().split()
    hashes = {xxhash.xxh64_intdigest("\x00".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
    return sorted(hashes)[:SKETCH]


def first_of_copies(sketches: list[list[int]]) -> list[int]:
    """Texts that aren't near copies of an earlier one: an eighth of their least hashes were least there, too."""
    met: dict[int, int] = {}
    out = []
    for i, least in enumerate(sketches):
        if not least:
            continue
        with_earlier = Counter(met[h] for h in least if h in met)
        if with_earlier and with_earlier.most_common(1)[0][1] * 8 >= len(least):
            continue
        for h in least:
            met.setdefault(h, i)
        out.append(i)
    return out


def summary(margins: list[float]) -> tuple[float, float]:
    return (max(margins, default=-2.0), sum(m for m in margins if m > 0.5))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model | None:
    """Fits on the driver; the sample's ids are chosen from the labels alone and broadcast to read their texts."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    each = usable.groupBy("doc_id").agg((F.max("toxic") == 1).alias("is_toxic"))
    pick = lambda kind: each.filter(F.col("is_toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[0 if kind else 1])
    chosen = pick(True).unionByName(pick(False))
    read = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, ids = columns(batch, "text", "is_toxic", "doc_id")
            read = texts.to_pylist()
            words = pa.array([" ".join(sorted(document_words(t, True))) for t in read], pa.string())
            least = pa.array([[h - (1 << 64) if h >> 63 else h for h in sketch(t)] for t in read], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, words, toxic, least], ["doc_id", "words", "is_toxic", "least"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(read.mapInArrow(bags, f"doc_id {kind}, words string, is_toxic boolean, least array<long>").collect(), key=lambda r: (r[0], r[1]))
    return fit([r[1].split() for r in rows], np.array([r[2] for r in rows], bool), [r[3] for r in rows])


def has_single_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text whether four words in a row can be of one character, as spaced_out() joins them.

    Words are those of str.split(), characters those of UTF-8; texts with white space beyond ASCII always count.
    """
    texts = len(starts) - 1
    blank = IS_SPACE[data] | ((data >= 28) & (data <= 31))  # what str.split() takes for white space
    first = ~blank & ((data < 128) | (data >= 192))  # where characters begin
    a, b = runs(~blank, starts)
    count = np.concatenate([[0], np.cumsum(first)])
    single = count[b] - count[a] == 1
    owner = np.searchsorted(starts, a, "right") - 1
    look = np.zeros(texts, bool)
    if len(a) > 3:
        four = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (owner[:-3] == owner[3:])
        look[owner[:-3][four]] = True
    return look | (np.bincount(np.searchsorted(starts, np.flatnonzero(wide_space(data)), "right") - 1, minlength=texts) > 0)


def wide_space(data: np.ndarray) -> np.ndarray:
    """Where a character that can be white space beyond ASCII begins: U+0085, U+00A0, U+1680, U+2000 to U+206F, U+3000."""
    if len(data) < 2:
        return np.zeros(len(data), bool)
    out = np.zeros(len(data), bool)
    x, y = data[:-1], data[1:]
    out[:-1] = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) | (x == 0xE2) & ((y == 0x80) | (y == 0x81)) | (x == 0xE3) & (y == 0x80)
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs and toxicity_score."""
    if model is None:
        return docs.withColumn("toxicity_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.fold.astype(np.float32), model.bias, model.top))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        cache: dict[str, float] = {}
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                (texts,) = columns(rows, "text")
                data, starts = bytes_of(texts)
                look = has_single_words(data, starts)
                bags = [document_words(t or "", bool(q)) for t, q in zip(texts.to_pylist(), look)]
                if len(cache) > CACHE_WORDS:
                    cache = {}
                new = list(set().union(*bags) - cache.keys())
                cache.update(zip(new, own.margins(new)))
                found = [summary([cache[w] for w in bag]) for bag in bags]
                best, mass = (np.array(x, float) for x in zip(*found))
                names = [*rows.schema.names, "toxicity_score"]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.score(best, mass))], names)
        cache.clear()
        give_back()

    schema = docs.drop("toxicity_score").withColumn("toxicity_score", F.lit(0.0)).schema
    return docs.drop("toxicity_score").mapInArrow(work, schema)


def score_documents(docs: DataFrame, labels: DataFrame, *, sample: tuple[int, int] = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, *, sample: tuple[int, int] = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all columns."""
    names = docs.columns
    scored = score(docs.select("text", F.struct("*").alias("row")), train(docs, labels, sample)) if "toxicity_score" in names else score(docs, train(docs, labels, sample))
    kept = scored.filter(F.col("toxicity_score") < threshold)
    return kept.select(*([F.col("row")[c].alias(c) for c in names] if "toxicity_score" in names else names))
