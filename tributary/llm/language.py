"""Language identification by a convolutional network over bytes.

Bytes are embedded, convolved with filters of several widths, pooled by their maximum over a window and classified by a
softmax. The network is trained in numpy, by Adam, on windows of labelled texts. A text of any length is cut into windows
of WINDOW bytes that overlap by the widest filter less one, so that each run of bytes that a filter can see is seen; its
languages' probabilities are the means over its windows, weighted by their letters. Windows of many texts go through the
network together.

The network learns from at most SAMPLE texts a language, for the LANGUAGES commonest languages, and from at most PIECES
windows of a text, spread over the whole of it; so at most LANGUAGES * SAMPLE * PIECES * WINDOW bytes reach the driver, whatever
the corpus. Everything else reads all rows and whole texts. The parameters (some 25 KB) are broadcast.

Defined results: a null text, or one without any letter (of any script), is `und` with score 0, and so is every text when
nothing can be learnt; with one language learnt, every other text has that one with score 1; texts without a learnable
language are predicted like any other; documents with equal texts get equal results, repeated rows each get theirs; a null
doc_id counts as the empty text in the hold-out rule; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import ascii_set, bytes_of, columns, give_back, slices

UNDETERMINED = "und"
#: Labelled texts that are learnt from at most, a language; and languages, the commonest first.
SAMPLE, LANGUAGES = 300, 64
#: Windows that are learnt from at most, a text.
PIECES = 6
WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS, DEPTH = 12, 8
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: Windows that go through the network at once.
AT_ONCE = 256
STEP = WINDOW - max(WIDTHS) + 1
PAD = 256

_LETTER = ascii_set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True  # in weights, bytes of other characters count as letters


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # PAD + 1, DEPTH; the last row is zero
    kernel: np.ndarray  # max(WIDTHS) * DEPTH, filters; what lies beyond a filter's width is zero
    bias: np.ndarray
    top: np.ndarray  # filters, languages
    top_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions' embedded neighbourhoods, maxima of filters over positions, where they are)."""
        n = len(windows)
        x = self.embed[windows].reshape(n, WINDOW * DEPTH)
        span = max(WIDTHS) * DEPTH
        near = np.lib.stride_tricks.sliding_window_view(x, span, 1)[:, ::DEPTH]
        near = np.ascontiguousarray(near).reshape(-1, span)
        out = (near @ self.kernel).reshape(n, STEP, -1)
        at = out.argmax(1)
        high = np.take_along_axis(out, at[:, None, :], 1)[:, 0] + self.bias
        return near, high, at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        n = len(windows)
        x = self.embed[windows].reshape(n, WINDOW * DEPTH)
        span = max(WIDTHS) * DEPTH
        near = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, span, 1)[:, ::DEPTH]).reshape(-1, span)
        high = (near @ self.kernel).reshape(n, STEP, -1).max(1) + self.bias
        return softmax(np.maximum(high, 0) @ self.top + self.top_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def filter_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * DEPTH, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DEPTH, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def gradients(net: Network, windows: np.ndarray, truth: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the mean loss by embed, kernel, bias, top and top_bias, and the loss."""
    n = len(windows)
    near, high, at = net.pooled(windows)
    seen = np.maximum(high, 0)
    p = softmax(seen @ net.top + net.top_bias)
    loss = float(-np.log(np.maximum(p[np.arange(n), truth], 1e-12)).mean())
    off = p.copy()
    off[np.arange(n), truth] -= 1
    off /= n
    back = (off @ net.top.T) * (high > 0)  # window, filter
    row = np.arange(n)[:, None] * STEP + at  # the neighbourhood that each maximum comes from
    by_kernel = np.einsum("nfs,nf->sf", near[row], back) * filter_mask()
    # what reaches the bytes: each maximum passes its own filter back to the bytes below it
    by_near = back[:, :, None] * net.kernel.T[None]  # window, filter, span
    by_near = by_near.reshape(n, back.shape[1], max(WIDTHS), DEPTH)
    by_embed = np.zeros_like(net.embed)
    place = np.minimum(at[:, :, None] + np.arange(max(WIDTHS)), WINDOW - 1)
    np.add.at(by_embed, windows[np.arange(n)[:, None, None], place], by_near)
    by_embed[PAD] = 0
    return [by_embed, by_kernel, back.sum(0), seen.T @ off, off.sum(0)], loss


def fit(texts: list[bytes], languages: list[str], *, epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """texts: windows' bytes, WINDOW at most; languages: that of each."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    filters = len(WIDTHS) * FILTERS
    net = Network(
        names,
        np.concatenate([rng.normal(0, 0.5, (PAD, DEPTH)), np.zeros((1, DEPTH))]).astype(np.float32),
        (rng.normal(0, 0.3, (max(WIDTHS) * DEPTH, filters)) * filter_mask()).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.2, (filters, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    truth = np.array([names.index(x) for x in languages])
    often = np.bincount(truth, minlength=len(names)).max()
    # each language as often as the commonest, in rounds, so that none is learnt as a default
    even = np.concatenate([np.resize(rng.permutation(np.flatnonzero(truth == k)), often) for k in range(len(names))])
    held = [getattr(net, x) for x in ("embed", "kernel", "bias", "top", "top_bias")]
    first, second, step = [np.zeros_like(h) for h in held], [np.zeros_like(h) for h in held], 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(even)
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            windows = np.full((len(own), WINDOW), PAD, np.int64)
            for i, t in enumerate(own):
                raw = np.frombuffer(texts[t], np.uint8)
                if len(raw) > 24 and rng.random() < 0.5:  # short texts are learnt too
                    size = int(rng.integers(12, len(raw)))
                    at = int(rng.integers(0, len(raw) - size + 1))
                    raw = raw[at : at + size]
                windows[i, : len(raw)] = raw
            steps, _ = gradients(net, windows, truth[own])
            step += 1
            for h, g, a, b in zip(held, steps, first, second):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                h -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(starts: np.ndarray, width: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of each window; starts as bytes_of gives them. An empty text has one empty window."""
    size = np.diff(starts)
    count = np.maximum(1, -(-(size - (width - step)) // step))
    text = np.repeat(np.arange(len(size)), count)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[text] + rank * step
    return text, begin, np.minimum(begin + width, starts[text + 1])


def has_letter(data: np.ndarray, starts: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Of each text whether any of its characters is a letter."""
    def some(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[starts[1:]] > total[starts[:-1]]

    plain = some(_LETTER[data] & (data < 128))
    for i in np.flatnonzero(~plain & some(data >= 128)):
        plain[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return plain


def judge(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its probability."""
    data, starts = bytes_of(texts)
    n = len(texts)
    letter = has_letter(data, starts, texts)
    owner, begin, end = windows_of(starts)
    mine = np.flatnonzero(letter[owner])
    owner, begin, end = owner[mine], begin[mine], end[mine]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    weight = letters[end] - letters[begin] + 1e-3
    total = np.zeros((n, len(net.languages)))
    place = np.arange(WINDOW)
    for k in range(0, len(owner), AT_ONCE):
        at = begin[k : k + AT_ONCE, None] + place
        inside = at < end[k : k + AT_ONCE, None]
        windows = np.full((AT_ONCE, WINDOW), PAD, np.int64)  # always as many, so that a window's sums don't hang on its company
        windows[: len(at)] = np.where(inside, data[np.minimum(at, len(data) - 1)], PAD)
        np.add.at(total, owner[k : k + AT_ONCE], net.probabilities(windows)[: len(at)] * weight[k : k + AT_ONCE, None])
    mass = total.sum(1)
    best = total.argmax(1)
    score = np.where(letter & (mass > 0), total[np.arange(n), best] / np.maximum(mass, 1e-12), 0.0)
    return [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letter)], np.clip(score, 0, 1).round(6)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, *, sample: int = SAMPLE, languages: int = LANGUAGES) -> Network | None:
    """Fits on the driver. Which texts are learnt from hangs on their hash alone: a share of each language's is taken that
    gives somewhat more than `sample`, of which the least hashes stay, so that no language is gathered in one place."""
    usable = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    usable = usable.filter(F.col("text").rlike(r"\p{L}"))
    usable = usable.withColumn("th", F.xxhash64("text"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("th").alias("texts"))
    counts = counts.orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (1.5 * sample + 20) / r["texts"]))])[F.col("lang")]
    lot = F.pmod("th", F.lit(1 << 52)) / float(1 << 52)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, lots, texts = columns(batch, "lang", "lot", "text")
            out = []
            for t in texts.to_pylist():
                raw = t.encode()
                ends = max(1, -(-len(raw) // WINDOW))
                at = range(ends) if ends <= PIECES else [int(i * ends / PIECES) for i in range(PIECES)]
                out.append([raw[i * WINDOW : (i + 1) * WINDOW] for i in at])
            yield pa.RecordBatch.from_arrays([lang, lots, pa.array(out, pa.list_(pa.binary()))], ["lang", "lot", "pieces"])

    chosen = usable.withColumn("lot", lot).filter(F.col("lot") < share).select("lang", "lot", "text")
    cut = chosen.mapInArrow(pieces, "lang string, lot double, pieces array<binary>")
    rows = cut.groupBy("lang", "lot").agg(F.min("pieces").alias("pieces")).collect()  # copies count once
    texts, names = [], []
    left = {r["lang"]: sample for r in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["lot"], [bytes(p) for p in r["pieces"]])):
        if left[r["lang"]] > 0:
            left[r["lang"]] -= 1
            texts += [bytes(p) for p in r["pieces"]]
            names += [r["lang"]] * len(r["pieces"])
    return fit(texts, names)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if net is None:
        return own.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, most=1 << 20):
                ids, texts = columns(rows, "doc_id", "text")
                names, score = judge(shared.value, texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        give_back()

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, *, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs, sample=sample, languages=languages))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
