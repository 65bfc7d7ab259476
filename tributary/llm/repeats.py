"""Removing passages that an earlier document already has: every byte under a repeated WINDOW-byte string.

A suffix array of all bytes, sorted externally with its common prefixes, answers this too, but one suffix tuple a byte
(13 bytes or more, each sorted and merged through disk) is over twenty times the input; README.md has the figures. Here
suffixes are sorted only where they can matter:

1. Documents equal to an earlier one are told by digest: all of such a document goes (if it has WINDOW bytes).
2. Winnowing: of the ANCHOR-byte strings that begin in any WINDOW-byte string, those of least hash are its anchors, so
   equal windows have equal anchors at equal places. Anchors' hashes are counted, packed and part by part, over all
   documents; those that two documents have are marked in a bit table of bounded size.
3. Around each marked anchor the window's reach to both sides is cut out, once for each distinct cut in a task (later
   documents with the same cut are covered on the spot), and sorted by content with its document. Windows that a smaller
   document shares, byte for byte, come back as a bit mask at the anchor's place.

Nothing is sampled: a false mark costs a cut, never a result, and every window has an anchor.

Defined results: a null text counts as empty; texts under WINDOW bytes lose nothing; rows that repeat one doc_id aren't
earlier than each other; a null doc_id is neither earlier nor later than any, so its row loses and gives nothing; an
empty table gives an empty result; ids may be of any type that sorts; texts of any length are read whole; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import _TABLE, Table, _power, bit_table, bits_for, bytes_of, columns, give_back, is_marked, mix64, power, slices, text_of
from tributary.llm.ngram_join import cut, expand, squeeze

WINDOW = 50
ANCHOR = 24
BLOCK = 300_000
FLUSH = 1_500_000
CUTS = 8_000
HOT = 100_000
PART_BYTES = 4 << 20
MOST_BITS = 30
HASH_BITS = 48
U = np.uint64


def _anchors_of_block(data: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' places and hashes; last: for each place, the end of its text."""
    reach = window - ANCHOR + 1
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(_TABLE[data] * _power(n), out=total[1:])
    m = n - ANCHOR + 1
    h = mix64((total[ANCHOR:] - total[:m]) * _power(m, inverse=True)) | U(1)
    place = np.arange(m)
    top = U(0xFFFFFFFFFFFFFFFF)
    h[place + ANCHOR > last[:m]] = top
    if m < reach:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low, have = h, 1
    while have * 2 <= reach:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[: m - reach + 1], low[reach - have : reach - have + m - reach + 1])
    low = np.where(place[: len(low)] + window <= last[: len(low)], low, U(0))
    high = np.concatenate([np.zeros(reach - 1, U), low, np.zeros(reach - 1, U)])  # high[i] .. the windows that hold place i
    have = 1
    while have * 2 <= reach:
        high = np.maximum(high[: len(high) - have], high[have:])
        have *= 2
    high = np.maximum(high[:m], high[reach - have : reach - have + m])
    at = np.flatnonzero(high == h)
    return at, h[at]


def anchors(data: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in data, hashes of HASH_BITS, texts) of all anchors, in order; long data goes block by block."""
    n = len(data)
    places, hashes = [], []
    ends = starts[1:]
    for x in range(0, n, BLOCK):
        a, b = max(0, x - window), min(n, x + BLOCK + 2 * window)
        first = int(np.searchsorted(ends, a, "right"))
        stop = int(np.searchsorted(ends, b, "left")) + 1
        edges = np.minimum(ends[first:stop], b) - a  # a text cut by the block ends with it; its anchors there are the next block's
        last = np.repeat(edges, np.diff(np.concatenate([[0], edges])))
        at, h = _anchors_of_block(data[a:b], last, window)
        keep = (at + a >= x) & (at + a < min(n, x + BLOCK))
        places.append(at[keep] + a)
        hashes.append(h[keep])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    at = np.concatenate(places)
    # the least of many hashes are small: mixed again they fill all parts and slots evenly
    return at, mix64(np.concatenate(hashes)) >> U(64 - HASH_BITS), np.searchsorted(starts, at, "right") - 1


def repeated_anchors(docs: DataFrame, wanted: bytes, bits: int, part_bits: int, window: int, most: int = HOT) -> tuple[bytes, bytes]:
    """One bit for each value of an anchor hash's leading bits: set where two documents have an anchor. 2**bits / 8 bytes.
    And the hashes, in order, that over `most` documents have: a word for each, one of `most` anchors at most."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            held.clear()
            edge = cut(h, part_bits, HASH_BITS)
            parts = [p for p in range(1 << part_bits) if edge[p + 1] > edge[p]]
            packed = [squeeze(np.diff(h[edge[p] : edge[p + 1]], prepend=U(p) << U(HASH_BITS - part_bits))) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

        for _, data, starts in _texts(batches, shared.value):
            _, h, of = anchors(data, starts, window)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            held.append(h[new])
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    room = 1 << (bits - part_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            twice = h[1:][h[1:] == h[:-1]]
            many = np.unique(h[most:][h[most:] == h[: max(0, len(h) - most)]])
            mark = np.zeros(room, bool)
            mark[((twice >> U(HASH_BITS - bits)) & U(room - 1)).astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(mark, bitorder="little").tobytes()], pa.binary()), pa.array([many.tobytes()], pa.binary())], ["part", "marks", "hot"])

        for batch in batches:
            for p, raw in zip(*(c.to_pylist() for c in columns(batch, "part", "packed"))):
                if p != part and held:
                    yield done()
                    held = []
                part = p
                held.append(np.cumsum(expand(raw, U), dtype=U) + (U(p) << U(HASH_BITS - part_bits)))
        if held:
            yield done()

    packed = docs.mapInArrow(gather, "part int, packed binary").repartition(1 << part_bits, "part").sortWithinPartitions("part")
    found = {r[0]: r[1:] for r in packed.mapInArrow(count, "part int, marks binary, hot binary").collect()}
    return b"".join(found[p][0] if p in found else bytes(room // 8) for p in range(1 << part_bits)), b"".join(found[p][1] for p in sorted(found))


def _texts(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose id is marked, with their bytes."""
    marks = np.frombuffer(wanted, np.uint8)
    for batch in batches:
        (slot,) = columns(batch, "slot")
        s = slot.to_numpy(zero_copy_only=False).astype(np.int64)
        s = np.where(s > 0, s - 1, 8 * (len(marks) - 4096))
        keep = (marks[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        for rows in slices(batch.filter(pa.array(keep)) if not keep.all() else batch, most=BLOCK):
            (texts,) = columns(rows, "text")
            yield rows, *bytes_of(texts)
        give_back()


def covered_windows(docs: DataFrame, wanted: bytes, marks: bytes, hot: bytes, bits: int, part_bits: int, window: int) -> DataFrame:
    """doc_id, th, at (anchor's place), mask (bit i: the window that begins i bytes before it is an earlier document's).
    Around hot anchors each window is a cut of its own, grouped by its bytes: no group holds all of an anchor's documents."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, marks, hot))
    back = window - ANCHOR
    width = back + window

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_marked, table, hot_hashes = shared.value[0], np.frombuffer(shared.value[1], np.uint8), np.frombuffer(shared.value[2], U)
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, th, at, left, right, cuts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            name = _cut_names(cuts, left, right)
            order = np.lexsort((doc, name, h))
            h, doc, th, at, left, right, cuts, name = (x[order] for x in (h, doc, th, at, left, right, cuts, name))
            lead = np.ones(len(h), bool)
            lead[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
            first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
            later = doc > doc[first]
            same = later.copy()
            same[later] = (cuts[later] == cuts[first[later]]).all(1)
            if same.any():
                yield out(pa.array(np.full(int(same.sum()), 1, np.int32)), pa.array((mix64(doc[same].view(U)) & U((1 << part_bits) - 1)).astype(np.int32)), None, doc[same], th[same], at[same], _all_windows(left[same], right[same], window))
            go = ~same
            h, doc, th, at, left, right, cuts = (x[go] for x in (h, doc, th, at, left, right, cuts))
            edge = cut(h, part_bits, HASH_BITS)
            parts = [p for p in range(1 << part_bits) if edge[p + 1] > edge[p]]
            packed = []
            for p in parts:
                s = slice(edge[p], edge[p + 1])
                packed.append(b"".join(len(x).to_bytes(4, "little") + x for x in (squeeze(np.diff(h[s], prepend=U(p) << U(HASH_BITS - part_bits))), squeeze(doc[s]), squeeze(th[s]), squeeze(at[s]), squeeze(left[s]), squeeze(right[s]), _deflate(cuts[s].tobytes()))))
            yield out(pa.array(np.zeros(len(parts), np.int32)), pa.array(parts, pa.int32()), packed, None, None, None, None)

        def out(kind, part, packed, doc, th, at, mask) -> pa.RecordBatch:
            n = len(kind)
            whole = lambda v: pa.array(v, pa.int64()) if v is not None else pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([kind, part, pa.array(packed, pa.binary()) if packed is not None else pa.nulls(n, pa.binary()), whole(doc), whole(th), whole(at), whole(mask)], ["kind", "part", "packed", "doc_id", "th", "at", "mask"])

        for rows, data, starts in _texts(batches, rows_marked):
            at, h, of = anchors(data, starts, window)
            k = (h >> U(HASH_BITS - bits)).astype(np.int64)
            on = (table[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
            at, h, of = at[on], h[on], of[on]
            if not len(at):
                continue
            ids, ths = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns(rows, "doc_id", "th"))
            place = at - starts[of]
            left = np.minimum(place, back).astype(np.uint8)
            right = np.minimum(starts[of + 1] - at, window).astype(np.uint8)
            padded = np.concatenate([np.zeros(back, np.uint8), data, np.zeros(window, np.uint8)])
            for s in range(0, len(at), CUTS):
                e = slice(s, s + CUTS)
                cuts = np.lib.stride_tricks.sliding_window_view(padded, width)[at[e]]
                j = np.arange(width)
                cuts = np.where((j >= back - left[e][:, None]) & (j < back + right[e][:, None].astype(np.int64)), cuts, np.uint8(0))
                whole = (h[e], ids[of[e]], ths[of[e]], place[e].astype(np.int64), left[e], right[e], cuts)
                is_hot = np.isin(h[e], hot_hashes)
                for some in chain([tuple(x[~is_hot] for x in whole)], _windows_apart(tuple(x[is_hot] for x in whole), window)) if is_hot.any() else [whole]:
                    held.append(some)
                    if sum(len(x[0]) for x in held) >= 6 * CUTS:
                        yield from flush()
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            kind, ps, packed, doc, th, at, mask = columns(batch, "kind", "part", "packed", "doc_id", "th", "at", "mask")
            known = kind.to_numpy(zero_copy_only=False) == 1
            if known.any():
                yield pa.RecordBatch.from_arrays([doc, th, at, mask], ["doc_id", "th", "at", "mask"]).filter(pa.array(known))
            for i in np.flatnonzero(~known):
                p = ps[int(i)].as_py()
                if p != part and held:
                    yield _settled(held, part, part_bits, window)
                    held = []
                    give_back()
                part = p
                held.append(packed[int(i)].as_py())
        if held:
            yield _settled(held, part, part_bits, window)
        give_back()

    sent = docs.mapInArrow(gather, "kind int, part int, packed binary, doc_id long, th long, at long, mask long")
    return sent.repartition(1 << part_bits, "part").sortWithinPartitions("part").mapInArrow(settle, "doc_id long, th long, at long, mask long")


def _deflate(raw: bytes) -> bytes:
    import zlib

    return zlib.compress(raw, 1)


def _inflate(raw: bytes) -> bytes:
    import zlib

    return zlib.decompress(raw)


def _windows_apart(whole: tuple, window: int) -> Iterator[tuple]:
    """For each offset, the cuts that hold its window, as cuts of that window alone with a hash of their own."""
    _, doc, th, at, left, right, cuts = whole
    back = window - ANCHOR
    for i in range(back + 1):
        ok = (left >= i) & (right >= window - i)
        if not ok.any():
            continue
        one = np.zeros((int(ok.sum()), cuts.shape[1]), np.uint8)
        one[:, back - i : back - i + window] = cuts[ok, back - i : back - i + window]
        low, high = np.full(len(one), i, np.uint8), np.full(len(one), window - i, np.uint8)
        yield _cut_names(one, low, high) >> U(64 - HASH_BITS), doc[ok], th[ok], at[ok], low, high, one


def _cut_names(cuts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    total = np.zeros(len(cuts), U)
    for j, weight in enumerate(_power(cuts.shape[1])):  # a column at a time, as a table of words for all bytes is large
        total += _TABLE[cuts[:, j]] * weight
    return mix64(total + left.astype(U) * U(131) + right.astype(U) * U(65537))


def _all_windows(left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    """The mask of all windows that a cut holds whole: from window - right to left bytes before the anchor."""
    low, high = window - right.astype(np.int64), left.astype(np.int64)
    return np.where(high >= low, (np.int64(1) << (high + 1)) - (np.int64(1) << np.minimum(low, 62)), 0)


def _settled(held: list[bytes], part: int, part_bits: int, window: int) -> pa.RecordBatch:
    """Of one part's cuts, which windows a smaller document shares."""
    back = window - ANCHOR
    width = back + window
    found = []
    while held:
        raw = held.pop()
        pieces, k = [], 0
        while k < len(raw):
            n = int.from_bytes(raw[k : k + 4], "little")
            pieces.append(raw[k + 4 : k + 4 + n])
            k += 4 + n
        found.append((np.cumsum(expand(pieces[0], U), dtype=U) + (U(part) << U(HASH_BITS - part_bits)), expand(pieces[1], np.int64), expand(pieces[2], np.int64), expand(pieces[3], np.int64), expand(pieces[4], np.uint8), expand(pieces[5], np.uint8), np.frombuffer(_inflate(pieces[6]), np.uint8).reshape(-1, width)))
    h = np.concatenate([x[0] for x in found])
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    many = np.diff(np.append(np.flatnonzero(new), len(h)))
    go = np.repeat(many > 1, many)  # what stands alone shares nothing
    h, order = h[go], order[go]
    doc, th, at, left, right, cuts = (np.concatenate(x)[order] for x in list(zip(*found))[1:])
    found.clear()
    mask = np.zeros(len(doc), np.int64)
    weight = _power(width)
    for s in _chunks(h):
        d, c = doc[s], cuts[s]
        by_place = np.ascontiguousarray(c.T)
        word = lambda j: _TABLE[by_place[j]] * weight[j]
        names = np.zeros(len(d), U)  # of the windows at one offset: the next one's follow from them, so a large group needs one word a cut
        for j in range(window):
            names += word(j)
        for a in range(back + 1):
            if a:
                names += word(a + window - 1) - word(a - 1)
            i = back - a
            ok = np.flatnonzero((left[s] >= i) & (right[s] >= window - i))
            if len(ok) < 2:
                continue
            name = names[ok]
            by = np.lexsort((d[ok], name))
            ok, name = ok[by], name[by]
            lead = np.concatenate([[True], name[1:] != name[:-1]])
            first = ok[np.maximum.accumulate(np.where(lead, np.arange(len(ok)), 0))]
            later = d[ok] > d[first]
            ok, first = ok[later], first[later]
            for k in range(0, len(ok), CUTS):
                x, y = ok[k : k + CUTS], first[k : k + CUTS]
                same = (c[x, a : a + window] == c[y, a : a + window]).all(1)
                mask[s][x[same]] |= np.int64(1) << i
    on = mask != 0
    return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (doc, th, at, mask)], ["doc_id", "th", "at", "mask"])


def _chunks(h: np.ndarray, most: int = 10_000) -> Iterator[slice]:
    """Runs of whole groups of about `most` entries."""
    a = 0
    while a < len(h):
        b = min(len(h), a + most)
        if b < len(h):
            b = int(np.searchsorted(h, h[b - 1], "right"))
        yield slice(a, b)
        a = b


def removed_runs(at: np.ndarray, mask: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the windows of the masks."""
    starts = np.unique(np.concatenate([(at - i)[(mask >> i) & 1 == 1] for i in range(window - ANCHOR + 1)])) if len(at) else np.zeros(0, np.int64)
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > window)
    first = starts[np.concatenate([[0], gap + 1])]
    last = starts[np.concatenate([gap, [len(starts) - 1]])] + window
    return [(int(a), int(b)) for a, b in zip(first, last)]


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if with_text). Anchors that over
    `hot` documents have are settled window by window."""
    if not ANCHOR < window <= ANCHOR + 61:
        raise ValueError(f"window must be from {ANCHOR + 1} to {ANCHOR + 61} bytes")
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return _by_rank(docs, window, with_text, hot)
    text = text_of(docs)
    docs = docs.select("doc_id", text.alias("text"))
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("th"), F.octet_length("text").cast("long").alias("n"))
    rows = Table(rows, "rows").df
    whole = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") >= window))
    first = Table(whole.groupBy("digest").agg(F.min("doc_id").cast("long").alias("doc_id"), F.first("n").alias("n"), F.count_distinct("doc_id").alias("many")), "firsts").df
    copied = first.filter("many > 1").select("digest", F.col("doc_id").alias("first_id"))
    copies = whole.select("doc_id", "th", "digest").join(copied, "digest").filter("doc_id > first_id").select("doc_id", "th").distinct()
    total = first.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(20, power(total // 8 + 1)))
    part_bits = min(17, bits - 4, max(6, power(total // PART_BYTES + 1)))
    wanted = bit_table(first.select("doc_id"), 24)
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 24)).alias("slot")
    read = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), slot, "text")
    marks, common = repeated_anchors(read, wanted, bits, part_bits, window, hot)
    masks = Table(covered_windows(read, wanted, marks, common, bits, part_bits, window), "masks").df
    per_row = masks.groupBy("doc_id", "th").agg(F.collect_list("at").alias("at"), F.collect_list("mask").alias("mask"))
    gone = copies.select(F.col("doc_id").cast("long").alias("doc_id"), "th", F.lit(True).alias("copy"))
    cuts = Table(per_row.join(gone, ["doc_id", "th"], "full").select("doc_id", "th", "at", "mask", F.coalesce("copy", F.lit(False)).alias("copy")), "cuts").df.alias("c")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at, mask, copy = columns(batch, "doc_id", "text", "at", "mask", "copy")
            rows = []
            for i in range(len(ids)):
                raw = (texts[i].as_py() or "").encode()
                runs = []
                if copy[i].as_py():
                    runs = [(0, len(raw))]
                elif at[i].is_valid:
                    runs = removed_runs(np.array(at[i].as_py(), np.int64), np.array(mask[i].as_py(), np.int64), window)
                kept, k = [], 0
                for a, b in runs:
                    kept.append(raw[k:a])
                    k = b
                left = b"".join([*kept, raw[k:]])
                rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            got = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([ids, *got[: 5 if with_text else 4]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    touched = _is_touched(cuts.select("doc_id", "th"))
    # most texts lose nothing: they are hashed where they are read, and only the others move to their cuts
    text, none = F.col("text"), F.lit(0).cast("long")
    whole = d.filter(F.col("doc_id").isNull() | ~touched).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.cast("binary").alias("kept")] if with_text else []))
    d = d.filter(F.col("doc_id").isNotNull() & touched).alias("d")
    met = d.join(cuts.hint("merge"), (F.col("d.doc_id").cast("long") == F.col("c.doc_id")) & (F.col("d.th") == F.col("c.th")), "left").select("d.doc_id", "d.text", "c.at", "c.mask", "c.copy")
    return whole.unionByName(met.mapInArrow(apply, schema))


def _is_touched(keys: DataFrame) -> Column:
    """Whether a row's (doc_id, th) is among keys, as a table of bits tells: all that are, and a few others."""
    slots = keys.select(F.xxhash64("doc_id", "th").alias("key"))
    bits = bits_for(slots.count())
    shared = keys.sparkSession.sparkContext.broadcast(bit_table(slots, bits))

    @F.arrow_udf("boolean")
    def marked(slot: pa.Array) -> pa.Array:
        return pa.array(is_marked(np.frombuffer(shared.value, np.uint8), slot))

    return marked(F.pmod(F.xxhash64(F.xxhash64(F.col("doc_id").cast("long"), F.col("th"))), F.lit(1 << bits)))


def _by_rank(docs: DataFrame, window: int, with_text: bool, hot: int) -> DataFrame:
    """For ids that are no integers: each gets a number that sorts as it does."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranks = Table(ids.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("rank")), "ranks").df
    ranked = docs.select(F.col("doc_id").alias("id"), text_of(docs).alias("text")).join(ranks, "id", "left").select(F.col("rank").alias("doc_id"), "text")
    found = remove_repeats(Table(ranked, "ranked").df, window=window, with_text=with_text, hot=hot)
    names = [c for c in found.columns if c != "doc_id"]
    return found.withColumnRenamed("doc_id", "rank").join(ranks, "rank", "left").select(F.col("id").alias("doc_id"), *names)


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS w FROM h, unnest(range(1, length(x) // 2 - 48)) AS r(i)),
firsts AS (SELECT w, min(doc_id) AS f FROM windows GROUP BY w),
bad AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS opens FROM windows JOIN firsts USING (w) WHERE f < doc_id),
numbered AS (SELECT doc_id, i, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM bad),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY ALL),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS s FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * s - 1, 2 * (a - s)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) - 1) AS k FROM pieces JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)
"""
