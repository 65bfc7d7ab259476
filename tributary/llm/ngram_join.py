"""Jaccard self-join on word shingles by token-combination prefixes.

A document's tokens are its distinct shingles. A first scan counts tokens over all documents in 2**bits slots (packed,
summed slice by slice) and marks slots that more than RARE tokens fall into: their tokens form the frequent class. Any
marking gives right results, as it is one function of the token for all documents.

Tokens are ordered rare ones first, then by hash. Two sets of Jaccard similarity J or more share a signature when each
indexes a prefix of that order that `errors = n - ceil(J n)` misses can't empty: one signature for each rare token and,
only if those are too few, pairs of frequent tokens of one subclass, the prefix being extended until the pairs' count of
tokens less one a subclass makes up the rest. Subclasses are dealt by hash, about one for eight tokens, so that pairs
grow with a document's length and not with its square; their number depends on the length's power of two, and a document
near the lower bound of its power also indexes itself by the next lower one, so any two linked documents have one in
common.

Sets that are equal are one node. Signatures travel packed, sorted and cut into parts by their leading bits; a part's
groups of up to SMALL nodes give all pairs, larger ones give two stars and keep their member list. Pairs are ruled out by
size and by parity bits, verified on whole sets, and links joined to components. Nodes of a member list that lie in
several components are then compared by their bits, block by block; of what may still link a spanning forest is verified,
and a quota of further pairs. Only lists that left pairs out by that quota come up in another round. So the result is exact
without all pairs of any group.

Defined results: a null text or one without words has size 0 and links with nothing; fewer than `words` words form one
shingle; repeated rows are equal documents; a null doc_id keeps its size and a null component unless it links; an empty
table gives an empty result; texts of any length are read whole; other columns, whatever their names, play no part.
Hashes have 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import IS_SPACE, Table, bit_table, bits_for, bytes_of, columns, give_back, is_marked, lower_bytes, mix64, only_marked, power, range_hashes, runs, slices, slot_of, text_of, without
from tributary.llm.components import components
from tributary.llm.decontaminate import roll

WORDS, PERCENT = 5, 80
#: Tokens in a slot from which its tokens count as frequent.
RARE = 24
SMALL = 6
MOST_BITS = 30
MOST_PART_BITS = 20
#: Leading bits of a signature that travel. Signatures that share them by chance only make a candidate more.
SIGNATURE_BITS = 48
#: Tasks that parts are dealt to, at most; a task takes its parts one by one.
MOST_TASKS = 1 << 15
PART_BYTES = 16 << 20
FLUSH = 2_000_000
#: Bytes of text that are worked on at once.
SLICE = 2 << 20
#: Members of a list that are compared at once with as many others.
BLOCK = 1000
#: Pairs of a node that one round tests besides those that tie it to others; eight times as many in each later round.
QUOTA = 8

U = np.uint64


def token_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    data, starts = bytes_of(texts)
    data = lower_bytes(data)
    a, b = runs(~IS_SPACE[data], starts)
    before = np.searchsorted(a, starts)
    h = range_hashes(data, a, b)
    n = len(texts)
    count = np.diff(before)
    owner = np.repeat(np.arange(n), count)
    rolled = roll(h, words)
    inside = owner[: len(rolled)] == owner[words - 1 :] if len(rolled) else np.zeros(0, bool)
    tokens, of = rolled[inside], owner[: len(rolled)][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = [roll(h[before[i] : before[i + 1]], int(count[i]))[0] for i in short]
        tokens, of = np.concatenate([tokens, np.array(whole, U)]), np.concatenate([of, short])
    order = np.lexsort((tokens, of))
    tokens, of = tokens[order], of[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    tokens, of = tokens[new], of[new]
    return tokens, np.searchsorted(of, np.arange(n + 1))


def node_names(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix64(tokens ^ U(0xA5A5F00DCAFE1234)), dtype=U)])
    return mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def parities(tokens: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bits of each set: the parity of its tokens in each of 2 to 4 buckets a token. Of two sets no more bits differ than
    tokens do, once the wider one's bits are folded to the other's number."""
    n = np.diff(at)
    wide = np.array([max(512, 2 << power(int(k))) for k in n], np.int64)
    base = np.concatenate([[0], np.cumsum(wide)])
    of = np.repeat(np.arange(len(n)), n)
    odd = np.bincount(base[of] + (mix64(tokens) & (wide[of] - 1).astype(U)).astype(np.int64), minlength=base[-1]) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(raw)])


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity words, folded to `width` words."""
    return bits if bits.shape[1] == width else np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many parity bits of each x and y differ."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for p, q in np.unique(sizes, axis=0):
        of = np.flatnonzero((sizes == (p, q)).all(1))
        left, right = (np.frombuffer(b"".join(side[i] for i in of), U).reshape(len(of), -1) for side in (x, y))
        width = min(p, q) // 8
        out[of] = np.bitwise_count(fold(left, width) ^ fold(right, width)).sum(1)
    return out


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of integers, plane by plane, deflated; of sorted ones pass the differences."""
    return zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def expand(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def cut(sorted_values: np.ndarray, parts_bits: int, bits: int) -> np.ndarray:
    """Where each part of sorted values of `bits` bits begins, parts being their leading bits."""
    edges = np.arange(1 << parts_bits, dtype=U) << U(bits - parts_bits)
    return np.append(np.searchsorted(sorted_values, edges), len(sorted_values))


# --- the first scan: sizes, names and slot counts ---


def first_scan(docs: DataFrame, words: int, bits: int, part_bits: int) -> DataFrame:
    """kind 0: doc_id, th, n, node, parity; kind 1: part, packed slots of FLUSH tokens or so."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(kind: int, many: int, **have: pa.Array) -> pa.RecordBatch:
            whole = {"kind": pa.array(np.full(many, kind, np.int32))} | {name: have.get(name, pa.nulls(many, t)) for name, t in types.items()}
            return pa.RecordBatch.from_arrays(list(whole.values()), list(whole))

        def flush() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held))
            held.clear()
            edge = cut(slots, part_bits, bits)
            parts = np.flatnonzero(np.diff(edge)).tolist()
            packed = [squeeze(np.diff(slots[edge[p] : edge[p + 1]], prepend=U(p) << U(bits - part_bits)).astype(np.uint32)) for p in parts]
            return out(1, len(parts), part=pa.array(parts, pa.int32()), packed=pa.array(packed, pa.binary()))

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                ids, ths, texts = columns(rows, "doc_id", "th", "text")
                types = {"doc_id": ids.type, "th": pa.int64(), "n": pa.int64(), "node": pa.int64(), "parity": pa.binary(), "part": pa.int32(), "packed": pa.binary()}
                tokens, at = token_sets(texts, words)
                yield out(0, len(ids), doc_id=ids, th=ths, n=pa.array(np.diff(at)), node=pa.array(node_names(tokens, at)), parity=parities(tokens, at))
                held.append(tokens >> U(64 - bits))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"kind int, doc_id {kind}, th long, n long, node long, parity binary, part int, packed binary")


def frequent_slots(packed: DataFrame, bits: int, part_bits: int, rare: int) -> bytes:
    """One bit for each slot: 2**bits / 8 bytes, whatever the data."""
    room = 1 << (bits - part_bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(count > rare, bitorder="little").tobytes()], pa.binary())], ["part", "marks"])

        for batch in batches:
            for p, raw in zip(*(c.to_pylist() for c in columns(batch, "part", "packed"))):
                if p != part:
                    if part is not None:
                        yield done()
                    part, count = p, np.zeros(room, np.uint32)
                at = np.cumsum(expand(raw, np.uint32), dtype=np.int64)
                values, many = np.unique(at, return_counts=True)
                count[values] += many.astype(np.uint32)
        if part is not None:
            yield done()
        give_back()

    dealt = packed.select("part", "packed").repartition(min(1 << part_bits, MOST_TASKS), "part").sortWithinPartitions("part")
    marks = {r[0]: r[1] for r in dealt.mapInArrow(work, "part int, marks binary").collect()}
    return b"".join(marks.get(p, bytes(room // 8)) for p in range(1 << part_bits))


# --- the second scan: signatures ---


def errors(n: int, percent: int) -> int:
    """Tokens of a set of n that a set linked with it can lack at most."""
    return n - -(-percent * n // 100)


def pair_signatures(tokens: np.ndarray, missing: int, scheme: int) -> np.ndarray:
    """Pairs within subclasses of the shortest prefix of frequent tokens that makes up for `missing` signatures."""
    classes = max(1, (1 << scheme) // 8)
    of = (mix64(tokens) % U(classes)).astype(np.int64)
    _, first = np.unique(of, return_index=True)
    more = np.ones(len(tokens), np.int64)
    more[first] = 0
    k = int(np.searchsorted(np.cumsum(more), missing)) + 1
    tokens, of = tokens[:k], of[:k]
    order = np.argsort(of, kind="stable")
    tokens, of = tokens[order], of[order]
    out, gap = [], 1
    while gap < len(of):
        same = np.flatnonzero(of[gap:] == of[:-gap])
        if not len(same):
            break
        out.append(mix64(mix64(tokens[same] + U(scheme + 1)) * U(3) + tokens[same + gap]))
        gap += 1
    return np.concatenate(out) if out else np.zeros(0, U)


def signatures(tokens: np.ndarray, at: np.ndarray, marks: np.ndarray, bits: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, whose, rare tokens of each text)."""
    slot = (tokens >> U(64 - bits)).astype(np.int64)
    often = (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    n = np.diff(at)
    need = n + (-percent * n) // 100 + 1  # errors + 1
    owner = np.repeat(np.arange(len(n)), n)
    rare_before = np.concatenate([[0], np.cumsum(~often)])
    rank = rare_before[:-1] - rare_before[at[:-1]][owner]  # among the text's rare tokens
    single = ~often & (rank < need[owner])
    rare = rare_before[at[1:]] - rare_before[at[:-1]]
    sigs, whose = [tokens[single]], [owner[single]]
    for i in np.flatnonzero((n > 1) & (rare < need)):
        own = tokens[at[i] : at[i + 1]][often[at[i] : at[i + 1]]]
        top = int(n[i]).bit_length() - 1
        schemes = [top, top - 1] if top and -(-percent * int(n[i]) // 100) < 1 << top else [top]
        for scheme in schemes:
            got = pair_signatures(own, int(need[i] - rare[i]), scheme)
            sigs.append(got)
            whose.append(np.full(len(got), i))
    return np.concatenate(sigs), np.concatenate(whose), rare


def second_scan(docs: DataFrame, words: int, percent: int, marks: bytes, bits: int, part_bits: int) -> DataFrame:
    """part, and of its signatures in order: differences, nodes, sizes, shares of rare tokens, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            sig, node, size, share = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((node, sig))
            sig, node, size, share = sig[order], node[order], size[order], share[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, size, share = sig[new], node[new], size[new], share[new]
            edge = cut(sig, part_bits, SIGNATURE_BITS)
            parts = [p for p in range(1 << part_bits) if edge[p + 1] > edge[p]]
            rows = []
            for p in parts:
                s = slice(edge[p], edge[p + 1])
                rows.append((p, squeeze(np.diff(sig[s], prepend=U(p) << U(SIGNATURE_BITS - part_bits))), node[s].tobytes(), squeeze(size[s]), squeeze(share[s])))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "sigs", "nodes", "sizes", "shares"])

        for batch in batches:
            for rows in slices(batch, most=SLICE):
                (texts,) = columns(rows, "text")
                tokens, at = token_sets(texts, words)
                if not len(tokens):
                    continue
                sig, whose, rare = signatures(tokens, at, table, bits, percent)
                n = np.diff(at)
                node = node_names(tokens, at)
                held.append((sig >> U(64 - SIGNATURE_BITS), node[whose], n[whose].astype(np.uint32), (rare * 255 // np.maximum(n, 1)).astype(np.uint8)[whose]))
                if sum(len(x[0]) for x in held) >= FLUSH // 2:
                    yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()
        give_back()

    return docs.mapInArrow(work, "part int, sigs binary, nodes binary, sizes binary, shares binary")


def pairs_of(packed: DataFrame, percent: int, part_bits: int) -> DataFrame:
    """kind 0: a, b (the hub first); kind 1: a: a member list's name, b: a member, size."""

    def groups(rows: list[tuple], part: int) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([np.cumsum(expand(r[0], U), dtype=U) + (U(part) << U(SIGNATURE_BITS - part_bits)) for r in rows])
        node = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
        size = np.concatenate([expand(r[2], np.uint32) for r in rows]).astype(np.int64)
        share = np.concatenate([expand(r[3], np.uint8) for r in rows])
        order = np.lexsort((node, share, sig))
        sig, node, size, share = sig[order], node[order], size[order], share[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, size = sig[new], node[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.diff(np.append(first, len(sig)))
        left, right = [], []
        small = np.repeat((many > 1) & (many <= SMALL), many)
        for gap in range(1, SMALL):
            i = np.flatnonzero((sig[gap:] == sig[:-gap]) & small[gap:])
            left.append(i)
            right.append(i + gap)
        seen: set[int] = set()
        lists: list[tuple[np.ndarray, int]] = []
        for f, m in zip(first[many > SMALL], many[many > SMALL]):
            members = np.arange(f, f + m)
            name = int(mix64(np.array([np.sum(mix64(node[f : f + m].view(U)), dtype=U)], U)).view(np.int64)[0])
            if name in seen:
                continue
            seen.add(name)
            lists.append((members, name))
            for hub in (f, f + int(np.argmin(mix64(node[f : f + m].view(U))))):  # the same ones for lists that differ little
                others = members[members != hub]
                left.append(np.minimum(others, hub) if hub != f else np.full(len(others), hub))
                right.append(np.maximum(others, hub) if hub != f else others)
        i, j = np.concatenate(left), np.concatenate(right)
        fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        both = np.unique(np.stack([node[i][fits], node[j][fits]], 1), axis=0) if fits.any() else np.zeros((0, 2), np.int64)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(both), np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.zeros(len(both), np.int64))], names)
        for members, name in lists:
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(members), np.int32)), pa.array(np.full(len(members), name)), pa.array(node[members]), pa.array(size[members])], names)

    names = ["kind", "a", "b", "size"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in columns(batch, "part", "sigs", "nodes", "sizes", "shares"))):
                if p != part and rows:
                    yield from groups(rows, part)
                    rows = []
                part = p
                rows.append(row)
        if rows:
            yield from groups(rows, part)
        give_back()

    dealt = packed.repartition(min(1 << part_bits, MOST_TASKS), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(work, "kind int, a long, b long, size long")


# --- verification ---


def read_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, tokens (sorted), is_hub of wanted(doc_id, is_hub), and of a few more that share their bits.

    The bit tables choose the documents while they are read, so no text moves; a set says itself which node it is. A node
    that a copy brought in without the hub's bit comes again when a document with that bit turns up. Sets weigh far more than
    bits, so the tables are as wide as leaves few of those that only share a bit: one in a hundred of all documents.
    """
    bits = bits_for(8 * wanted.count())
    tables = [bit_table(wanted.select("doc_id"), bits), bit_table(wanted.filter("is_hub").select("doc_id"), bits)]
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, hubs = (np.frombuffer(x, np.uint8) for x in shared.value)
        met: dict[int, bool] = {}  # whether the node went out as hub
        for batch in batches:
            (slot,) = columns(batch, "slot")
            keep = is_marked(marks, slot)
            if not keep.any():
                continue
            chosen = batch.select(["text"]).append_column("is_hub", pa.array(is_marked(hubs, slot))).filter(pa.array(keep))
            for rows in slices(chosen, most=SLICE):
                texts, is_hub = columns(rows, "text", "is_hub")
                tokens, at = token_sets(texts, words)
                node = node_names(tokens, at)
                new = []
                for i, (name, hub) in enumerate(zip(node.tolist(), is_hub.to_pylist())):
                    if at[i + 1] > at[i] and (name not in met or hub and not met[name]):
                        met[name] = hub
                        new.append(i)
                sets = [tokens[at[i] : at[i + 1]].tobytes() for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(sets, pa.binary()), is_hub.take(pa.array(new, pa.int64()))], ["node", "tokens", "is_hub"])
        give_back()

    return docs.select("text", slot_of("doc_id", bits)).mapInArrow(work, "node long, tokens binary, is_hub boolean")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for batch in batches:
            a, b, x, y = columns(batch, "a", "b", "x", "y")
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i].as_py() != last:
                    last, hub = a[i].as_py(), np.frombuffer(x[i].as_py(), U)
                other = np.frombuffer(y[i].as_py(), U)
                at = np.minimum(np.searchsorted(hub, other), len(hub) - 1)
                common = int((hub[at] == other).sum())
                keep[i] = 100 * common >= percent * (len(hub) + len(other) - common)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))
        give_back()

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")
    both = with_b.join(sets.filter("is_hub").select(F.col("node").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def likely(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that can link by size and parity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x_n, y_n = (c.to_numpy() for c in columns(batch, "xn", "yn"))
                x, y = (c.to_pylist() for c in columns(batch, "x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array(differing(x, y) * (100 + percent) <= (x_n + y_n) * (100 - percent)))

    side = lambda k, p: bits.select(F.col("node").alias(k), F.col("n").alias(f"{p}n"), F.col("parity").alias(p))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "xn", "yn", "x", "y").mapInArrow(work, "a long, b long")


def _open_pairs(rows: pa.Table, percent: int, quota: int, done: set[tuple[int, int]]) -> tuple[list[tuple[int, int]], bool]:
    """Of one block of a list: pairs of minor nodes with nodes of other components that can link and weren't tested.

    Of what hangs together by such pairs a spanning forest comes out, and `quota` more pairs a node; and whether any others
    were left out.
    """
    node, n, label = (rows.column(c).to_numpy() for c in ("node", "n", "label"))
    minor, block = rows.column("minor").to_numpy(zero_copy_only=False), rows.column("block").to_numpy()
    failed = rows.column("failed").to_pylist()
    raw = rows.column("parity").to_pylist()
    wide = np.array([len(r) // 8 for r in raw])
    tables = {}
    for w in np.unique(wide).tolist():
        table = np.zeros((len(node), w), U)
        for v in (w, 2 * w, 4 * w):
            of = np.flatnonzero(wide == v)
            if len(of):
                table[of] = fold(np.frombuffer(b"".join(raw[i] for i in of), U).reshape(len(of), v), w)
        tables[w] = table
    order = np.flatnonzero(minor)
    order = order[np.argsort(mix64(node[order].view(U)))]
    turn = np.full(len(node), len(node))
    turn[order] = np.arange(len(order))
    apart = len(np.unique(block)) > 1  # pairs within one block are compared where that block stands alone
    up = {v: v for v in label.tolist()}

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out, left_out = [], False
    for x in order.tolist():
        y = np.flatnonzero((label != label[x]) & (turn > turn[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
        if apart:
            y = y[block[y] != block[x]]
        far = np.zeros(len(y), np.int64)
        for w in np.unique(np.minimum(wide[y], wide[x])).tolist():
            of = np.minimum(wide[y], wide[x]) == w
            far[of] = np.bitwise_count(tables[w][y[of]] ^ tables[w][x]).sum(1)
        y = y[far * (100 + percent) <= (n[y] + n[x]) * (100 - percent)]
        more = quota
        for j in y.tolist():
            pair = (int(node[x]), int(node[j]))
            if pair in done or pair[1] in (failed[x] or ()) or pair[0] in (failed[j] or ()):
                continue
            u, v = root(int(label[x])), root(int(label[j]))
            if u == v and more <= 0:
                left_out = True
                continue
            more -= u == v
            up[u] = v
            done.add(pair)
            out.append(pair)
    return out, left_out


def across(lists: DataFrame, labels: DataFrame, bits: DataFrame, failed: DataFrame, percent: int, quota: int) -> DataFrame:
    """a, b: pairs of one member list in different components that can link by size and parity and weren't tested; list:
    one that left such pairs out. Components only grow, so any other list is settled once the pairs are tested. Lists of
    more than two BLOCKs are compared block by block, in as many tasks: nodes outside a list's largest component with each
    other and with those inside, which aren't compared among themselves, so that a large component's rows don't multiply."""
    member = lists.join(labels, "node", "left").select("list", "node", F.coalesce("label", "node").alias("label"))
    member = Table(member, "members").df
    shares = member.groupBy("list", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = shares.groupBy("list").agg(F.count(F.lit(1)).alias("labels"), F.sum("k").alias("many"), F.max(F.struct("k", "label")).alias("m")).filter("labels > 1")
    blocks = lambda many: F.when(F.col("many") > 2 * BLOCK, F.ceil(many / BLOCK).cast("int")).otherwise(0)
    mixed = mixed.select("list", F.col("m.label").alias("major"), blocks(F.col("many") - F.col("m.k")).alias("minors"), blocks(F.col("m.k")).alias("majors"))
    mixed = Table(mixed, "mixed").df
    tried = failed.groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("failed"))
    open_ = Table(member.join(mixed, "list"), "open").df
    nodes = open_.select("node").distinct()
    size = bits_for(nodes.count())
    told = only_marked(bits, "node", bit_table(nodes, size), size)
    open_ = open_.join(told, "node").join(tried, "node", "left")
    minor, turn = F.col("label") != F.col("major"), F.xxhash64("node")
    block = F.when(F.col("minors") == 0, 0).when(minor, F.pmod(turn, "minors")).otherwise(F.col("minors") + F.pmod(turn, "majors")).cast("int")
    last = F.when(F.col("minors") == 0, 0).when(minor, F.col("minors") + F.col("majors") - 1).otherwise(F.col("minors") - 1)
    open_ = open_.select("list", "node", "n", "label", minor.alias("minor"), "parity", "failed", block.alias("block"), last.alias("last"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    key = F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        done: set[tuple[int, int]] = set()

        def compared() -> pa.RecordBatch:
            found, left_out = _open_pairs(pa.Table.from_batches(held), percent, quota, done)
            rows = [(None, min(x), max(x)) for x in found] + [(held[0].column("list")[0].as_py(), None, None)] * left_out
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["list", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(edges, edges[1:]):
                if held and keys[i] != last:
                    yield compared()
                last = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield compared()
        give_back()

    dealt = open_.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    return dealt.drop("last", "other").mapInArrow(work, "list long, a long, b long").distinct()


def join_documents(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, th, n, node), (labels: node, label), of which a node without a link has none."""
    docs = docs.select("doc_id", text_of(docs).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(20, power(total // 6 + 1)))
    part_bits = min(MOST_PART_BITS, bits - 4, max(6, power(total // PART_BYTES + 1)))
    scan = Table(first_scan(docs, words, bits, part_bits), "scan", by="kind")
    marks = frequent_slots(scan.df.filter("kind = 1"), bits, part_bits, rare)
    scan.drop("kind=1")
    first = scan.df.filter("kind = 0")
    rows = first.select("doc_id", "th", "n", "node")
    found = Table(pairs_of(second_scan(docs, words, percent, marks, bits, part_bits), percent, part_bits), "pairs").df
    tested = Table(found.filter("kind = 0").select("a", "b").distinct(), "tested").df
    lists = Table(found.filter("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node")).distinct(), "lists").df
    names = Table(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "names").df
    nodes = Table(tested.select(F.col("a").alias("node")).unionByName(tested.select(F.col("b").alias("node"))).unionByName(lists.select("node")).distinct(), "nodes").df
    size = bits_for(nodes.count())
    told = only_marked(first.select("node", "n", "parity"), "node", bit_table(nodes, size), size)
    parity = Table(told.groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "parity").df
    pairs = Table(likely(tested, parity, percent), "likely").df
    links = _linked(docs, pairs, names, words, percent)
    failed = Table(pairs.join(links, ["a", "b"], "left_anti"), "failed").df
    labels, quota = components(links), QUOTA
    while True:
        rest = Table(across(lists, labels, parity, failed, percent, quota), "rest").df
        pairs, left_out = rest.filter("list IS NULL").select("a", "b"), rest.filter("list IS NOT NULL").select("list")
        if pairs.isEmpty():
            return rows, labels
        new = _linked(docs, pairs, names, words, percent)
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(links)
        if left_out.isEmpty():
            return rows, labels
        failed = Table(failed.unionByName(pairs.join(new, ["a", "b"], "left_anti")), "failed").df
        lists = Table(lists.join(left_out, "list", "left_semi"), "lists").df
        quota *= 8


def _linked(docs: DataFrame, pairs: DataFrame, names: DataFrame, words: int, percent: int) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node"), F.lit(True).alias("is_hub")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(False).alias("is_hub")))
    nodes = nodes.groupBy("node").agg(F.bool_or("is_hub").alias("is_hub"))
    wanted = Table(names.join(nodes, "node").select("doc_id", "is_hub"), "wanted").df
    sets = Table(read_sets(docs, wanted, words), "sets")
    links = Table(verify(pairs, sets.df, percent).distinct(), "linked").df
    sets.drop()
    return links


def _report(docs: DataFrame, words: int, percent: int, rare: int) -> DataFrame:
    """doc_id, th, n, least: the (doc_id, th) that is smallest in the document's component, null ids after all others."""
    rows, labels = join_documents(docs, words=words, percent=percent, rare=rare)
    own = rows.join(labels, "node", "left").select("doc_id", "th", "n", F.coalesce("label", "node").alias("label"))
    own = Table(own, "own").df
    least = own.filter("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("least"))
    least = Table(least.select("label", F.col("least.doc_id").alias("least_id"), F.col("least.th").alias("least_th")), "least").df
    return own.join(least, "label", "left")


def components_report(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    met = _report(docs, words, percent, rare)
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all columns; documents without words all stay.

    A document is its doc_id and its text: of one id with two texts only that goes which is another's near copy. Rows that
    repeat both stay or go together.
    """
    met = _report(docs, words, percent, RARE).filter("n > 0")
    gone = met.filter(~(F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("th") == F.col("least_th")))).select("doc_id", "th")
    return without(docs, Table(gone.distinct(), "gone").df)


ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS t FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, b AS u FROM ends UNION SELECT r.v, e.b FROM reach r JOIN ends e ON r.u = e.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(u), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON v = n.doc_id GROUP BY n.doc_id, n.n
"""
