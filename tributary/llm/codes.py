"""Vector code compression: product codes whose codebooks are searched through kd-trees.

A vector's components become integers and are cut into consecutive parts; each part position has a codebook. Every round
broadcasts one kd-tree a codebook (ENTRIES * dimension integers in all, whatever the data). Tasks search it by branch and
bound, a node's bound being the exact distance to its box: nodes whose bound equals the best distance are visited too, so
that of equally near entries the lowest index wins, as in a full scan. Each task adds its parts up by entry, in integers,
so that a round shuffles at most one row a task and entry; the driver divides the sums.

Defined results: rows whose vector is null, empty, holds null or non-finite components, or has not the length that most
such vectors have (of equally many the greatest), are dropped; where that length isn't a multiple of the number of parts,
the last part is filled up with zeros, which enter no distance; components beyond 2**30 / sqrt(length) saturate there, so
that errors fit a long (with 64 components: beyond 524,288 before they are scaled); repeated rows are coded and counted
each; of rows that share a vec_id the least vector seeds the codebooks, a null vec_id is the last; null labels are one
label; an error sum beyond a long is null; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import BROADCAST_ROWS, Table, columns, give_back

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries in a leaf of a tree, at most.
LEAF = 8
#: Vectors that a task searches for at once.
ROWS = 4096


@dataclass
class Node:
    """Entries (ascending indexes) in their box; a leaf has no children."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    at: int = 0
    children: tuple[Node, Node] | None = None


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """A kd-tree over the rows of book, cut at the median of the axis on which they spread most."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    node = Node(entries, own.min(0), own.max(0))
    spread = node.high - node.low
    if len(entries) <= LEAF or not spread.any():
        return node
    node.axis = int(spread.argmax())
    along = own[:, node.axis]
    node.at = int(np.sort(along)[(len(along) - 1) // 2])
    if node.at == node.high[node.axis]:  # the median is the greatest value: all below it go left
        node.at -= 1
    left = along <= node.at
    node.children = (tree(book, entries[left]), tree(book, entries[~left]))
    return node


def nearest(book: np.ndarray, root: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each point, of equally near ones the lowest."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(book), np.int64)

    def bound(node: Node, who: np.ndarray) -> np.ndarray:
        own = points[who]
        off = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        return (off * off).sum(1)

    def visit(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.children is None:
            own = points[who]
            apart = np.zeros((len(who), len(node.entries)), np.int64)
            for axis in range(points.shape[1]):
                off = own[:, axis, None] - book[node.entries, axis]
                apart += off * off
            k = apart.argmin(1)  # the first of equals, entries being in order
            found, entry = apart[np.arange(len(who)), k], node.entries[k]
            better = (found < best[who]) | (found == best[who]) & (entry < index[who])
            best[who[better]], index[who[better]] = found[better], entry[better]
            return
        left = points[who, node.axis] <= node.at
        sides = (who[left], who[~left])
        for near, child in zip(sides, node.children):
            visit(child, near)
        for near, far in zip(sides, reversed(node.children)):
            visit(far, near[bound(far, near) <= best[near]])  # equal bounds too: a lower index may lie there

    visit(root, np.arange(len(points)))
    return index, best


def most(dimension: int) -> float:
    return float(int(2**30 / dimension**0.5))


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integers(batch: pa.RecordBatch, dimension: int, width: int, scale: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch's kept rows and their integer components, PARTS * width a row."""
    (vectors,) = columns(batch, "vector")
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False))
    (vectors,) = columns(batch, "vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    flat = flat.reshape(len(batch), dimension)
    kept = np.isfinite(flat).all(1)
    limit = most(dimension)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat[kept] * scale), -limit, limit).astype(np.int64)
    out = np.zeros((len(whole), PARTS * width), np.int64)
    out[:, :dimension] = whole
    return batch.filter(pa.array(kept)), out


@dataclass
class Books:
    """Codebooks (part, entry, component) with their trees, and how vectors are read."""

    dimension: int
    scale: int
    books: np.ndarray

    def sha256(self) -> str:
        width = self.books.shape[2]
        used = np.arange(PARTS * width).reshape(PARTS, 1, width) < self.dimension
        values = self.books[np.broadcast_to(used, self.books.shape)]
        return hashlib.sha256(",".join(map(str, values.tolist())).encode()).hexdigest()


def assigned(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Kept rows with their integer parts (part, row, component), entries and squared distances (part, row)."""
    known: Books = shared.value
    width = known.books.shape[2]
    trees = [tree(book) for book in known.books]
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows, whole = integers(batch.slice(k, ROWS), known.dimension, width, known.scale)
            if not rows.num_rows:
                continue
            parts = np.ascontiguousarray(whole.reshape(-1, PARTS, width).swapaxes(0, 1))
            found = [nearest(book, root, part) for book, root, part in zip(known.books, trees, parts)]
            yield rows, parts, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
    give_back()


def start(vectors: DataFrame, scale: int) -> Books | None:
    """Codebooks made of the parts of the vectors with the ENTRIES smallest ids; None without vectors."""
    kept = vectors.filter(valid(F.col("vector")))
    common = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if common is None:
        return None
    dimension = common["d"]
    kept = kept.filter(F.size("vector") == dimension)
    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES)
    limit = most(dimension)
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))))
    first = F.broadcast(ids.select(F.col("vec_id").alias("seed")))  # ENTRIES rows
    seeds = kept.join(first, F.col("vec_id").eqNullSafe(F.col("seed"))).groupBy("seed").agg(F.min(whole).alias("whole"))
    rows = seeds.orderBy(F.col("seed").asc_nulls_last()).select("whole").collect()
    width = -(-dimension // PARTS)
    books = np.zeros((len(rows), PARTS * width), np.int64)
    books[:, :dimension] = [r["whole"] for r in rows]
    return Books(dimension, scale, np.ascontiguousarray(books.reshape(len(rows), PARTS, width).swapaxes(0, 1)))


def improved(vectors: DataFrame, known: Books) -> Books:
    """One round: each entry becomes the floored mean of the parts assigned to it; unused entries stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(known)
    entries, width = known.books.shape[1:]
    names = [f"s{i}" for i in range(width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, entries), np.int64)
        total = np.zeros((PARTS, entries, width), np.int64)
        for _, parts, index, _ in assigned(shared, batches):
            for p in range(PARTS):
                count[p] += np.bincount(index[p], minlength=entries)
                for i in range(width):  # sums of one batch are far below 2**53, so they are exact
                    total[p, :, i] += np.bincount(index[p], weights=parts[p, :, i], minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *[pa.array(total[p, e, i]) for i in range(width)]], ["part", "entry", "n", *names])

    sums = vectors.select("vector").mapInArrow(work, f"part int, entry int, n long, {', '.join(f'{s} long' for s in names)}")
    books = known.books.copy()
    # PARTS * ENTRIES rows at most
    for row in sums.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        books[row["part"], row["entry"]] = [row[s] // row["n"] for s in names]
    shared.destroy()
    return Books(known.dimension, known.scale, books)


def coded(vectors: DataFrame, known: Books) -> DataFrame:
    """vec_id, label, code, error of each kept row."""
    shared = vectors.sparkSession.sparkContext.broadcast(known)
    digit = np.frombuffer(b"0123456789abcdef", np.uint8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, index, apart in assigned(shared, batches):
            text = np.stack([digit[index >> 4], digit[index & 15]], 2)  # part, row, digit
            text = np.ascontiguousarray(text.swapaxes(0, 1)).reshape(rows.num_rows, 2 * PARTS)
            code = pa.array(text.view(f"S{2 * PARTS}").ravel(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns(rows, "vec_id", "label"), code, pa.array(apart.sum(0))], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "label", "vector").mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, *, column: str = "embedding", rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books | None]:
    """(vec_id, label, code, error of each kept row; the codebooks)."""
    own = vectors.select("vec_id", "label", F.col(column).alias("vector"))
    known = start(own, scale)
    if known is None:
        kinds = {f.name: f.dataType.simpleString() for f in own.schema}
        return own.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), None
    for _ in range(rounds):
        known = improved(own, known)
    return coded(own, known), known


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    found, known = compress(vectors)
    rows = Table(found, "codes").df  # read by labels and by rows
    sums = rows.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error"))
    # few labels are broadcast, so that a label of most rows is no hot key of a join
    few = rows.select("label").distinct().count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("same")), "left")
    return met.select("vec_id", "code", "error", "label_error", F.lit(known.sha256() if known else None).cast("string").alias("codebooks_sha256"))


ORACLE = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS w
  FROM kept, (SELECT unnest(range(16)) AS p)
), b0 AS (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS k, w FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), {rounds}, last AS ({assign}), each AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY p) AS code,
    CAST(sum(best // 64) AS BIGINT) AS error
  FROM last GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256
  FROM (SELECT p, k, unnest(w) AS x, unnest(range(len(w))) AS i FROM b2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM each, books
"""
_ASSIGN = """
  SELECT vec_id, label, q.p, any_value(q.w) AS w,
    min(CAST(list_sum(list_transform(list_zip(q.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + b.k) AS best
  FROM parts q JOIN {book} b ON b.p = q.p GROUP BY vec_id, label, q.p"""
_ROUND = """a{r} AS ({assign}), b{r} AS (
  SELECT b.p, b.k, coalesce(n.w, b.w) AS w FROM {book} b LEFT JOIN (
    SELECT p, k, list(m ORDER BY i) AS w FROM (
      SELECT p, k, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
      FROM (SELECT p, best % 64 AS k, unnest(w) AS x, unnest(range(len(w))) AS i FROM a{r}) GROUP BY p, k, i
    ) GROUP BY p, k) n ON n.p = b.p AND n.k = b.k)"""
ORACLE = ORACLE.format(
    rounds=", ".join(_ROUND.format(r=r, book=f"b{r - 1}", assign=_ASSIGN.format(book=f"b{r - 1}")) for r in (1, 2)), assign=_ASSIGN.format(book="b2")
)
