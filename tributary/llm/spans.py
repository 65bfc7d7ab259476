"""Finding spans in whole texts: cheap tests on a batch's bytes choose the texts that patterns then read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import ascii_set, bytes_of, columns, lower_bytes, runs, slices

Span = tuple[str, int, int]

IS_HEX = ascii_set("0123456789abcdef")
IS_DIGIT = ascii_set("0123456789")


def either_case(word: str) -> str:
    """A pattern for ASCII letters of either case; IGNORECASE would let in letters such as the long s."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def texts_with(raw: bytes, starts: np.ndarray, needles: list[bytes]) -> np.ndarray:
    """Which texts hold any of the needles within them."""
    at = []
    for needle in needles:
        k = raw.find(needle)
        while k >= 0:
            d = int(np.searchsorted(starts, k, "right")) - 1
            if k + len(needle) <= starts[d + 1]:
                at.append(d)
                k = raw.find(needle, int(starts[d + 1]))  # on to the next text
            else:
                k = raw.find(needle, k + 1)
    out = np.zeros(len(starts) - 1, bool)
    out[at] = True
    return out


def texts_with_run(mask: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    a, b = runs(mask, starts)
    out = np.zeros(len(starts) - 1, bool)
    long = a[b - a >= least]
    out[np.searchsorted(starts, long, "right") - 1] = True
    return out


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def scan(docs: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray], find: Callable[[str], tuple[list[Span], list[Span]]], base: tuple[str, ...], added: tuple[str, ...]) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, n_added.

    chosen(bytes, starts) says which texts can hold anything at all; find(text) gives base spans and added spans. A null
    text counts as empty; rows are independent, so no key, repeat or long text of one row bears on another.
    """
    kinds = base + added
    none = hashlib.sha256(b"").hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                ids, texts = columns(rows, "doc_id", "text")
                data, starts = bytes_of(texts)
                n = len(ids)
                counts = {k: np.zeros(n, np.int64) for k in base}
                more = np.zeros(n, np.int64)
                shas, says = [none] * n, [""] * n
                for i in np.flatnonzero(chosen(data, starts)):
                    own, extra = find(texts[int(i)].as_py())
                    for k, _, _ in own:
                        counts[k][i] += 1
                    more[i] = len(extra)
                    if own:
                        shas[i] = hashlib.sha256(joined(own, kinds).encode()).hexdigest()
                    says[i] = joined([*own, *extra], kinds)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(counts[k]) for k in base], pa.array(shas), pa.array(says), pa.array(more)], ["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in base)}, base_sha256 string, spans string, n_added long")


def lowered(data: np.ndarray) -> bytes:
    return lower_bytes(data).tobytes()
