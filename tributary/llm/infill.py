"""Fill-in-middle transformation: texts cut at two units and put together again around sentinels.

One Aho-Corasick automaton a kind of unit finds all that matters in a text: sentinels, and the ASCII characters at which the
class of characters changes (none for code points, line feeds for lines, white space for words). What lies between two
such events is of one class, so that its units are counted by arithmetic: as many as code points, or one, or none. The
events alone, with units counted up to each, answer how many units a text has and where the unit of a given rank ends.

Where a text is cut and in which form it is put together follows from a hash of its doc_id, so reruns agree and no order or
partition matters; rows are independent, and nothing is shuffled.

Defined results: a null text is the empty text, which stays plain; a text that holds a sentinel stays plain, as it couldn't
be taken apart again; a null doc_id hashes as the empty text; texts of any length are read whole, once; repeated rows give
equal rows; an empty table gives an empty result; other columns stay, and those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import SPACES, columns, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: The characters that begin or end a unit: of a code point, a line with its line feed, a run of white space or of others.
CHANGES = {"char": "", "line": "\n", "word": SPACES}
#: Bytes of text that are transformed at once.
SLICE = 2 << 20

RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


@cache
def automaton(unit: str) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word in (*SENTINELS, *CHANGES[unit]):
        made.add_word(word, word)
    made.make_automaton()
    return made


class Units(NamedTuple):
    """A text's units: how many there are up to each place; between two places they are counted by arithmetic."""

    unit: str
    places: list[int]
    counts: list[int]
    sentinels: list[tuple[int, str]]

    @property
    def n(self) -> int:
        return self.counts[-1]

    def end(self, rank: int) -> int:
        """How many code points the first `rank` units take."""
        k = bisect_left(self.counts, rank)
        if self.unit != "char" or self.counts[k] == rank:
            return self.places[k]
        return self.places[k] - (self.counts[k] - rank)  # in a gap each code point is a unit


def units(text: str, unit: str = "char") -> Units:
    """Places are event ends, and for words the ends of units, so that each unit's end is a place or lies in a gap."""
    places, counts, sentinels = [0], [0], []
    space = False  # whether the unit that reaches up to the last place is white space
    for last, word in automaton(unit).iter(text):
        if len(word) > 1:
            sentinels.append((last + 1 - len(word), word))
            continue
        gap = last - places[-1]
        if unit == "line":
            places.append(last + 1)
            counts.append(counts[-1] + 1)
            continue
        if gap:  # a word ends before this character
            places.append(last)
            counts.append(counts[-1] + 1)
            space = False
        if space:
            places[-1] = last + 1  # the white space goes on
        else:
            places.append(last + 1)
            counts.append(counts[-1] + 1)
            space = True
    gap = len(text) - places[-1]
    if gap:
        places.append(len(text))
        counts.append(counts[-1] + (gap if unit == "char" else 1))
    return Units(unit, places, counts, sentinels)


class Draw(NamedTuple):
    first: int
    second: int
    change: int
    order: int


def drawn(doc_id: object, salt: str = "1:") -> Draw:
    """Four numbers of 32 bits that a document's id stands for."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return Draw(*(int(digest[8 * i : 8 * i + 8], 16) for i in range(4)))


def transformed(text: str, by: Draw, unit: str = "char", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    found = units(text, unit)
    if not text or found.sentinels or by.change % 100 >= changed:
        return found.n, "plain", None, None, text
    ranks = sorted((by.first % (found.n + 1), by.second % (found.n + 1)))
    a, b = (found.end(r) for r in ranks)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if by.order % 100 < suffix_first:
        return found.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return found.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of: its sentinels, found by the same automaton, say where its pieces lie."""
    if form == "plain":
        return output
    at = units(output).sentinels
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    if tuple(word for _, word in at) != order:
        raise ValueError(f"not an output of form {form}")
    ends = [*(k for k, _ in at[1:]), len(output)]
    piece = {word: output[k + len(word) : end] for (k, word), end in zip(at, ends)}
    return piece[PREFIX] + piece[MIDDLE] + piece[SUFFIX]


def fill_in_middle(docs: DataFrame, *, unit: str = "char", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, salt: str = "1:") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain), output."""
    if unit not in CHANGES:
        raise ValueError(f"units are {', '.join(CHANGES)}")
    kept = docs.drop(*RESULT.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                ids, texts = columns(rows, "doc_id", "text")
                made = [transformed(t or "", drawn(d, salt), unit, changed, suffix_first) for d, t in zip(ids.to_pylist(), texts.to_pylist())]
                new = [pa.array(x, kind) for x, kind in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, *RESULT.names])

    own = kept.withColumn("text", F.col("text").cast("string"))
    return own.mapInArrow(work, T.StructType([*own.schema.fields, *RESULT.fields]))


def restore(made: DataFrame) -> DataFrame:
    """made(output, form, …) with `restored`, rebuilt from those two alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "output", SLICE):
                outputs, forms = columns(rows, "output", "form")
                texts = [restored(o, f) for o, f in zip(outputs.to_pylist(), forms.to_pylist())]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "restored"])

    kept = made.drop("restored")
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = restore(fill_in_middle(docs.select("doc_id", "text")).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    list_transform(range(4), lambda i: list_reduce(
      list_transform(range(8), lambda j: CAST(instr('0123456789abcdef', substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), i * 8 + j + 1, 1)) - 1 AS BIGINT)),
      lambda x, y: x * 16 + y)) AS h
  FROM documents
), chosen AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), pieces AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
