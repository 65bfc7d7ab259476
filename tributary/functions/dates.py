"""Strict dates: a day is read only if one reading is possible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.text import W, js_trim

# Month names by their first three letters, and the four forms of dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PLAIN = r"^(\d{4})-(\d{2})-(\d{2})"
NAMED = r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ,](\d{2,4})$"
AMERICAN = rf"^([A-Za-z]{{3,9}}){W}+(\d{{1,2}}),?{W}+(\d{{2,4}})$"
NUMERIC = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
# The sentences that say how a date was read.
GOOD = {"P": "ISO-8601", "N": "day-month-year with month name", "A": "month-name date"}
BAD = {"P": "ISO date is not a real calendar day", "N": "Named-month date is not a real calendar day", "A": "Named-month date is not a real calendar day"}
DAY_FIRST, MONTH_FIRST = "DMY (day > 12, unambiguous)", "MDY (second part > 12, unambiguous)"
OPEN, SAME, NO_DAY, UNKNOWN = "day and month are interchangeable", "numeric date", "numeric date is not a real calendar day", "unrecognised date format"
#: Between the parts of a date whose form is known.
MARK = "\x01"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: else each use in body repeats its expression, and uses multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_day(y: Column, m: Column, d: Column, first: int, last: int) -> Column:
    """Whether the calendar has the day, in the years allowed. False for nulls; nothing throws in ANSI mode."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(y.between(first, last) & m.between(1, 12) & (d >= 1) & (d <= days), F.lit(False))


def iso(y: Column, m: Column, d: Column, first: int = 1940, last: int = 2035) -> Column:
    """yyyy-MM-dd of such a day, else null."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(is_day(y, m, d, first, last), F.concat_ws("-", y.cast("string"), two(m), two(d)))


def year_of(y: Column) -> Column:
    return y + F.when(y >= 100, 0).when(y >= 30, 1900).otherwise(2000)


def parse_date(c: Column, first: int = 1940, last: int = 2035) -> Column:
    """struct<status: ok, ambiguous, invalid or empty; iso; reason; dmy; mdy>.

    Each form writes a date as its letter and three parts, in one pass a form; all else works on those parts.
    """
    none = F.lit(None).cast("string")

    def out(status: Column | str, value: Column, reason: Column | str, x: Column = none, z: Column = none) -> Column:
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(lit(status).alias("status"), value.alias("iso"), lit(reason).alias("reason"), x.alias("dmy"), z.alias("mdy"))

    def month(word: Column) -> Column:
        at = F.instr(F.lit("".join(MONTHS)), F.lower(F.substring(word, 1, 3)))
        return F.when((F.length(word) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))

    def one_reading(p: Column) -> Column:
        kind, number = p["k"], lambda x: x.try_cast("int")
        y = F.when(kind == "P", number(p["a"])).otherwise(year_of(number(p["c"])))
        m = F.when(kind == "P", number(p["b"])).when(kind == "N", month(p["b"])).otherwise(month(p["a"]))
        d = F.when(kind == "P", number(p["c"])).when(kind == "N", number(p["a"])).otherwise(number(p["b"]))
        say = lambda words: F.when(kind == "P", words["P"]).when(kind == "N", words["N"]).otherwise(words["A"])
        day = F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        return bind(day, lambda x: F.when(is_day(x["y"], x["m"], x["d"], first, last), out("ok", iso(x["y"], x["m"], x["d"], first, last), say(GOOD))).otherwise(out("invalid", none, say(BAD))))

    def two_readings(p: Column) -> Column:
        def decide(r: Column) -> Column:
            d, m = r["dmy"], r["mdy"]
            return (
                F.when((r["a"] > 12) & d.isNotNull(), out("ok", d, DAY_FIRST))
                .when((r["b"] > 12) & m.isNotNull(), out("ok", m, MONTH_FIRST))
                .when(d.isNotNull() & m.isNotNull() & (d != m), out("ambiguous", none, OPEN, d, m))
                .when(d.isNotNull(), out("ok", d, SAME))
                .otherwise(out("invalid", none, NO_DAY))
            )

        def read(n: Column) -> Column:
            both = F.struct(iso(n["y"], n["b"], n["a"], first, last).alias("dmy"), iso(n["y"], n["a"], n["b"], first, last).alias("mdy"), n["a"].alias("a"), n["b"].alias("b"))
            return bind(both, decide)

        return bind(F.struct(p["a"].cast("int").alias("a"), p["b"].cast("int").alias("b"), year_of(p["c"].cast("int")).alias("y")), read)

    def read(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        p = F.struct(*[at(i).alias(n) for i, n in enumerate("kabc")])
        known = F.size(parts) > 3
        return (
            F.when(at(0) == "", out("empty", none, ""))
            .when(known & (at(0) == "D"), bind(p, two_readings))
            .when(known, bind(p, one_reading))
            .otherwise(out("invalid", none, UNKNOWN))
        )

    text = F.translate(js_trim(c), MARK, "?")
    for letter, pattern in (("D", NUMERIC), ("P", PLAIN), ("N", NAMED), ("A", AMERICAN)):
        text = F.regexp_replace(text, pattern, f"{letter}{MARK}$1{MARK}$2{MARK}$3{MARK}")
    return bind(F.split(text, MARK), read)
