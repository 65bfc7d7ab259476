"""String and number scalars as Column expressions, with the white space and number rules of the sources' origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers and spreadsheets' exporters trim it.
W = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Particles of surnames that stay in lower case.
PARTICLES = ("da", "de", "del", "van", "von", "bin", "binti")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


#: The same characters, one by one.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def one_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, rf"{W}+", " "))


def normalize_header(c: Column) -> Column:
    c = F.replace(F.lower(js_trim(c)), F.lit("&"), F.lit(" and "))
    return one_space(F.regexp_replace(c, r"[/_.;:()\[\]-]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_header(c), " "), lambda t: t != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of normalised headers; 0 if either is empty."""
    a, b = normalize_header(a), normalize_header(b)
    return similarity_normal(a, b)


def similarity_normal(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def title_case(c: Column) -> Column:
    def word(p: Column) -> Column:
        plain = F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
        return F.when(p.rlike(r"^(?:[A-Za-z]\.)+$"), F.upper(p)).when(F.lower(p).isin(*PARTICLES), F.lower(p)).otherwise(plain)

    return F.array_join(F.transform(F.split(one_space(c), " "), word), " ")


# Forms of address that are no part of a name.
HONORIFICS = "dr|mr|mrs|ms|miss|prof|sir"


def strip_honorific(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, rf"(?i)^{W}*({HONORIFICS})\.?{W}+", ""))


def split_person_name(c: Column) -> Column:
    """struct<first, last>, null if nothing is left: "Last, First", a single word, or all but the last word first."""
    clean = strip_honorific(one_space(c))
    halves = F.transform(F.split(clean, ","), js_trim)
    last, rest = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    parts = F.split(clean, " ")
    n = F.size(parts)
    made = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    return (
        F.when(clean == "", F.lit(None))
        .when(F.contains(clean, F.lit(",")) & (last != "") & (rest != ""), made(title_case(rest), title_case(last)))
        .when(n == 1, made(title_case(F.get(parts, F.lit(0))), F.lit("")))
        .otherwise(made(title_case(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")), title_case(F.get(parts, n - 1))))
    )


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def looks_email(c: Column) -> Column:
    plain = W[1:-1]
    return js_trim(c).rlike(rf"^[^{plain}@]+@[^{plain}@]+\.[^{plain}@]+$")


def email_domain(c: Column) -> Column:
    """What stands between the first and the second @, in lower case; empty without one."""
    return F.coalesce(F.get(F.split(F.lower(js_trim(c)), "@"), F.lit(1)), F.lit(""))


def looks_phone(c: Column) -> Column:
    return F.length(digits_only(c)).between(10, 13)


def looks_iso_date(c: Column) -> Column:
    return js_trim(c).rlike(r"^\d{4}-\d{2}-\d{2}")


def is_blank(c: Column) -> Column:
    t = js_trim(c)
    return c.isNull() | t.isin("", "-", "null", "NULL") | t.rlike(r"(?i)^n/?a$")


def parse_number(c: Column) -> Column:
    """Digits with grouping marks, currency signs or INR around them; null if that is no finite number."""
    t = F.regexp_replace(F.regexp_replace(c, rf"[,₹$€]|{W}", ""), r"(?i)^(.*?)inr", "$1")
    hexadecimal = F.conv(F.substring(t, 3, 16), 16, 10).cast("double")
    plain = F.when(t.rlike(NUMBER), t.try_cast("double"))
    number = F.when(t.rlike(r"^0[xX][0-9A-Fa-f]{1,15}$"), hexadecimal).otherwise(plain)
    return F.when((t != "") & (F.abs(number) < float("inf")), number)


def number_text(c: Column) -> Column:
    """A double as its shortest text: no point or zeros behind a whole number."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def money(c: Column) -> Column:
    """Indian grouping, 9,80,000, and up to three decimals; a dash for nothing; what is no number as it is."""
    text = c.cast("string")
    n = parse_number(text)
    fixed = F.format_string("%.3f", F.abs(n))
    whole = F.regexp_extract(fixed, r"^(\d+)", 1)
    part = F.regexp_replace(F.regexp_replace(fixed, r"^\d+", ""), r"\.?0+$", "")
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(_pairs(F.left(whole, F.length(whole) - 3)), F.lit(","), F.right(whole, F.lit(3))))
    shown = F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), grouped, part)
    return F.when(c.isNull() | (text == ""), F.lit("—")).when(n.isNull(), text).otherwise(shown)


def _pairs(c: Column) -> Column:
    return F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(c), r"(..)", "$1,"), ",$", ""))


def display(c: Column) -> Column:
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit("—")).otherwise(c.cast("string"))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def clock(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss")
