"""Cleaning of one value for one target field: struct<value, confidence, transform, issue>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.functions.dates import bind, parse_date
from tributary.functions.text import W, digits_only, email_domain, is_blank, js_trim, looks_email, number_text, parse_number, title_case

CLEAN = "struct<value:string,confidence:double,transform:string,issue:string>"


def canonical_id(c: Column, prefix: str = "apx") -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(js_trim(c), rf"(?i)^{prefix}[-_]?", ""), r"\.0$", ""))


def clean_phone(c: Column) -> Column:
    def local(d: Column) -> Column:
        return F.when((F.length(d) == 12) & d.startswith("91"), F.substr(d, F.lit(3))).otherwise(d)

    def international(d: Column) -> Column:
        n = F.length(d)
        return (
            F.when(n == 10, F.concat(F.lit("+91"), d))
            .when((n == 11) & d.startswith("0"), F.concat(F.lit("+91"), F.substr(d, F.lit(2))))
            .when(n.between(10, 13), F.concat(F.lit("+"), d))
        )

    return bind(bind(digits_only(c), local), international)


def _out(value: Column, confidence: float, transform: Column | str | None = None, issue: str | None = None) -> Column:
    transform = F.lit(transform).cast("string") if transform is None or isinstance(transform, str) else transform
    return F.struct(value.cast("string").alias("value"), F.lit(confidence).alias("confidence"), transform.alias("transform"), F.lit(issue).cast("string").alias("issue")).cast(CLEAN)


def clean_value(key: str, raw: Column, config: Config | None = None) -> Column:
    """The cleaned value of `raw` for the target field `key`; its expression is chosen when the plan is made."""
    config = config or Config()
    return F.when(is_blank(raw), _out(F.lit(None), 1.0, "empty")).otherwise(bind(js_trim(raw), lambda text: _clean_text(key, text, config)))


# Fixed values within: what a transform is called, how sure its result is, and the codes of issues.
def _clean_text(key: str, text: Column, config: Config) -> Column:
    spec = config.by_key.get(key)
    kind = spec.type if spec else "string"
    if key == "employeeNumber":
        got = _out(canonical_id(text, config.id_prefix), 0.96, "strip client prefix, keep id")
    elif key in ("firstName", "lastName"):
        got = _out(title_case(text), 0.95, "title case")
    elif kind == "email":
        got = bind(
            F.lower(text),
            lambda mail: F.when(~looks_email(mail), _out(mail, 0.2, None, "invalid"))
            .when(email_domain(mail).isin(*config.policy.personal_domains), _out(mail, 0.4, "lowercased", "personal_email"))
            .otherwise(_out(mail, 0.97, "lowercased")),
        )
    elif kind == "phone":
        got = bind(clean_phone(text), lambda phone: F.when(phone.isNull(), _out(text, 0.3, None, "invalid")).otherwise(_out(phone, 0.93, "E.164 (IN)")))
    elif kind == "date":
        none = F.lit(None)
        got = bind(
            parse_date(text, config.policy.first_year, config.policy.last_year),
            lambda parsed: F.when(parsed["status"] == "empty", _out(none, 1.0))
            .when(parsed["status"] == "ambiguous", _out(none, 0.45, None, "ambiguous_date"))
            .when(parsed["status"] == "invalid", _out(text, 0.2, None, "invalid"))
            .otherwise(_out(parsed["iso"], 0.98, parsed["reason"])),
        )
    elif kind == "enum":
        words = config.enum_synonyms.get(key, {})
        known = {v.lower(): v for v in reversed(spec.values)}
        low = F.lower(text)
        mapped = F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), low) if words else F.lit(None).cast("string")
        exact = F.try_element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), low)
        got = (
            F.when(mapped.isNotNull(), _out(mapped, 0.94, F.concat(text, F.lit(" → "), mapped)))
            .when(exact.isNotNull(), _out(exact, 0.99))
            .otherwise(_out(text, 0.35, None, "unknown_enum"))
        )
    elif kind == "number":
        got = bind(parse_number(text), lambda n: F.when(n.isNull(), _out(text, 0.2, None, "invalid")).otherwise(_out(number_text(n), 0.95, "parsed number")))
    elif spec and spec.pattern:
        code = F.regexp_replace(F.upper(text), rf"{W}+", "")
        got = F.when(~code.rlike(spec.pattern), _out(code, 0.4, None, "invalid")).otherwise(_out(code, 0.96, "uppercase"))
    elif key in ("department", "designation", "workLocation"):
        got = _out(title_case(text), 0.9, "title case")
    elif key == "managerEmployeeNumber":
        got = _out(canonical_id(text, config.id_prefix), 0.9, "canonical id")
    else:
        got = _out(text, 0.8)
    return got
