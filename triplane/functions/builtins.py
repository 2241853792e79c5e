"""The scalar functions of rule expressions as Columns over native values. All are total: what would be an
error is null, and a null drops the row in a filter or an assignment. For functions of terms see terms.py."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms

# A dateTime or date in its lexical form (what follows doesn't matter for its fields), and a time's zone.
DATE_TIME = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:[.][0-9]+)?))?"
ZONE = r"T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})\z"


def number(x: Column) -> Column:
    """As a double, null for what is no number."""
    return x.try_cast("double")


def absolute(x: Column) -> Column:
    return F.abs(number(x))


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity: -3.5 gives -3."""
    return _whole(number(x) + 0.5, F.floor)


def _whole(x: Column, f: Callable[[Column], Column]) -> Column:
    """Doubles from 2**53 on are whole (and don't fit a long); NaN stays."""
    x = number(x)
    return F.when(F.abs(x) < F.lit(2.0**53), f(x).cast("double")).otherwise(x)


def add(a: Column, b: Column) -> Column:
    """Numbers add up; if one is no number, texts are put together."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), terms.number_term(x + y)).otherwise(F.concat(a.cast("string"), b.cast("string")))


def subtract(a: Column, b: Column) -> Column:
    return number(a) - number(b)


def multiply(a: Column, b: Column) -> Column:
    return number(a) * number(b)


def divide(a: Column, b: Column) -> Column:
    """Always a double; division by zero gives an infinity or NaN, never an error."""
    a, b = number(a), number(b)
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def concat(*parts: Column) -> Column:
    return F.concat(F.lit(""), *parts)


def substr(text: Column, start: Column, length: Column | None = None) -> Column:
    """From a 1-based start; a start before the text is moved to its beginning and the length kept. Null if start or
    length is no number; beyond the text there is nothing."""
    limit = lambda x, low: F.least(F.greatest(F.floor(F.nanvl(number(x), F.lit(0.0))), F.lit(low)), F.lit(2**31 - 1)).cast("int")
    inside = lambda x, low: F.when(number(x).isNotNull(), limit(F.when(F.abs(number(x)) < 2.0**53, number(x)).when(number(x) > 0, 2.0**53).otherwise(0.0), low))
    return F.substring(text, inside(start, 1), F.length(text) if length is None else inside(length, 0))


def strlen(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def replace(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    """Null for a pattern that is no regular expression. ``$1`` in ``by`` is a group, ``$&`` all, ``$$`` a dollar; anything
    else stands for itself, a group that the pattern lacks too."""
    groups = _groups(_flags(flags) + pattern)
    if groups is None:
        return F.lit(None).cast("string")

    def part(m: re.Match) -> str:
        mark = m[0]
        if mark == "$&":
            return "$0"
        if mark == "$$":
            return "\\$"
        digits = next((mark[1:k] for k in (3, 2) if mark[1:k].isdigit() and len(mark) >= k and 1 <= int(mark[1:k]) <= groups), None)
        if digits is None:
            return "".join("\\" + c if c in "$\\" else c for c in mark)
        rest = mark[1 + len(digits) :]
        return f"${int(digits)}" + (f"\\{rest}" if rest else "")

    return F.regexp_replace(text, _flags(flags) + pattern, re.sub(r"\$&|\$\$|\$[0-9]{1,2}|\$|\\", part, by))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    """Null for a pattern that is no regular expression."""
    if _groups(_flags(flags) + pattern) is None:
        return F.lit(None).cast("boolean")
    return text.rlike(_flags(flags) + pattern)


def _groups(pattern: str) -> int | None:
    """Groups of a regular expression, None if it isn't one; the constant is looked at while the plan is made."""
    try:
        compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return None
    return compiled.matcher("").groupCount()


def _flags(flags: str) -> str:
    known = "".join(sorted(set(flags) & set("ims")))
    return f"(?{known})" if known else ""


def before(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")


def after(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.substring(text, at + F.length(part), F.length(text))).otherwise("")


def encode_for_uri(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.url_encode(text)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def lang_matches(tag: Column, wanted: Column) -> Column:
    tag, wanted = F.lower(tag), F.lower(wanted)
    return F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-"))))


def _field(text: Column, group: int) -> Column:
    found = F.regexp_extract(text, DATE_TIME, group).try_cast("double")
    return found if group < 4 else F.coalesce(found, F.when(text.rlike(DATE_TIME), F.lit(0.0)))


def year(text: Column) -> Column:
    return _field(text, 1)


def month(text: Column) -> Column:
    return _field(text, 2)


def day(text: Column) -> Column:
    return _field(text, 3)


def hours(text: Column) -> Column:
    """The hour as written, in the time's own zone."""
    return _field(text, 4)


def minutes(text: Column) -> Column:
    return _field(text, 5)


def seconds(text: Column) -> Column:
    return _field(text, 6)


def tz(text: Column) -> Column:
    """Z, an offset such as +02:30 or +0230, or nothing; a date alone has no zone."""
    return F.regexp_extract(text, ZONE, 1)


def timezone(text: Column) -> Column:
    """The offset as a duration: PT2H30M, -PT5H, PT0S for Z; null without one."""
    zone = F.replace(tz(text), F.lit(":"), F.lit(""))
    h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 4, 2).try_cast("int")
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    sign = F.when(zone.startswith("-"), "-").otherwise("")
    return F.when(zone == "", None).when(zone == "Z", "PT0S").otherwise(F.concat(sign, F.lit("PT"), F.when(parts == "", "0S").otherwise(parts)))


def now(at: datetime | None = None) -> Column:
    """One time for the whole evaluation, in milliseconds, UTC."""
    at = (at or datetime.now(UTC)).astimezone(UTC)
    return F.lit(at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z")


def uuid_text(number: Column | None = None) -> Column:
    """A random identifier, or with a number (a row number, say) a reproducible one."""
    if number is None:
        return F.uuid()
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def uuid_iri(number: Column | None = None) -> Column:
    return F.concat(F.lit("urn:uuid:"), uuid_text(number))


def if_(test: Column, kind: str, then: Column, other: Column) -> Column:
    """``then`` if the truth value of a column of Spark type ``kind`` is true, else ``other``."""
    return F.when(truth(test, kind), then).otherwise(other)


def resolve(text: Column, base: str) -> Column:
    """A relative reference against the base; an absolute IRI stays as it is."""
    folder = base[: base.rindex("/") + 1] if "/" in base.split("://", 1)[-1] else base + "/"
    root = "/".join(base.split("/", 3)[:3])
    absolute_iri = text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute_iri, text).when(text.startswith("/"), F.concat(F.lit(root), text)).when(text.startswith("#"), F.concat(F.lit(base.split("#")[0]), text)).otherwise(F.concat(F.lit(folder), text))


def truth(c: Column, kind: str) -> Column:
    """Effective boolean value of a column of Spark type ``kind``: numbers but 0 and NaN, texts but '' and 'false'."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce((c != "") & (c != "false"), F.lit(False))
    x = number(c)
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


def less(a: Column, b: Column) -> Column:
    """Order of two texts: as numbers if both are numbers, else as texts."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x < y).otherwise(a < b)


__all__ = [k for k in dir() if not k.startswith("_") and k not in ("annotations", "re", "Callable", "UTC", "datetime", "IllegalArgumentException", "SparkContext", "Column", "F", "terms")]
