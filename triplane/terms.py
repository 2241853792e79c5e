"""Terms as canonical text in one string column, so identity is string equality and joins stay plain.

``<iri>``, ``_:label``, ``"text"``, ``"text"@lang`` or ``"text"@lang--dir``, ``"text"^^<datatype>``, bare numbers
(``42``, ``3.7``) and booleans, and triple terms as a JSON array of three term texts. Columns of relational
tables need no such text: they stay native until they meet a term.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces and datatypes of the RDF vocabulary.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, FIRST, REST, NIL, REIFIES = (f"{RDF}{x}" for x in ("type", "first", "rest", "nil", "reifies"))

LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+?)(?:--([a-z]+))?|\^\^<([^>]*)>)?$'
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def iri(value: str) -> str:
    return f"<{value}>"


def blank(label: str) -> str:
    return f"_:{label.removeprefix('_:')}"


def literal(value: object, lang: str = "", direction: str = "", datatype: str = "") -> str:
    """A constant literal; numbers and booleans are bare unless a datatype is given."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float) and not datatype:
        return number_text(value)
    tag = f"@{lang.lower()}" + f"--{direction.lower()}" * bool(direction) if lang else f"^^<{datatype}>" * bool(datatype)
    return f'"{value}"{tag}'


def number_text(x: float) -> str:
    """Shortest text that reads back as the number: plain from 1e-6 up to 1e21, whole numbers without a point."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(float(x)).partition("e")
    if not power or -7 < int(power) < 21:
        return _plain(repr(float(x)))
    return f"{digits.removesuffix('.0')}e{'-' if power.startswith('-') else '+'}{power.lstrip('+-').lstrip('0')}"


def _plain(text: str) -> str:
    """A repr without its exponent."""
    digits, _, power = text.partition("e")
    if not power:
        return digits
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, part = digits.partition(".")
    shift = int(power)
    joined = whole + part
    point = len(whole) + shift
    return sign + ("0." + "0" * -point + joined if point <= 0 else joined.ljust(point, "0") + ("." + joined[point:] if joined[point:] else ""))


@F.arrow_udf(T.StringType())
def _number_text(column: pa.Array) -> pa.Array:
    if column.null_count == len(column):
        return pa.nulls(len(column), pa.string())
    return pa.array([None if x is None else number_text(x) for x in column.to_pylist()], pa.string())


def number_term(x: Column) -> Column:
    """Text of a double column. Whole numbers below 2**53, and decimals of at most 6 places and 15 digits (no
    shorter text than theirs can be the same double), are written in the JVM; Python sees only what is left."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(2.0**53))
    short = (F.abs(x) < F.lit(1e9)) & (F.abs(x) >= F.lit(1e-6)) & (F.round(x, 6) == x)
    plain = F.regexp_replace(F.when(short, x).cast("decimal(16,6)").cast("string"), "0+$", "")
    rest = F.when(~(whole | short), x)
    return F.when(whole, F.format_string("%d", x.cast("long"))).when(short, plain).otherwise(_number_text(rest))


def of_value(c: Column, kind: T.DataType) -> Column:
    """Text of a native column as a term: a literal of its type."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    if isinstance(kind, T.FractionalType):
        return number_term(c.cast("double"))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f'"^^<{XSD}dateTime>'))
    if isinstance(kind, T.DateType):
        return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd"), F.lit(f'"^^<{XSD}date>'))
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_triple(t: Column) -> Column:
    return t.startswith("[")


def is_literal(t: Column) -> Column:
    return ~(is_iri(t) | is_blank(t) | is_triple(t))


def is_numeric(t: Column) -> Column:
    """A bare number, or a literal of a numeric datatype."""
    return t.rlike(NUMBER) | datatype(t).isin(f"{XSD}integer", f"{XSD}decimal", f"{XSD}double")


def string(t: Column) -> Column:
    """The text of a term: an IRI without brackets, the lexical form of a literal."""
    quoted = F.when(t.startswith('"'), F.regexp_extract(t, LITERAL, 1))
    return F.when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.coalesce(quoted, t))


def number(t: Column) -> Column:
    """The number a term holds, else null."""
    return string(t).try_cast("double")


def lang(t: Column) -> Column:
    return F.lower(F.regexp_extract(t, LITERAL, 2))


def lang_dir(t: Column) -> Column:
    return F.regexp_extract(t, LITERAL, 3)


def datatype(t: Column) -> Column:
    """IRI (without brackets) of a literal's datatype; null for what is no literal."""
    stated = F.regexp_extract(t, LITERAL, 4)
    bare = F.when(t.isin("true", "false"), f"{XSD}boolean").when(t.rlike(r"^[+-]?[0-9]+$"), f"{XSD}integer").when(t.rlike(NUMBER), f"{XSD}decimal")
    tagged = F.when(lang_dir(t) != "", f"{RDF}dirLangString").when(lang(t) != "", f"{RDF}langString")
    return F.when(is_literal(t), F.coalesce(bare, tagged, F.when(stated != "", stated), F.lit(f"{XSD}string")))


def triple(s: Column, p: Column, o: Column) -> Column:
    return F.to_json(F.array(s, p, o))


def part(t: Column, position: int) -> Column:
    """Subject (0), predicate (1) or object (2) of a triple term, null for other terms."""
    return F.when(is_triple(t), F.get_json_object(t, f"$[{position}]"))


def blank_node(label: Column | None = None) -> Column:
    """The blank node of a label, the same wherever the label is; without one a new node for each row (assign it in a
    ``Set`` that is volatile, so that it is made once)."""
    return F.concat(F.lit("_:"), F.regexp_replace(label, "^_:", "") if label is not None else F.replace(F.uuid(), F.lit("-"), F.lit("")))


def str_lang(text: Column, tag: Column) -> Column:
    """A literal of a language; null without a tag."""
    return F.when(tag != "", F.concat(F.lit('"'), text, F.lit('"@'), F.lower(tag)))


def str_lang_dir(text: Column, tag: Column, direction: Column) -> Column:
    """A literal of a language and a direction, ltr or rtl; null for others."""
    direction = F.lower(direction)
    return F.when(direction.isin("ltr", "rtl"), F.concat(str_lang(text, tag), F.lit("--"), direction))


def str_datatype(text: Column, datatype_iri: Column) -> Column:
    """A literal of a datatype, given as an IRI with or without brackets."""
    return F.concat(F.lit('"'), text, F.lit('"^^<'), F.regexp_replace(datatype_iri, "^<|>$", ""), F.lit(">"))


def has_lang(t: Column) -> Column:
    return lang(t) != ""


def has_lang_dir(t: Column) -> Column:
    return lang_dir(t) != ""


def same_term(a: Column, b: Column) -> Column:
    """Are two terms the very same, not only equal in value?"""
    return a == b
