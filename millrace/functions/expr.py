"""Scalar expressions. All stay inside Catalyst: nothing here runs Python on rows.

Where Spark's own meaning differs, the function says how: predicates are two-valued, arithmetic is 64-bit, ``length``
counts bytes, and regular expressions follow RE2 (``.`` excludes only a line feed, ``$`` is the end of the text).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = Column | str


def _c(x: Expr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def const(value: int | str) -> Column:
    """A literal: integers are 64-bit."""
    return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)


def pred(condition: Column) -> Column:
    """A predicate as a value: NULL counts as false. Under filter and CASE that makes no difference."""
    return F.coalesce(condition, F.lit(False))


def contains(x: Expr, needle: str) -> Column:
    """Literal, case-sensitive substring test (``%`` and ``_`` in the needle mean themselves)."""
    return _c(x).contains(F.lit(needle))


def not_contains(x: Expr, needle: str) -> Column:
    """False for NULL, like :func:`contains`."""
    return ~_c(x).contains(F.lit(needle))


def between(x: Expr, low, high) -> Column:
    return _c(x).between(low, high)


def is_in(x: Expr, values: Sequence) -> Column:
    return _c(x).isin(list(values))


def plus(a: Expr, b: Expr | int) -> Column:
    return as_int(a) + as_int(b)


def minus(a: Expr, b: Expr | int) -> Column:
    return as_int(a) - as_int(b)


def times(a: Expr, b: Expr | int) -> Column:
    return as_int(a) * as_int(b)


_INTEGERS = ("tinyint", "smallint", "int", "bigint", "boolean", "void")


def as_int(x: Expr | int) -> Column:
    """Widen an integer or boolean operand to 64 bits; overflow beyond that raises under ANSI, and so does another type.

    The test of the type is folded away when the plan is built.
    """
    if isinstance(x, int):
        return const(x)
    c = _c(x)
    return F.when(F.typeof(c).isin(*_INTEGERS), c.cast("long")).otherwise(F.raise_error(F.concat(F.lit("an integer is needed, not "), F.typeof(c))))


def not_floating(x: Expr) -> Column:
    """The operand; a floating one raises."""
    c = _c(x)
    return F.when(~F.typeof(c).isin("double", "float"), c).otherwise(F.raise_error(F.concat(F.typeof(c), F.lit(" values aren't told apart"))))


_SIGNS = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def compare_double(a: Expr, sign: str, b: Expr | float) -> Column:
    """A comparison of doubles by IEEE 754: NaN differs from every number and itself, and is neither less nor greater."""
    x, y = (_c(v).cast("double") if isinstance(v, (str, Column)) else F.lit(float(v)) for v in (a, b))
    nan = F.isnan(x) | F.isnan(y)
    found = _SIGNS[sign](x, y)
    return found | nan if sign == "<>" else found & ~nan


def char_code(x: Expr) -> Column:
    """A one-byte character as the number it compares and groups by."""
    return F.ascii(_c(x)).cast("long")


def date_number(x: Expr) -> Column:
    """A date as its day number since 1970-01-01."""
    return F.unix_date(_c(x)).cast("long")


def wall_seconds(x: Expr) -> Column:
    """A timestamp as whole seconds since 1970-01-01 00:00:00 as stored, whatever the session's time zone."""
    t = _c(x)
    return (F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")


def length_bytes(x: Expr) -> Column:
    return F.octet_length(_c(x)).cast("long")


def extract_minute(ts: Expr) -> Column:
    """The minute of the hour, 0 to 59, before 1970 too."""
    return F.minute(_c(ts)).cast("long")


def trunc_minute(ts: Expr) -> Column:
    return F.date_trunc("minute", _c(ts)).cast("timestamp_ntz")


def case(condition: Column, then: Column, otherwise: Column) -> Column:
    """One WHEN and an ELSE; a NULL condition takes the ELSE."""
    return F.when(condition, then).otherwise(otherwise)


def re2_pattern(pattern: str) -> str:
    """The same pattern for Java's engine.

    Lines end at ``\\n`` alone, ``$`` is the end of the text wherever it stands (with the flag ``m`` of a line), a bracket
    or ``&&`` inside a class means itself, ``[:alpha:]``, ``(?P<name>…)`` and names of scripts take Java's form. What RE2
    doesn't have is an error: looking around, back references, possessive and atomic groups.
    """
    bare = re.sub(r"\\Q.*?(?:\\E|\Z)|\[\^?\]?(?:\[:\^?[a-z]+:\]|[^\]\\]|\\.)*\]", "[]", pattern, flags=re.DOTALL)
    bare = re.sub(r"\\[pP]\{[^}]*\}", "p", bare)
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!>]|<[=!])|[*+?}]\+|\\[1-9])", bare):
        raise ValueError(f"not an RE2 pattern: {pattern!r}")
    by_line = re.search(r"\(\?[a-zA-Z]*m", pattern)
    out, i, inside = ["(?d)"], 0, 0  # inside: place in the output where a class begins
    while i < len(pattern):
        rest = pattern[i:]
        quoted, script, posix, named = (re.match(x, rest, re.DOTALL) for x in (r"\\Q.*?(?:\\E|\Z)", r"\\([pP])\{(\^?)([A-Za-z]{3,}[A-Za-z_]*)\}", r"\[:(\^?)([a-z]+):\]", r"\(\?P<"))
        if quoted:
            taken, put = quoted[0], quoted[0] if quoted[0].endswith("\\E") else quoted[0] + "\\E"
        elif script:
            taken, put = script[0], f"\\{'P' if (script[1] == 'P') != bool(script[2]) else 'p'}{{Is{script[3]}}}"
        elif rest[0] == "\\":
            taken = put = rest[:2]
        elif inside and posix:
            name = {"xdigit": "XDigit", "word": "w"}.get(posix[2], posix[2].capitalize())
            taken, put = posix[0], ("\\W" if posix[1] else "\\w") if name == "w" else f"\\{'P' if posix[1] else 'p'}{{{'ASCII' if name == 'Ascii' else name}}}"
        elif inside:
            taken, first = rest[0], "".join(out[inside:]) in ("[", "[^")
            put = "\\" + taken if taken in "[&" or taken == "]" and first else taken
            inside = 0 if taken == "]" and not first else inside
        elif rest[0] == "[":
            taken, inside = re.match(r"\[\^?", rest)[0], len(out)
            put = taken
        elif named:
            taken, put = named[0], "(?<"
        else:
            taken = rest[0]
            put = "\\z" if taken == "$" and not by_line else taken
        out.append(put)
        i += len(taken)
    return "".join(out)


def re2_rewrite(rewrite: str) -> str:
    """``\\1`` references as Java's ``$1``; a literal ``$`` is escaped. A bad escape is an error."""
    out, i = [], 0
    while i < len(rewrite):
        ch = rewrite[i]
        if ch == "\\":
            nxt = rewrite[i + 1 : i + 2]
            if nxt.isdigit():
                out.append(f"${nxt}")
            elif nxt == "\\":
                out.append("\\\\")
            else:
                raise ValueError(f"bad escape in rewrite {rewrite!r}")
            i += 2
            continue
        out.append("\\$" if ch == "$" else ch)
        i += 1
    return "".join(out)


def re2_replace(x: Expr, pattern: str, rewrite: str) -> Column:
    """Replace every match; both arguments are checked by Java's engine when the plan is built."""
    java, jvm = re2_pattern(pattern), SparkContext._active_spark_context._jvm
    try:
        groups = jvm.java.util.regex.Pattern.compile(java).matcher("").groupCount()
    except IllegalArgumentException as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    put = re2_rewrite(rewrite)
    for ref in re.findall(r"(?<!\\)(?:\\\\)*\\(\d)", rewrite):
        if int(ref) > groups:
            raise ValueError(f"rewrite refers to group {ref}, the pattern has {groups}")
    return F.regexp_replace(_c(x), F.lit(java), F.lit(put))


def prefix_capture(x: Expr, prefixes: Sequence[str], delimiter: str, require_non_empty: bool = True, single_line_tail: bool = True) -> Column:
    """The text between the first prefix that fits and the delimiter after it; the input unchanged where none fits.

    A prefix fits if the text starts with it, the delimiter follows later, the text between is not empty (optional) and
    no line feed follows the delimiter (optional).
    """
    if not prefixes or not delimiter or delimiter == "\0":
        raise ValueError("prefix_capture needs prefixes and a delimiter")
    c, out = _c(x), None
    for p in prefixes:
        rest = F.substring(c, len(p) + 1, 2**31 - 1)
        at = F.instr(rest, delimiter)
        fits = c.startswith(p) & (at > (1 if require_non_empty else 0))
        if single_line_tail:
            fits = fits & (F.instr(rest.substr(at + len(delimiter), F.lit(2**31 - 1)), "\n") == 0)
        taken = rest.substr(F.lit(1), at - 1)
        out = F.when(fits, taken) if out is None else out.when(fits, taken)
    return out.otherwise(c)
