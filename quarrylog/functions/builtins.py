"""Scalar builtins as column expressions.

Each takes columns and gives (result, condition): rows for which the condition
does not hold have no result and disappear. Tests give (None, condition).
Positions count characters from 0; ``length`` counts bytes, as the language says.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Result = tuple[Column | None, Column | None]
STRING, INT = "string", "bigint"


def _between(x: Column, low: Column | int, high: Column | int) -> Column:
    return (x >= low) & (x <= high)


def _characters(s: Column) -> Column:
    return F.length(s).cast("long")


def _sub(s: Column, start: Column, n: Column) -> Column:
    return F.substring(s, (start + 1).cast("int"), n.cast("int"))


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a LIKE-style pattern; None if it is malformed.

    ``%`` and ``*`` stand for any characters but a slash, ``_`` and ``?`` for one;
    ``[...]`` is a class and ``\\`` takes the next character as it is.
    """
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c in "%*":
            out += "[^/]*"
        elif c in "_?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", pattern[i:])
            if not m:
                return None
            out += f"[{m[1]}{m[2].replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]"
            i += len(m[0]) - 1
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def checked_regex(pattern: str) -> str:
    """The pattern, if it needs no backtracking features."""
    if re.search(r"\\[1-9]|\(\?<?[=!]|\(\?>|[*+?}]\+", pattern):
        raise ValueError(f"back-references, look-around and possessive repetition are not supported: {pattern!r}")
    return pattern


def java_replacement(text: str) -> str:
    """``$1``, ``${1}`` and ``${name}`` references as Java writes them; ``$$`` is a dollar sign."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else "${%s}" % name

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", one, text.replace("\\", "\\\\"))


def _literal(c: object) -> str:
    if not isinstance(c, str):
        raise ValueError("the pattern must be a string constant")
    return c


def _shift(kind: str) -> Callable[..., Result]:
    def use(a: Column, n: Column) -> Result:
        if kind == "left":
            out = F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, F.least(n, F.lit(63)).cast("int")))
        else:
            out = F.call_function("shiftright", a, F.least(n, F.lit(63)).cast("int"))
        return out, n >= 0

    return use


def _replace_all(s: Column, old: Column, new: Column) -> Result:
    """Literal replacement; an empty ``old`` puts ``new`` before every character and at the end."""
    between = F.concat(new, F.call_function("array_join", F.split(s, ""), new), new)
    return F.when(old != "", F.replace(s, old, new)).when(s == "", new).otherwise(between), None


def _to_int(s: Column) -> Result:
    value = F.when(s.rlike("^[+-]?[0-9]+$"), s).try_cast("bigint")
    return value, value.isNotNull()


def _index_of(s: Column, t: Column) -> Result:
    return (F.call_function("locate", t, s) - 1).cast("long"), None


def _regex_find(s: Column, pattern: str, index: Column, offset: Column) -> Result:
    found = F.regexp_extract_all(_sub(s, offset, _characters(s) - offset), F.lit(checked_regex(_literal(pattern))), F.lit(0))
    return F.get(found, index.cast("int")), _between(offset, 0, _characters(s)) & (index >= 0) & (index < F.size(found))


def _matches(s: Column, pattern: str) -> Result:
    regex = glob_regex(_literal(pattern))
    return None, F.lit(False) if regex is None else s.rlike(regex)


#: name: (types of the inputs, type of the result or None, does input 1 have to be a constant, function)
BUILTINS: dict[str, tuple[tuple[str, ...], str | None, bool, Callable[..., Result]]] = {
    "length": ((STRING,), INT, False, lambda s: (F.octet_length(s).cast("long"), None)),
    "toUpperCase": ((STRING,), STRING, False, lambda s: (F.upper(s), None)),
    "toLowerCase": ((STRING,), STRING, False, lambda s: (F.lower(s), None)),
    "trim": ((STRING,), STRING, False, lambda s: (F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), None)),
    "indexOf": ((STRING, STRING), INT, False, _index_of),
    "substring": ((STRING, INT, INT), STRING, False, lambda s, a, b: (_sub(s, a, b - a), _between(a, 0, b) & (b <= _characters(s)))),
    "charAt": ((STRING, INT), STRING, False, lambda s, i: (_sub(s, i, F.lit(1)), _between(i, 0, _characters(s) - 1))),
    "replaceAll": ((STRING, STRING, STRING), STRING, False, _replace_all),
    "matches": ((STRING, STRING), None, True, _matches),
    "regexpMatch": ((STRING, STRING), None, True, lambda s, p: (None, s.rlike(checked_regex(_literal(p))))),
    "toInt": ((STRING,), INT, False, _to_int),
    "toString": ((STRING,), STRING, False, lambda s: (s, None)),
    "splitAt": ((STRING, INT), STRING, False, lambda s, i: (_sub(s, i, _characters(s) - i), _between(i, 0, _characters(s)))),
    "regexpFind": ((STRING, STRING, INT, INT), STRING, True, _regex_find),
    "regexpReplaceAll": ((STRING, STRING, STRING), STRING, True, lambda s, p, r: (F.regexp_replace(s, checked_regex(_literal(p)), java_replacement(_literal(r))), None)),
    "prefix": ((STRING, INT), STRING, False, lambda s, n: (_sub(s, F.lit(0), n), _between(n, 0, _characters(s)))),
    "suffix": ((STRING, INT), STRING, False, lambda s, n: (_sub(s, _characters(s) - n, n), _between(n, 0, _characters(s)))),
    "abs": ((INT,), INT, False, lambda n: (F.abs(F.greatest(n, F.lit(1 - 2**63))), n > F.lit(-(2**63)))),
    "bitAnd": ((INT, INT), INT, False, lambda a, b: (a.bitwiseAND(b), None)),
    "bitOr": ((INT, INT), INT, False, lambda a, b: (a.bitwiseOR(b), None)),
    "bitXor": ((INT, INT), INT, False, lambda a, b: (a.bitwiseXOR(b), None)),
    "bitShiftLeft": ((INT, INT), INT, False, _shift("left")),
    "bitShiftRight": ((INT, INT), INT, False, _shift("right")),
}
#: Inputs that must be constants, where there are more than the second.
CONSTANT_INPUTS = {"matches": {1}, "regexpMatch": {1}, "regexpFind": {1}, "regexpReplaceAll": {1, 2}}
