"""PostgreSQL's text functions where Spark's differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bpchar_eq(a: Column, b: Column) -> Column:
    """Equality of char(n): trailing blanks do not count."""
    return F.rtrim(a) == F.rtrim(b)


def to_char_n(x: Column, n: int) -> Column:
    """Assignment to char(n): padded; fails where more than blanks would be cut."""
    return F.when(F.char_length(F.rtrim(x)) > n, F.raise_error(F.lit(f"value too long for type character({n})"))).otherwise(F.rpad(F.substring(x, 1, n), n, " "))


def to_varchar_n(x: Column, n: int) -> Column:
    """Assignment to varchar(n): blanks beyond n are cut; fails where more would be."""
    return F.when(F.char_length(F.rtrim(x)) > n, F.raise_error(F.lit(f"value too long for type character varying({n})"))).otherwise(F.substring(x, 1, n))


def replacement(text: str) -> str:
    """A replacement with \\1 to \\9, \\& and \\\\ as Java writes it."""
    out = re.sub(r"\\([1-9&\\])|([$])", lambda m: "\\$" if m[2] else "$0" if m[1] == "&" else "\\\\" if m[1] == "\\" else f"${m[1]}", text)
    return out


def moved(text: str, by: int) -> str:
    """A pattern or replacement whose references to groups count so many groups more."""
    return re.sub(r"\\(\d|[^\d])", lambda m: f"\\{int(m[1]) + by}" if m[1].isdigit() and m[1] != "0" else m[0], text)


def first_match(pattern: str, new: str) -> tuple[str, str]:
    """Java's pattern and replacement that change the first match only: what stands before it becomes group 1 and the match group 2, so the pattern's own groups move by two."""
    if pattern.startswith("^") and "|" not in pattern and "(?" not in pattern.replace("(?:", ""):
        return pattern, replacement(new)
    flags = re.match(r"(?:\(\?[a-z]+\))*", pattern)[0]
    shifted = re.sub(r"\\([1-9&\\])|([$])", lambda m: "\\$" if m[2] else "$2" if m[1] == "&" else "\\\\" if m[1] == "\\" else f"${int(m[1]) + 2}", new)
    return f"(?s){flags}^(.*?)({moved(pattern[len(flags):], 2)})", "$1" + shifted


def regexp_replace(x: Column, pattern: str, new: str, flags: str = "") -> Column:
    """regexp_replace: the first match, or all with the flag g; i ignores case."""
    pattern = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(x, pattern, replacement(new))
    return F.regexp_replace(x, *first_match(pattern, new))


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))
