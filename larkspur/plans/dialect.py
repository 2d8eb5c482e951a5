"""PostgreSQL's SQL on Spark's parser.

Most of PostgreSQL's query language parses in Spark as it stands. These forms are rewritten, on tokens, never inside
literals or quoted names:

* ``ORDER BY x`` without a null order: nulls come last ascending and first descending.
* ``x = ANY (array)`` and ``x <op> ANY | ALL (array)``: ``exists`` and ``forall`` over the array, with three-valued logic.
* ``(a, b) > (c, d)``: column by column.
* ``SELECT DISTINCT ON (keys) ... ORDER BY``: row_number over the keys.
* ``FETCH FIRST n ROWS ONLY``: LIMIT; ``WITH TIES`` of a top-level query: rank over its order.
* ``x !~ p``, ``x ~ p``, ``x ~* p``: rlike.
* ``generate_series(a, b[, step])`` in FROM: explode of a sequence.
* functions of other names and shapes: ``RENAMED`` and ``SHAPED``.
* ``extract(field FROM x)``, ``date_part`` and ``date_trunc`` with PostgreSQL's fields: Sunday is 0, decades, centuries, epochs, julian days.
* ``regexp_replace``: the first match only, all with the flag g.
* casts to ``char(n)``: cut to n, and without the trailing blanks, which do not count where such values are compared.
* ``/`` of integers and casts of fractions to integers, whose meaning depends on types: see ``typed.py``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.text import first_match, replacement
from larkspur.plans import typed

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[A-Za-z_][A-Za-z_0-9$]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|::|<=>|<>|!=|<=|>=|!~\*?|~\*?|\|\||->>?|.", re.S)
#: PostgreSQL's name and Spark's, of functions with the same arguments.
RENAMED = {
    "strpos": "instr",
    "starts_with": "startswith",
    "array_to_string": "array_join",
    "array_cat": "concat",
    "unnest": "explode",
    "jsonb_array_length": "json_array_length",
    "random": "rand",
    "clock_timestamp": "current_timestamp",
    "every": "every",
    "btrim": "trim",
    "ascii": "ascii",
    "array_remove": "array_remove",
    "string_agg": "listagg",
    "bool_and": "bool_and",
}
#: Functions that need another shape, by the number of their arguments: Spark's text with {0}, {1} for these.
SHAPED = {
    ("string_to_array", 2): "split({0}, concat('\\\\Q', {1}, '\\\\E'))",
    ("to_hex", 1): "lower(hex({0}))",
    ("sha256", 1): "sha2({0}, 256)",
    ("json_agg", 1): "to_json(collect_list({0}))",
    ("jsonb_agg", 1): "to_json(collect_list({0}))",
    ("array_length", 2): "CASE WHEN {1} = 1 AND size({0}) > 0 THEN size({0}) END",
    ("cardinality", 1): "size({0})",
    ("array_append", 2): "concat({0}, array({1}))",
    ("array_prepend", 2): "concat(array({0}), {1})",
    ("array_ndims", 1): "CASE WHEN size({0}) > 0 THEN 1 END",
    ("split_part", 3): "split_part({0}, {1}, {2})",
    ("initcap", 1): "initcap({0})",
    ("regexp_matches", 2): "CASE WHEN {0} RLIKE {1} THEN array(regexp_extract({0}, {1})) END",
    ("regexp_split_to_array", 2): "split({0}, {1})",
    ("trunc", 1): "CASE WHEN {0} >= 0 THEN floor({0}) ELSE ceil({0}) END",
    ("log", 1): "log10({0})",
    ("div", 2): "({0} div {1})",
    ("make_interval", 3): "make_interval({0}, {1}, {2})",
    ("jsonb_extract_path_text", 2): "get_json_object({0}, concat('$.', {1}))",
    ("json_extract_path_text", 2): "get_json_object({0}, concat('$.', {1}))",
    ("cbrt", 1): "cbrt({0})",
    ("width_bucket", 4): "width_bucket({0}, {1}, {2}, {3})",
}
MICROS = "unix_micros(CAST({0} AS TIMESTAMP))"
#: Fields of a date or time that Spark lacks or counts otherwise.
FIELDS = {
    "dow": "(dayofweek({0}) - 1)",
    "isodow": "(weekday({0}) + 1)",
    "isoyear": "extract(YEAROFWEEK FROM {0})",
    "decade": "CAST(floor(year({0}) / 10e0) AS BIGINT)",
    "century": "CAST(ceil(year({0}) / 100e0) AS BIGINT)",
    "millennium": "CAST(ceil(year({0}) / 1000e0) AS BIGINT)",
    "epoch": f"({MICROS} / 1e6)",
    "milliseconds": f"(pmod({MICROS}, 60000000L) / 1e3)",
    "microseconds": f"pmod({MICROS}, 60000000L)",
    "julian": f"(datediff(CAST({{0}} AS DATE), date '1970-01-01') + 2440588 + pmod({MICROS}, 86400000000L) / 864e8)",
}
#: date_trunc to fields that Spark lacks.
TRUNCATED = {
    "decade": "CAST(make_date(CAST(floor(year({0}) / 10e0) * 10 AS INT), 1, 1) AS TIMESTAMP_NTZ)",
    "century": "CAST(make_date(CAST(floor((year({0}) - 1) / 100e0) * 100 + 1 AS INT), 1, 1) AS TIMESTAMP_NTZ)",
    "millennium": "CAST(make_date(CAST(floor((year({0}) - 1) / 1000e0) * 1000 + 1 AS INT), 1, 1) AS TIMESTAMP_NTZ)",
}
COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}
BEFORE_OPERAND = {"select", "distinct", "where", "and", "or", "not", "on", "having", "when", "then", "else", "case", "by"}
ENDS_ORDER = {"limit", "offset", "fetch", "rows", "range", "groups", "union", "intersect", "except", "window", "for"}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def blank(token: str) -> bool:
    return token.isspace() or token.startswith(("--", "/*"))


def close_of(t: list[str], at: int) -> int:
    """Where the bracket opened at t[at] closes."""
    depth = 0
    for i in range(at, len(t)):
        depth += (t[i] in "([") - (t[i] in ")]") if len(t[i]) == 1 else 0
        if depth == 0:
            return i
    raise ValueError(f"bracket not closed: {''.join(t[at:])[:80]}")


def following(t: list[str], at: int) -> int:
    """The next token that is not blank, from at on."""
    while at < len(t) and blank(t[at]):
        at += 1
    return at


def split_args(t: list[str]) -> list[str]:
    out, depth = [""], 0
    for x in t:
        depth += (x in "([") - (x in ")]") if len(x) == 1 else 0
        if x == "," and depth == 0:
            out.append("")
        else:
            out[-1] += x
    return [x.strip() for x in out]


def null_orders(t: list[str]) -> list[str]:
    """Each item of an ORDER BY gets PostgreSQL's null order, where it names none."""
    out, i = [], 0
    while i < len(t):
        out.append(t[i])
        if t[i].lower() == "order" and (j := following(t, i + 1)) < len(t) and t[j].lower() == "by":
            out += t[i + 1 : j + 1]
            i, depth, item = j + 1, 0, []

            def done(item: list[str]) -> list[str]:
                words = [x.lower() for x in item if not blank(x)]
                if not words or "nulls" in words:
                    return item
                tail = []
                while item and blank(item[-1]):
                    tail.insert(0, item.pop())
                return [*item, " NULLS FIRST" if words[-1] == "desc" else " NULLS LAST", *tail]

            while i < len(t):
                x = t[i]
                if depth == 0 and (x in ");" or x.lower() in ENDS_ORDER):
                    break
                depth += (x in "([") - (x in ")]") if len(x) == 1 else 0
                if x == "," and depth == 0:
                    out += [*done(null_orders(item)), ","]
                    item = []
                else:
                    item.append(x)
                i += 1
            out += done(null_orders(item))
            continue
        i += 1
    return out


def quantified(t: list[str]) -> list[str]:
    """x <op> ANY (array) and ALL; a subquery in the brackets stays."""
    out: list[str] = []
    i = 0
    while i < len(t):
        x = t[i]
        j = following(t, i + 1)
        if x in COMPARE and j < len(t) and t[j].lower() in ("any", "some", "all"):
            k = following(t, j + 1)
            if k < len(t) and t[k] == "(" and t[following(t, k + 1)].lower() not in ("select", "with", "values"):
                end = close_of(t, k)
                left: list[str] = []
                while out and blank(out[-1]):
                    out.pop()
                depth = 0
                while out:  # the operand: a bracket or a name with what is tied to it
                    y = out[-1]
                    if depth == 0 and (y in ("(", ",", "[") or y.lower() in BEFORE_OPERAND):
                        break
                    depth += (y in ")]") - (y in "([") if len(y) == 1 else 0
                    left.insert(0, out.pop())
                fn = "forall" if t[j].lower() == "all" else "exists"
                array = "".join(t[k + 1 : end]).strip()
                array = re.sub(r"^ARRAY\s*\[(.*)\]$", r"array(\1)", array, flags=re.S | re.I)
                lead = []
                while left and blank(left[0]):
                    lead.append(left.pop(0))
                out.append(f"{''.join(lead)}{fn}({array}, any_e -> {''.join(left)} {x} any_e)")
                i = end + 1
                continue
        out.append(x)
        i += 1
    return out


def row_compare(left: list[str], op: str, right: list[str]) -> str:
    """(a, b) op (c, d), column by column."""
    if op in ("=", "<>", "!="):
        return "(" + (" AND " if op == "=" else " OR ").join(f"{a} {op} {b}" for a, b in zip(left, right, strict=True)) + ")"
    if len(left) == 1:
        return f"{left[0]} {op} {right[0]}"
    return f"({left[0]} {op[0]} {right[0]} OR ({left[0]} = {right[0]} AND {row_compare(left[1:], op, right[1:])}))"


def rows_compared(t: list[str]) -> list[str]:
    """Comparisons of row values."""
    out: list[str] = []
    i = 0
    while i < len(t):
        before = next((x for x in reversed(out) if not blank(x)), "")
        if t[i] == "(" and (before == "(" or before.lower() in BEFORE_OPERAND):
            end = close_of(t, i)
            j = following(t, end + 1)
            k = following(t, j + 1)
            if k < len(t) and t[j] in COMPARE and t[k] == "(":
                left, right = split_args(t[i + 1 : end]), split_args(t[k + 1 : close_of(t, k)])
                if len(left) == len(right) > 1:
                    out.append(row_compare(left, t[j], right))
                    i = close_of(t, k) + 1
                    continue
        out.append(t[i])
        i += 1
    return out


def literal(text: str) -> str | None:
    """The value of a string constant."""
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" and TOKEN.fullmatch(text) else None


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def called(name: str, args: list[str]) -> str | None:
    """Spark's text of a call of PostgreSQL's function, where it is another one."""
    if name in ("extract", "date_part") and args:
        m = re.match(r"(\w+)\s+FROM\s+(.*)$", args[0], re.I | re.S) if name == "extract" else None
        field, x = (m[1].lower(), m[2]) if m else ((literal(args[0]) or "").lower(), args[1] if len(args) > 1 else "")
        return FIELDS[field].format(x) if field in FIELDS else None
    if name == "date_trunc" and len(args) == 2 and (literal(args[0]) or "").lower() in TRUNCATED:
        return TRUNCATED[literal(args[0]).lower()].format(args[1])
    if name == "regexp_replace" and len(args) in (3, 4) and None not in (values := [literal(x) for x in args[1:]]):
        pattern, new, flags = values[0].replace("\\\\", "\\"), values[1].replace("\\\\", "\\"), values[2] if len(values) > 2 else ""
        pattern = ("(?i)" if "i" in flags else "") + pattern
        found = (pattern, replacement(new)) if "g" in flags else first_match(pattern, new)
        return f"regexp_replace({args[0]}, {quoted(found[0])}, {quoted(found[1])})"
    if name in ("array_agg", "json_agg", "jsonb_agg") and len(args) == 1 and (m := re.match(r"(.*?)\s+ORDER\s+BY\s+(.*?)(\s+DESC)?(?:\s+ASC)?(?:\s+NULLS\s+(?:FIRST|LAST))?$", args[0], re.I | re.S)):
        ordered = f"transform(array_sort(collect_list(struct({m[2]} AS o, {m[1]} AS v)), (l, r) -> CASE WHEN l.o IS NULL AND r.o IS NULL THEN 0 WHEN l.o IS NULL THEN 1 WHEN r.o IS NULL THEN -1 WHEN l.o < r.o THEN -1 WHEN l.o > r.o THEN 1 ELSE 0 END), e -> e.v)"
        ordered = f"reverse({ordered})" if m[3] else ordered
        return ordered if name == "array_agg" else f"to_json({ordered})"
    if (name, len(args)) in SHAPED:
        return SHAPED[name, len(args)].format(*args)
    if name in ("jsonb_build_object", "json_build_object"):
        return f"to_json(named_struct({', '.join(args)}))"
    if name in RENAMED:
        return f"{RENAMED[name]}({', '.join(args)})"
    return None


def renamed(t: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(t):
        x, j = t[i], following(t, i + 1)
        if j < len(t) and t[j] == "(" and (x[0].isalpha() or x[0] == "_") and (end := close_of(t, j)):
            if x.lower() == "cast" and (inner := t[j + 1 : end]) and (m := re.match(r"(.*)\sAS\s+(?:CHAR|CHARACTER|BPCHAR)\s*\(\s*(\d+)\s*\)\s*$", "".join(inner), re.I | re.S)):
                out.append(f"rtrim(substring(CAST({''.join(renamed(tokens(m[1])))} AS STRING), 1, {m[2]}))")
                i = end + 1
                continue
            if x.lower() == "generate_series":
                out.append(f"explode(sequence({', '.join(split_args(t[j + 1 : end]))}))")
                i = end + 1
                continue
            if (shaped := called(x.lower(), split_args(renamed(t[j + 1 : end])))) is not None:
                out.append(shaped)
                i = end + 1
                continue
        if x == "::" and j < len(t) and t[j].lower() in ("char", "character", "bpchar") and (k := following(t, j + 1)) < len(t) and t[k] == "(":
            operand: list[str] = []
            while out and blank(out[-1]):
                out.pop()
            depth = 0
            while out:
                y = out[-1]
                if depth == 0 and (blank(y) or y in ("(", ",", "[") or y in COMPARE):
                    break
                depth += (y in ")]") - (y in "([") if len(y) == 1 else 0
                operand.insert(0, out.pop())
            out.append(f"rtrim(substring(CAST({''.join(operand)} AS STRING), 1, {''.join(t[k + 1 : close_of(t, k)]).strip()}))")
            i = close_of(t, k) + 1
            continue
        if x.lower() == "array" and j < len(t) and t[j] == "[":
            end = close_of(t, j)
            out.append(f"array({''.join(renamed(t[j + 1 : end]))})")
            i = end + 1
            continue
        if x in ("~", "!~", "~*", "!~*"):
            out.append((" NOT" if x[0] == "!" else "") + " RLIKE " + ("'(?i)' || " if x[-1] == "*" else ""))
        else:
            out.append(x)
        i += 1
    return out


def top_words(t: list[str]) -> list[tuple[int, str]]:
    """Place and lower-case text of each word outside brackets."""
    out, depth = [], 0
    for i, x in enumerate(t):
        depth += (x in "([") - (x in ")]") if len(x) == 1 else 0
        if depth == 0 and (x[0].isalpha() or x[0] == "_"):
            out.append((i, x.lower()))
    return out


def order_list(t: list[str]) -> tuple[int, int] | None:
    """Where the last ORDER BY outside brackets starts and its list ends."""
    words = top_words(t)
    for n in range(len(words) - 2, -1, -1):
        if words[n][1] == "order" and words[n + 1][1] == "by":
            end = next((i for i, w in words[n + 2 :] if w in ENDS_ORDER), len(t))
            return words[n][0], end
    return None


def distinct_on(t: list[str]) -> list[str]:
    words = top_words(t)
    for n, (i, w) in enumerate(words[:-2]):
        if w == "select" and words[n + 1][1] == "distinct" and words[n + 2][1] == "on":
            k = following(t, words[n + 2][0] + 1)
            end = close_of(t, k)
            keys = "".join(t[k + 1 : end])
            at = order_list(t)
            order = "".join(t[at[0] : at[1]]).rstrip() if at else f"ORDER BY {keys}"
            body = t[end + 1 : at[0]] if at else t[end + 1 :]
            rest = "".join(t[at[1] :]) if at else ""
            start = next(p for p, x in top_words(body) if x == "from")
            listed = "".join(body[:start])
            return [*t[:i], f"SELECT * EXCEPT (on_place) FROM (SELECT {listed}, row_number() OVER (PARTITION BY {keys} {order}) AS on_place {''.join(body[start:])}) WHERE on_place = 1 {rest}"]
    return t


def fetch(t: list[str]) -> list[str]:
    text = "".join(t)
    ties = re.search(r"\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)?\s*ROWS?\s+WITH\s+TIES\s*;?\s*$", text, re.I)
    if ties:
        at = order_list(t)
        if not at:
            raise ValueError("WITH TIES needs an ORDER BY")
        order, body = "".join(t[at[0] : at[1]]), t[: at[0]]
        start = next(p for p, x in top_words(body) if x == "from")
        return [f"SELECT * EXCEPT (tie_place) FROM ({''.join(body[:start])}, rank() OVER ({order}) AS tie_place {''.join(body[start:])}) WHERE tie_place <= {ties[1] or 1}"]
    return [re.sub(r"\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)?\s*ROWS?\s+ONLY\b", lambda m: f"LIMIT {m[1] or 1}", text, flags=re.I)]


def translate(text: str) -> str:
    """Spark's text of a PostgreSQL query."""
    t = tokens(text)
    t = tokens("".join(null_orders(t)))
    t = tokens("".join(distinct_on(t)))
    t = tokens("".join(fetch(t)))
    t = tokens("".join(quantified(t)))
    t = tokens("".join(rows_compared(t)))
    return "".join(renamed(t))


def sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """Run a PostgreSQL query; args are its parameters, by name (:name) or place (?)."""
    return typed.sql(spark, translate(text), args)
