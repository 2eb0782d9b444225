"""Warehouse dialect to Spark SQL.

Each rule works on the bracket tree, innermost calls first, so rewrites apply at every depth and never
inside strings, quoted names or comments. What no rule knows passes through unchanged.

Date rules keep the warehouse's meaning, which Spark's functions of the same name don't have:
DATEDIFF counts the unit boundaries crossed, DATEADD keeps the type of its input, DATE_TRUNC gives a
timestamp without time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from .tokens import Group, Item, Token, blank, is_word, parse, solid, split, strip, text

UNITS = {
    "YEAR": "year", "YEARS": "year", "YY": "year", "YYYY": "year", "Y": "year",
    "QUARTER": "quarter", "QUARTERS": "quarter", "QTR": "quarter", "Q": "quarter",
    "MONTH": "month", "MONTHS": "month", "MM": "month", "MON": "month",
    "WEEK": "week", "WEEKS": "week", "W": "week", "WK": "week",
    "DAY": "day", "DAYS": "day", "D": "day", "DD": "day",
    "HOUR": "hour", "HOURS": "hour", "H": "hour", "HH": "hour", "HR": "hour",
    "MINUTE": "minute", "MINUTES": "minute", "MI": "minute", "MIN": "minute",
    "SECOND": "second", "SECONDS": "second", "S": "second", "SEC": "second",
}
HIDDEN = "__row_id"


def unit_of(arg: list[Item]) -> str | None:
    """The unit that a bare, compound or quoted argument names."""
    items = solid(arg)
    last = items[-1] if items else None
    if not isinstance(last, Token):
        return None
    name = last.text.strip("'") if last.kind == "string" else last.name()
    return UNITS.get(name.upper())


def date_diff(unit: str, a: str, b: str) -> str:
    """Boundaries of the unit between a and b."""
    if unit == "year":
        return f"(year({b}) - year({a}))"
    if unit == "quarter":
        return f"((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}))"
    if unit == "month":
        return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
    if unit == "week":
        return f"CAST(datediff(date_trunc('WEEK', {b}), date_trunc('WEEK', {a})) / 7 AS INT)"
    if unit == "day":
        return f"datediff(CAST({b} AS DATE), CAST({a} AS DATE))"
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    at = lambda x: f"floor(unix_seconds(CAST({x} AS TIMESTAMP)) / {size})"
    return f"({at(b)} - {at(a)})"


def date_add(unit: str, n: str, x: str) -> str:
    """x moved by n units, in the type of x."""
    if unit in ("year", "quarter", "month"):
        months = {"year": 12, "quarter": 3, "month": 1}[unit]
        return f"({x} + make_ym_interval(0, CAST(({n}) * {months} AS INT)))"
    if unit in ("week", "day"):
        return f"({x} + CAST(CAST(({n}) * {7 if unit == 'week' else 1} AS INT) AS INTERVAL DAY))"
    place = {"hour": "0, {}", "minute": "0, 0, {}", "second": "0, 0, 0, {}"}[unit]
    return f"({x} + make_dt_interval({place.format(f'CAST({n} AS INT)')}))"


def _iff(a):
    return f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END" if len(a) == 3 else None


def _decode(a):
    if len(a) < 3:
        return None
    pairs = [f" WHEN {a[0]} <=> {a[i]} THEN {a[i + 1]}" for i in range(1, len(a) - 1, 2)]
    rest = f" ELSE {a[-1]}" if len(a) % 2 == 0 else ""
    return f"CASE{''.join(pairs)}{rest} END"


def _object(a):
    if not a or len(a) % 2:
        return None
    fields = ", ".join(f"{a[i]}, {a[i + 1]}" for i in range(0, len(a), 2))
    return f"to_json(named_struct({fields}), map('ignoreNullFields', 'false'))"


def _rename(name: str) -> Callable[[list[str]], str | None]:
    return lambda a: f"{name}({', '.join(a)})"


#: Name to a function of the argument texts; None leaves the call alone.
SCALARS: dict[str, Callable[[list[str]], str | None]] = {
    "IFF": _iff,
    "DECODE": _decode,
    "EQUAL_NULL": lambda a: f"({a[0]} <=> {a[1]})" if len(a) == 2 else None,
    "NULLIFEQUAL": lambda a: f"({a[0]} <=> {a[1]})" if len(a) == 2 else None,
    "BOOLAND_AGG": _rename("bool_and"),
    "BOOLOR_AGG": _rename("bool_or"),
    "ZEROIFNULL": lambda a: f"COALESCE({a[0]}, 0)" if len(a) == 1 else None,
    "NVL": lambda a: f"COALESCE({a[0]}, {a[1]})" if len(a) == 2 else None,
    "NVL2": lambda a: f"CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} ELSE {a[2]} END" if len(a) == 3 else None,
    "CONVERT_TIMEZONE": lambda a: f"convert_timezone({a[0]}, {a[1]})" if len(a) == 2 else None,
    "OBJECT_CONSTRUCT": _object,
    "ARRAY_CONSTRUCT": _rename("array"),
    "TO_JSON": _rename("to_json"),
    "DIV0": lambda a: f"CASE WHEN {a[1]} = 0 THEN 0 ELSE {a[0]} / {a[1]} END" if len(a) == 2 else None,
}


def _path(args: list[list[Item]]) -> str | None:
    """GET_PATH(j, 'a.b') as JSON text; other than literal paths are left alone."""
    if len(args) != 2:
        return None
    last = solid(args[1])
    if len(last) != 1 or last[0].kind != "string":
        return None
    path = last[0].text[1:-1]
    path = path if path.startswith("$") else f"$.{path}" if not path.startswith("[") else f"${path}"
    return f"to_json(try_variant_get({_text(args[0])}, '{path}', 'variant'))"


def _date_call(name: str, args: list[list[Item]]) -> str | None:
    unit = unit_of(args[0]) if args else None
    if unit is None:
        return None
    rest = [_text(a) for a in args[1:]]
    if name in ("DATEDIFF", "TIMESTAMPDIFF", "TIMEDIFF") and len(rest) == 2:
        return date_diff(unit, *rest)
    if name in ("DATEADD", "TIMESTAMPADD", "TIMEADD") and len(rest) == 2:
        return date_add(unit, *rest)
    if name == "DATE_TRUNC" and len(rest) == 1:
        return f"CAST(date_trunc('{unit.upper()}', {rest[0]}) AS TIMESTAMP_NTZ)"
    return None


def _text(items: list[Item]) -> str:
    return text(strip(items))


def _call(name: str, group: Group) -> str | None:
    args = split(group.items)
    if name in ("DATEADD", "TIMESTAMPADD", "TIMEADD", "DATEDIFF", "TIMESTAMPDIFF", "TIMEDIFF", "DATE_TRUNC"):
        return _date_call(name, args)
    if name == "GET_PATH":
        return _path(args)
    if name in SCALARS and not any(is_word(i, "DISTINCT") for a in args for i in a[:1]):
        return SCALARS[name]([_text(a) for a in args])
    return None


def _flatten(items: list[Item], i: int) -> tuple[list[Item], int] | None:
    """LATERAL FLATTEN(input => x) [AS] f  to  LATERAL variant_explode(x) AS f(index, key, value)."""
    word = [k for k in range(i, len(items)) if not blank(items[k])]
    k = 1 if is_word(items[word[0]], "LATERAL") else 0
    if len(word) < k + 2 or not is_word(items[word[k]], "FLATTEN") or not isinstance(items[word[k + 1]], Group):
        return None
    args = split(items[word[k + 1]].items)
    if len(args) != 1:
        return None
    arrow = [n for n, x in enumerate(args[0]) if isinstance(x, Token) and x.text == "=>"]
    value = _text(args[0][arrow[0] + 1 :] if arrow else args[0])
    end, alias = word[k + 1], "f"
    after = word[k + 2 :]
    if after and is_word(items[after[0]], "AS"):
        after = after[1:]
    if after and isinstance(items[after[0]], Token) and items[after[0]].kind in ("word", "quoted") and not is_word(items[after[0]], *CLAUSES, "ON", "JOIN", "LEFT", "INNER", "CROSS"):
        end, alias = after[0], items[after[0]].text
    return parse(f"LATERAL variant_explode({value}) AS {alias}(index, key, value)"), end + 1


CLAUSES = ("WHERE", "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW")


def _clause(items: list[Item], *words: str, start: int = 0) -> int | None:
    return next((i for i in range(start, len(items)) if is_word(items[i], *words)), None)


def _qualify(items: list[Item]) -> list[Item]:
    """SELECT a FROM t QUALIFY c ORDER BY o  to  SELECT * EXCEPT (_q) FROM (SELECT a, c AS _q FROM t) WHERE _q ORDER BY o."""
    at = _clause(items, "QUALIFY")
    if at is None:
        return items
    select = max((i for i in range(at) if is_word(items[i], "SELECT")), default=None)
    if select is None:
        return items
    source = _clause(items, "FROM", start=select)
    end = _clause(items, "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "MINUS", start=at) or len(items)
    head, body, cond, tail = items[: select + 1], items[select + 1 : source], items[at + 1 : end], items[end:]
    distinct = ""
    if solid(body) and is_word(solid(body)[0], "DISTINCT"):
        distinct, body = "DISTINCT ", body[body.index(solid(body)[0]) + 1 :]
    made = f" {distinct}* EXCEPT (_qualified) FROM (SELECT{text(body)}, ({_text(cond)}) AS _qualified {_text(items[source:at])}) WHERE _qualified {text(tail)}"
    return head + parse(made.rstrip())


def _exclude(items: list[Item]) -> list[Item]:
    """`* EXCLUDE (a)` or `* EXCLUDE a` to Spark's `* EXCEPT (a)`."""
    out: list[Item] = []
    k = 0
    while k < len(items):
        i = items[k]
        last = next((x for x in reversed(out) if not blank(x)), None)
        if is_word(i, "EXCLUDE") and isinstance(last, Token) and last.text == "*":
            after = next(n for n in range(k + 1, len(items)) if not blank(items[n]))
            names = text(items[after].items) if isinstance(items[after], Group) else text(items[after])
            out += parse(f"EXCEPT ({names})")
            k = after + 1
        else:
            out.append(i)
            k += 1
    return out


def _rules(items: list[Item]) -> list[Item]:
    inner: list[Item] = [Group(i.open, _rules(i.items)) if isinstance(i, Group) else i for i in items]
    out: list[Item] = []
    k = 0
    while k < len(inner):
        i = inner[k]
        if is_word(i, "LATERAL", "FLATTEN") and (made := _flatten(inner, k)):
            out += made[0]
            k = made[1]
            continue
        nxt = next((n for n in range(k + 1, len(inner)) if not blank(inner[n])), None)
        group = inner[nxt] if nxt is not None else None
        last = next((x for x in reversed(out) if not blank(x)), None)
        named = isinstance(i, Token) and i.kind == "word" and not (isinstance(last, Token) and last.text == ".")
        if named and isinstance(group, Group) and group.open == "(" and (made := _call(i.upper, group)) is not None:
            out += parse(made)
            k = nxt + 1
            continue
        out.append(i)
        k += 1
    return _qualify(_exclude(out))


def strip_database(items: list[Item]) -> list[Item]:
    """First part of each three-part relation dropped; others are left alone."""
    from .analysis import relations

    edits = {id(r.tokens[0]): r for r in relations(items) if len(r.parts) == 3}

    def walk(some: list[Item]) -> list[Item]:
        out, skip = [], 0
        for i in some:
            if skip:
                skip -= 1
                continue
            if isinstance(i, Group):
                out.append(Group(i.open, walk(i.items)))
            elif id(i) in edits:
                skip = 1  # the name and the dot after it
            else:
                out.append(i)
        return out

    return walk(items)


def hide_internal(items: list[Item], holders: Callable[[str], bool]) -> list[Item]:
    """Adds `EXCEPT (__row_id)` to wildcards over relations that `holders` says have the column.

    A qualified wildcard looks at its own relation. Derived tables and CTEs hide it inside.
    """
    from .analysis import relations

    out: list[Item] = [Group(i.open, hide_internal(i.items, holders)) if isinstance(i, Group) else i for i in items]
    own = [r for r in relations(items, deep=False) if holders(".".join(r.parts))]
    if not own or not any(is_word(i, "SELECT") for i in items):
        return out
    names = {(r.alias or r.parts[-1]).upper() for r in own}
    made: list[Item] = []
    for k, i in enumerate(out):
        made.append(i)
        if not (isinstance(i, Token) and i.kind == "op" and i.text == "*"):
            continue
        before = solid(out[:k])
        after = solid(out[k + 1 :])
        last = before[-1] if before else None
        starts = is_word(last, "SELECT", "DISTINCT", "ALL") or (isinstance(last, Token) and last.text in (",", "."))
        ends = not after or is_word(after[0], "FROM", "EXCEPT", "EXCLUDE") or (isinstance(after[0], Token) and after[0].text == ",")
        qualified = isinstance(last, Token) and last.text == "."
        if not (starts and ends) or (qualified and before[-2].text.upper() not in names):
            continue
        if after and is_word(after[0], "EXCEPT", "EXCLUDE"):
            group = after[1]
            if isinstance(group, Group) and HIDDEN not in text(group):
                group.items += parse(f", {HIDDEN}")
        else:
            made += parse(f" EXCEPT ({HIDDEN})")
    return made


def rewrite(sql: str, holders: Callable[[str], bool] | None = None, keep_database: bool = False) -> str:
    """One statement in the warehouse dialect as Spark SQL."""
    items = parse(sql)
    if holders:
        items = hide_internal(items, holders)
    items = _rules(items)
    return text(items if keep_database else strip_database(items))
