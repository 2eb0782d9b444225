"""What a statement is: its relations, whether it writes, which features it needs, and how a view body classifies."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..session import Session, TableRef
from .tokens import Group, Item, SqlError, Token, is_word, parse, solid, split, statements, text, tokenize

_WRITES = {"INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "DROP", "GRANT", "REVOKE"}
_CREATED = {"TABLE", "VIEW", "SCHEMA", "DATABASE"}
_STATEMENTS = _WRITES | {"SELECT", "WITH", "CREATE", "ALTER", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "USE", "SET", "VALUES", "CALL", "FROM", "TABLE"}
_ENDS = ("WHERE", "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "SELECT", "SET", "WHEN", "VALUES", "RETURNING")
_NOT_ALIAS = (*_ENDS, "ON", "USING", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "LATERAL", "AS", "AT", "BEFORE", "TABLESAMPLE", "SAMPLE", "PIVOT", "UNPIVOT")

#: Feature probes in order, first match wins: words before a bracket or names; the label is what is reported. Fixed values.
CALL_PROBES = (("call_udf", "Snowpark"), ("call_sproc", "Snowpark"), ("time_slice", "TIME_SLICE"), ("generator", "GENERATOR"), ("flatten", "FLATTEN"), ("any_value", "ANY_VALUE"))

#: Aggregate names that a view body may not project. Fixed values.
AGGREGATES = frozenset(
    "COUNT SUM AVG MIN MAX STDDEV STDDEV_POP STDDEV_SAMP VAR_POP VAR_SAMP VARIANCE CORR COVAR_POP COVAR_SAMP MEDIAN PERCENTILE_CONT"
    " PERCENTILE_DISC ANY_VALUE APPROX_COUNT_DISTINCT LISTAGG ARRAY_AGG OBJECT_AGG STRING_AGG BITAND_AGG BITOR_AGG BITXOR_AGG BOOLAND_AGG BOOLOR_AGG".split()
)
#: Functions whose value changes from call to call. Fixed values.
VOLATILE = frozenset("CURRENT_TIMESTAMP CURRENT_DATE CURRENT_TIME LOCALTIMESTAMP LOCALTIME SYSDATE RANDOM RANDSTR UUID_STRING SEQ1 SEQ2 SEQ4 SEQ8".split())


@dataclass(frozen=True)
class Relation:
    parts: tuple[str, ...]
    alias: str | None
    tokens: tuple[Token, ...] = field(compare=False)


def _cte_names(items: list[Item]) -> set[str]:
    body = solid(items)
    if not body or not is_word(body[0], "WITH"):
        return set()
    return {body[i - 1].name().upper() for i in range(1, len(body) - 1) if is_word(body[i], "AS") and isinstance(body[i + 1], Group) and isinstance(body[i - 1], Token)} | {
        body[i].name().upper() for i in range(1, len(body) - 2) if isinstance(body[i + 1], Group) and is_word(body[i + 2], "AS") and isinstance(body[i], Token)
    }


def relations(items: list[Item], deep: bool = True, hidden: frozenset[str] = frozenset()) -> list[Relation]:
    """Named relations in order of appearance, repeats kept, without CTE names and table functions."""
    hidden = hidden | _cte_names(items)
    found: list[Relation] = []
    body = solid(items)
    state = ""  # "want" a relation, or "in" a FROM clause after one
    # FROM inside a call, as in EXTRACT(YEAR FROM ts), names no relation
    clause = any(is_word(i, "SELECT", "DELETE", "INSERT", "MERGE") for i in body) or is_word(body[0] if body else None, "FROM")
    k = 0
    while k < len(body):
        i = body[k]
        if clause and is_word(i, "FROM", "JOIN", "INTO") and not (is_word(i, "FROM") and k and is_word(body[k - 1], "DISTINCT")):
            state = "want"
        elif is_word(i, "UPDATE") and k == 0:
            state = "want"
        elif is_word(i, *_ENDS):
            state = ""
        elif state == "in" and isinstance(i, Token) and i.text == ",":
            state = "want"
        elif state == "want" and is_word(i, "LATERAL", "TABLE", "ONLY"):
            state = "in" if not is_word(i, "ONLY") else state
        elif state == "want" and isinstance(i, Group):
            if deep or not any(is_word(x, "SELECT", "WITH", "VALUES") for x in i.items):
                found += relations(i.items if any(is_word(x, "SELECT", "WITH", "VALUES") for x in i.items) else [Token("word", "FROM"), *i.items], deep, hidden)
            state = "in"
        elif state == "want" and isinstance(i, Token) and i.kind in ("word", "quoted"):
            names = [i]
            while k + 2 < len(body) and isinstance(body[k + 1], Token) and body[k + 1].text == "." and isinstance(body[k + 2], Token):
                names.append(body[k + 2])
                k += 2
            nxt = body[k + 1] if k + 1 < len(body) else None
            if not isinstance(nxt, Group):
                alias = body[k + 2] if is_word(nxt, "AS") and k + 2 < len(body) else nxt
                named = isinstance(alias, Token) and alias.kind in ("word", "quoted") and not is_word(alias, *_NOT_ALIAS)
                parts = tuple(n.name() for n in names)
                if not (len(parts) == 1 and parts[0].upper() in hidden):
                    found.append(Relation(parts, alias.name() if named else None, tuple(names)))
            state = "in"
        elif isinstance(i, Group) and deep:
            found += relations(i.items, deep, hidden)
        k += 1
    return found


def extract_tables(sql: str, session: Session) -> list[TableRef]:
    """Distinct tables in order, unqualified names by the session's defaults."""
    refs = [session.resolve(".".join(f'"{p}"' for p in r.parts)) for s in statements(sql) for r in relations(s)]
    return list(dict.fromkeys(r for r in refs if r))


def check(sql: str) -> list[list[Item]]:
    """The statements, or SqlError when the text isn't SQL of a known form."""
    found = statements(sql)
    if not found:
        raise SqlError("no statement")
    for s in found:
        first = solid(s)[0]
        if isinstance(first, Group):
            continue
        if not is_word(first, *_STATEMENTS):
            raise SqlError(f"no statement starts with {text(first)!r}")
        body = solid(s)
        if is_word(body[-1], "SELECT", "FROM", "WHERE", "BY", "JOIN", "ON", "AND", "OR") or (isinstance(body[-1], Token) and body[-1].text in (",", "=", "<", ">")):
            raise SqlError("the statement ends too early")
        if is_word(first, "SELECT") and len(body) > 1 and is_word(body[1], "FROM"):
            raise SqlError("nothing is selected")
        for a, b in zip(body, body[1:], strict=False):
            if is_word(a, "FROM") and is_word(b, "WHERE", "GROUP", "ORDER", "FROM", "SELECT"):
                raise SqlError("nothing stands after FROM")
    return found


def is_write(found: list[list[Item]]) -> bool:
    for s in found:
        words = [i.upper for i in solid(s) if isinstance(i, Token)][:6]
        if words and words[0] in _WRITES:
            return True
        if words[:1] == ["CREATE"] and _CREATED & set(words):
            return True
        if words[:2] == ["ALTER", "TABLE"]:
            return True
        if words[:1] == ["WITH"] and any(is_word(i, "INSERT", "UPDATE", "DELETE", "MERGE") for i in solid(s)):
            return True
    return False


def feature(found: list[list[Item]]) -> str | None:
    """Label of the first warehouse-only feature, looked for among tokens so that literals never match."""
    calls, names, travel = set(), set(), False

    def walk(items: list[Item]) -> None:
        nonlocal travel
        body = solid(items)
        for i, nxt in zip(body, [*body[1:], None], strict=False):
            if isinstance(i, Group):
                walk(i.items)
            elif i.kind in ("word", "quoted"):
                names.add(i.name().lower())
                if isinstance(nxt, Group):
                    calls.add(i.name().lower())
                    inner = solid(nxt.items)
                    if i.name().lower() in ("at", "before") and inner and is_word(inner[0], "TIMESTAMP", "OFFSET", "STATEMENT"):
                        travel = True

    for s in found:
        walk(s)
    for probe, label in CALL_PROBES:
        if probe in calls:
            return label
    if "information_schema" in names:
        return "INFORMATION_SCHEMA"
    return "Time Travel" if travel else None


def redact(sql: str) -> str:
    """Literals to `?`; names, comments and keywords stay."""
    return "".join("?" if t.kind in ("string", "number", "dollar") else t.text for t in tokenize(sql))


@dataclass(frozen=True)
class Analysis:
    bucket: str  # routable, passthrough or unknown
    reason: str | None
    tables: tuple[TableRef, ...]
    redacted: str


AUDIT = Session(database="AUDIT_UNQUALIFIED", schema="PUBLIC")


def _system(t: TableRef) -> bool:
    return t.schema.upper() == "INFORMATION_SCHEMA" or t.database.upper() in ("SNOWFLAKE", "AUDIT_UNQUALIFIED")


def classify_query(sql: str, session: Session = AUDIT) -> Analysis:
    """Workload bucket of a logged statement."""
    sql = sql.strip()
    if not sql:
        return Analysis("unknown", None, (), "")
    try:
        redacted = redact(sql)
        found = check(sql)
    except SqlError:
        return Analysis("passthrough", "parse_failed", (), re.sub(r"'[^']*'|\b\d+(?:\.\d+)?\b", "?", sql))
    if is_write(found):
        return Analysis("passthrough", "write", (), redacted)
    if feature(found):
        return Analysis("passthrough", "feature", (), redacted)
    tables = tuple(extract_tables(sql, session))
    if all(map(_system, tables)):
        return Analysis("unknown", None, tables, redacted)
    return Analysis("routable", None, tables, redacted)


def classify_view(body: str) -> tuple[str, list[str]]:
    """stream_compatible, decomposable_only with reasons, or unsupported with one."""
    try:
        found = check(body)
    except SqlError:
        return "unsupported", ["parse"]
    if len(found) != 1 or not any(is_word(i, "SELECT") for i in found[0]):
        return "unsupported", ["no_select"]
    items = solid(found[0])
    reasons: list[str] = []
    if is_word(items[0], "WITH"):
        items = items[next(k for k, i in enumerate(items) if is_word(i, "SELECT")) :]
    branches: list[list[Item]] = [[]]
    for k, i in enumerate(items):
        if is_word(i, "UNION", "INTERSECT", "EXCEPT", "MINUS"):
            if not (is_word(i, "UNION") and is_word(items[k + 1], "ALL")):
                reasons.append("set_op")
            branches.append([])
        elif not (is_word(i, "ALL") and is_word(items[k - 1], "UNION")):
            branches[-1].append(i)
    for b in branches:
        if len(b) == 1 and isinstance(b[0], Group):
            reasons.append("nested_set_expr")
            continue
        reasons += _select_reasons(b)
    reasons = list(dict.fromkeys(reasons))
    return ("decomposable_only", reasons) if reasons else ("stream_compatible", [])


def _select_reasons(b: list[Item]) -> list[str]:
    out = []
    for k, i in enumerate(b):
        if is_word(i, "LIMIT", "FETCH", "TOP"):
            out.append("limit")
        if k + 1 < len(b) and is_word(b[k + 1], "BY") and is_word(i, "ORDER", "GROUP", "CLUSTER", "DISTRIBUTE", "SORT"):
            out.append({"ORDER": "order_by", "GROUP": "group_by"}.get(i.upper, "sort_by"))
        if is_word(i, "HAVING", "QUALIFY"):
            out.append(i.text.lower())
        if is_word(i, "DISTINCT") and k and is_word(b[k - 1], "SELECT"):
            out.append("distinct")
    source = next((k for k, i in enumerate(b) if is_word(i, "FROM")), len(b))
    end = next((k for k in range(source, len(b)) if is_word(b[k], *_ENDS)), len(b))

    def walk(items: list[Item], projected: bool, from_clause: bool) -> None:
        body = solid(items)
        for k, i in enumerate(body):
            if isinstance(i, Group):
                sub = solid(i.items)
                if sub and is_word(sub[0], "SELECT", "WITH"):
                    if not from_clause:
                        out.append("subquery")
                    continue
                over = k and isinstance(body[k - 1], Token) and k + 1 < len(body) and is_word(body[k + 1], "OVER")
                if projected and k and isinstance(body[k - 1], Token) and body[k - 1].upper in AGGREGATES and not over:
                    out.append("aggregate")
                walk(i.items, projected, from_clause)
            elif i.kind == "word" and i.upper in VOLATILE and not (k and isinstance(body[k - 1], Token) and body[k - 1].text == "."):
                out.append("volatile")

    walk(b[:source], True, False)
    walk(b[source:end], False, True)
    walk(b[end:], False, False)
    return out


def select_list(items: list[Item]) -> list[list[Item]]:
    body = solid(items)
    a = next(k for k, i in enumerate(body) if is_word(i, "SELECT"))
    z = next((k for k in range(a, len(body)) if is_word(body[k], "FROM")), len(body))
    return split(body[a + 1 : z])


def parses(sql: str) -> bool:
    try:
        parse(sql)
        return True
    except SqlError:
        return False
