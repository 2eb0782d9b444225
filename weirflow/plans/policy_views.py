"""Relations replaced by their filtered views."""

from __future__ import annotations

from ..session import Session, TableRef
from .analysis import relations
from .tokens import Group, Item, Token, parse, text


def swap_names(items: list[Item], rename: dict[int, str]) -> list[Item]:
    """Token runs, known by the id of their first token, replaced by a name; parts and dots are dropped."""
    out, skip = [], 0
    for i in items:
        if skip and not isinstance(i, Group):
            skip -= 1
            continue
        if isinstance(i, Group):
            out.append(Group(i.open, swap_names(i.items, rename)))
        elif id(i) in rename:
            name, skip = rename[id(i)]
            out.append(Token("word", name))
        else:
            out.append(i)
    return out


def swap(sql: str, names: dict[TableRef, str], session: Session) -> str:
    """Each relation that resolves to a key becomes the named view, with its old last part as alias."""
    items = parse(sql)
    rename = {}
    for r in relations(items):
        ref = session.resolve(".".join(f'"{p}"' for p in r.parts))
        if ref in names:
            alias = "" if r.alias else f" AS {r.parts[-1]}"
            rename[id(r.tokens[0])] = (names[ref] + alias, 2 * (len(r.parts) - 1))
    return text(swap_names(items, rename))


def swap_views(sql: str, views: dict[TableRef, str], session: Session) -> str:
    return swap(sql, views, session)
