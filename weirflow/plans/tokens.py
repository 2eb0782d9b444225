"""SQL tokens: strings, quoted names and comments are single tokens, so that no rule looks into them."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PATTERN = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^'\\]|''|\\.)*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d][\w$]*|\$\d+)
    |(?P<op>::|<=>|<>|!=|>=|<=|=>|->>|->|\|\||.)""",
    re.DOTALL | re.VERBOSE,
)


class SqlError(ValueError):
    """SQL text that can't be tokenized or paired."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    def name(self) -> str:
        return self.text[1:-1].replace(self.text[0] * 2, self.text[0]) if self.kind == "quoted" else self.text


@dataclass
class Group:
    """What stands between a pair of brackets."""

    open: str
    items: list[Token | Group]

    close = property(lambda self: {"(": ")", "[": "]"}[self.open])


Item = Token | Group


def tokenize(sql: str) -> list[Token]:
    out = []
    for m in _PATTERN.finditer(sql):
        kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
        if m["dollar"] is not None:
            kind = "dollar"
        if kind == "op" and m.group() in "'\"`":
            raise SqlError(f"unclosed {m.group()} at {m.start()}")
        if kind == "op" and sql.startswith("/*", m.start()):
            raise SqlError(f"unclosed comment at {m.start()}")
        out.append(Token(kind, m.group()))
    return out


def tree(tokens: list[Token]) -> list[Item]:
    """Tokens with each bracketed run as a Group."""
    stack: list[list[Item]] = [[]]
    opened: list[str] = []
    for t in tokens:
        if t.kind == "op" and t.text in "([":
            opened.append(t.text)
            stack.append([])
        elif t.kind == "op" and t.text in ")]":
            if not opened or {"(": ")", "[": "]"}[opened[-1]] != t.text:
                raise SqlError(f"unmatched {t.text}")
            done = Group(opened.pop(), stack.pop())
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    if opened:
        raise SqlError(f"unclosed {opened[-1]}")
    return stack[0]


def parse(sql: str) -> list[Item]:
    return tree(tokenize(sql))


def text(items: list[Item] | Item) -> str:
    if isinstance(items, Token):
        return items.text
    if isinstance(items, Group):
        return items.open + text(items.items) + items.close
    return "".join(text(i) for i in items)


def split(items: list[Item], sep: str = ",") -> list[list[Item]]:
    """Runs between separators of this level; blank edges are dropped."""
    runs: list[list[Item]] = [[]]
    for i in items:
        if isinstance(i, Token) and i.kind == "op" and i.text == sep:
            runs.append([])
        else:
            runs[-1].append(i)
    runs = [strip(r) for r in runs]
    return [] if runs == [[]] else runs


def blank(i: Item) -> bool:
    return isinstance(i, Token) and i.kind in ("space", "comment")


def strip(items: list[Item]) -> list[Item]:
    a, z = 0, len(items)
    while a < z and blank(items[a]):
        a += 1
    while z > a and blank(items[z - 1]):
        z -= 1
    return items[a:z]


def solid(items: list[Item]) -> list[Item]:
    return [i for i in items if not blank(i)]


def is_word(i: Item | None, *words: str) -> bool:
    return isinstance(i, Token) and i.kind == "word" and i.upper in words


def statements(sql: str) -> list[list[Item]]:
    return [s for s in split(parse(sql), ";") if solid(s)]
