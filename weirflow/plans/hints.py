"""Routing hints in leading comments: `/*+ route(lake) strategy(attach) */`."""

from __future__ import annotations

import re
from dataclasses import dataclass

ROUTES = {"warehouse": "warehouse", "passthrough": "warehouse", "lake": "lake", "local": "lake", "hybrid": "hybrid", "remote": "hybrid"}
STRATEGIES = {"attach": "attach", "materialize": "materialize", "materialise": "materialize"}
_LEAD = re.compile(r"\s*(?:/\*(?P<block>.*?)\*/|--(?P<line>[^\n]*)(?:\n|$))", re.DOTALL)


@dataclass(frozen=True)
class Hints:
    route: str | None = None
    strategy: str | None = None


def parse_hints(sql: str) -> Hints:
    """Only comments before the statement count, `+` must come first in them, unknown hints are ignored."""
    route = strategy = None
    at = 0
    while m := _LEAD.match(sql, at):
        at = m.end()
        body = (m["block"] if m["block"] is not None else m["line"]).strip()
        if not body.startswith("+"):
            continue
        for name, arg in re.findall(r"(?:^|(?<=[\s,]))(\w+)\((\w*)\)(?=[\s,]|$)", body[1:].strip()):
            if name == "route":
                route = ROUTES.get(arg.lower(), route)
            elif name == "strategy":
                strategy = STRATEGIES.get(arg.lower(), strategy)
    return Hints(route, strategy)
