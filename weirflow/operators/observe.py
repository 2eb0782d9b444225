"""What a query did: rows and times of its operators, and a sampler of queries to look at."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Node:
    name: str
    detail: str
    metrics: dict[str, int]
    children: list[Node] = field(default_factory=list)

    def walk(self, depth: int = 0):
        yield depth, self
        for c in self.children:
            yield from c.walk(depth + 1)


def _node(plan) -> Node:
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _node(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _node(plan.plan())
    metrics, it = {}, plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metrics[pair._1()] = pair._2().value()
    children, kids = [], plan.children().iterator()
    while kids.hasNext():
        children.append(_node(kids.next()))
    return Node(name.strip(), plan.simpleString(200), metrics, children)


def analyze(df: DataFrame) -> tuple[int, Node]:
    """(rows, executed plan with its metrics): runs the query to the end; its rows stay on the executors."""
    done = df._jdf.queryExecution()
    rows = done.toRdd().count()
    return rows, _node(done.executedPlan())


def explain_analyze(df: DataFrame) -> str:
    """The executed plan as text, a line per operator."""
    rows, top = analyze(df)
    lines = [f"rows: {rows}"]
    for depth, n in top.walk():
        told = ", ".join(f"{k}={v}" for k, v in sorted(n.metrics.items()) if v)
        lines.append("  " * depth + n.name + (f" [{told}]" if told else ""))
    return "\n".join(lines) + "\n"


class Sampler:
    """Takes a share of what it is offered into a bounded queue; what comes to a full queue is dropped."""

    def __init__(self, rate: float, size: int = 64, seed: int | None = None):
        self.rate, self.size, self.random = min(max(rate, 0.0), 1.0), size, random.Random(seed)
        self.queue: deque = deque()
        self.offered = self.taken = self.dropped = 0

    def offer(self, item) -> bool:
        self.offered += 1
        if self.random.random() >= self.rate:
            return False
        if len(self.queue) >= self.size:
            self.dropped += 1
            return False
        self.queue.append(item)
        self.taken += 1
        return True

    def drain(self, check: Callable[[object], bool], most: int | None = None) -> tuple[int, int]:
        """(checked, failed) of the queued items, oldest first."""
        checked = failed = 0
        while self.queue and (most is None or checked < most):
            checked += 1
            failed += not check(self.queue.popleft())
        return checked, failed
