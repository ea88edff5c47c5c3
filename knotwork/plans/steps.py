"""The logical plan: a tuple of steps, each an operator name with arguments and sub-plans."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

Plan = tuple["Step", ...]

#: Steps that look at one value and keep or drop it.
FILTERS = frozenset({"has", "has_key", "hasLabel", "hasId", "hasRank", "is"})
#: Steps that read all their input before they give anything.
BARRIERS = frozenset("count sum mean max min fold group groupCount dedup order limit range skip tail nearest".split())
#: Steps whose result depends on the order of their input.
ORDERED = frozenset("fold group order limit range skip tail".split())
#: Steps that need the path.
PATHED = frozenset("path simplePath cyclicPath".split())
WRITES = frozenset("addV addE property drop".split())


@dataclass(frozen=True)
class Step:
    op: str
    args: tuple[Any, ...] = ()
    subs: tuple[Plan, ...] = ()

    def __str__(self) -> str:
        inner = [repr(a) for a in self.args] + ["[" + ", ".join(map(str, s)) + "]" for s in self.subs]
        return f"{self.op}({', '.join(inner)})"


def walk(plan: Plan) -> Iterator[Step]:
    """All steps of a plan and of its sub-plans."""
    for step in plan:
        yield step
        for sub in step.subs:
            yield from walk(sub)


def dumps(plan: Plan) -> str:
    """The plan as JSON, for tests and logs."""

    def plain(step: Step) -> dict:
        return {"op": step.op, "args": [str(a) if not isinstance(a, (int, float, str, bool, type(None), list)) else a for a in step.args], "subs": [[plain(x) for x in s] for s in step.subs]}

    return json.dumps([plain(s) for s in plan])
