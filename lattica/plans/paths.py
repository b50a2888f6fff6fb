"""Paths into typed values: ``$``, ``.name``, ``."quoted"``, ``[i]``, ``[-n]``, ``[#-k]`` and, in mutators, ``[#]``."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from .types import MAX_STEPS, SchemaError

_STEP = re.compile(r"""\.(?P<quoted>"(?:[^"\\]|\\.)*")|\.(?P<name>[A-Za-z_]\w*)|\[(?P<index>-?\d+)\]|\[\#-(?P<back>\d+)\]|(?P<append>\[\#\])""")
MAX_BYTES = 16_384


@dataclass(frozen=True)
class Step:
    """kind: ``name``, ``index``, ``back`` (from the end, 1 is the last) or ``append``."""

    kind: str
    value: str | int | None = None


def parse(path: str, mutating: bool = False) -> tuple[Step, ...]:
    if not path.startswith("$"):
        raise SchemaError(f"a path starts with $: {path!r}")
    if len(path.encode()) > MAX_BYTES:
        raise SchemaError(f"a path has {MAX_BYTES} bytes at most")
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise SchemaError(f"can't read {path!r} from {at}")
        at = m.end()
        if m["quoted"] is not None:
            steps.append(Step("name", json.loads(m["quoted"])))
        elif m["name"] is not None:
            steps.append(Step("name", m["name"]))
        elif m["index"] is not None:
            steps.append(Step("index", int(m["index"])))
        elif m["back"] is not None:
            if int(m["back"]) < 1:
                raise SchemaError("[#-k] counts from 1")
            steps.append(Step("back", int(m["back"])))
        else:
            steps.append(Step("append"))
    if len(steps) > MAX_STEPS:
        raise SchemaError(f"a path has {MAX_STEPS} steps at most")
    if any(s.kind == "append" for s in steps) and not (mutating and all(s.kind != "append" for s in steps[:-1])):
        raise SchemaError("[#] stands last in a path that changes a value")
    return tuple(steps)


def operand(x: str | int) -> str:
    """The path an arrow operand stands for: text from $ as it is, other text a name, an integer an index (below 0: from the end)."""
    if isinstance(x, int):
        return f"$[{x}]" if x >= 0 else f"$[#-{-x}]"
    return x if x.startswith("$") else f"$.{json.dumps(x)}"
