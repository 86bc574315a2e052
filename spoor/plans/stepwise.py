"""Context kept line by line: what table functions, streams and users' passes go on from."""

from __future__ import annotations

import re
from typing import Any

from spoor.plans.records import RecordPass


class ContextState:
    """Which isolate, script and origin a line of a log belongs to, and how many origins its isolate has had."""

    def __init__(self) -> None:
        self.isolate: str | None = None
        self.script: int | None = None
        self.origins: dict[str, str | None] = {}
        self.epochs: dict[str, int] = {}

    def see(self, op: str | None, fields: list[str] | None) -> tuple[str | None, int | None, str | None, int]:
        """(isolate, script_id, origin, epoch) of the next line."""
        first = fields[0] if fields is not None and len(fields) else None
        if op == "~":
            self.isolate, self.script = first, None
        elif op == "!":
            self.script = int(first) if first and re.fullmatch(r"[+-]?[0-9]+", first) and -(1 << 31) <= int(first) < 1 << 31 else None
        elif op == "@":
            self.origins[self.isolate or ""] = first[1:-1] if first and len(first) >= 2 and first[0] == first[-1] == '"' else first
            self.epochs[self.isolate or ""] = self.epochs.get(self.isolate or "", 0) + 1
        return self.isolate, self.script, self.origins.get(self.isolate or ""), self.epochs.get(self.isolate or "", 0)


class ContextPass(RecordPass):
    """The context of every line, as a pass over lines that have none yet."""

    output = "line_no long, isolate string, script_id int, origin string, epoch long"
    columns = ("line_no", "op", "fields")

    def start(self) -> ContextState:
        return ContextState()

    def step(self, state: ContextState, record: Any) -> tuple[ContextState, list[tuple]]:
        return state, [(record.line_no, *state.see(record.op, record.fields))]
