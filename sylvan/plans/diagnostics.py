"""Errors of the dialect and their rendering with source lines."""
from __future__ import annotations

from dataclasses import dataclass, field


class PlanError(Exception):
    """A query that parses but can't be planned."""

    def __str__(self) -> str:
        return f"error: {self.args[0]}"


class EngineError(Exception):
    """A query that the engine rejects: unknown or ambiguous names, types that don't go together."""

    def __str__(self) -> str:
        return f"internal error: {self.args[0]}"


@dataclass(frozen=True)
class Diagnostic:
    """One error; ``start`` and ``end`` are byte offsets into the query."""

    message: str
    start: int
    end: int
    code: str = "E001"
    label: str = ""
    notes: tuple[str, ...] = field(default=())

    def place(self, source: bytes) -> tuple[int, int]:
        """Line and column, from 1; the column counts bytes."""
        before = source[: min(self.start, len(source))]
        return before.count(b"\n") + 1, len(before) - (before.rfind(b"\n") + 1) + 1

    def render(self, name: str, source: bytes) -> str:
        line, column = self.place(source)
        text = source.split(b"\n")[line - 1].decode("utf-8", "replace").removesuffix("\r")
        gutter = " " * len(str(line))
        mark = " " * (column - 1) + "^" + "~" * (self.end - self.start - 1) + (f" {self.label}" if self.label else "")
        rows = [f"Error[{self.code}]: {self.message}", f"{gutter} --> {name}:{line}:{column}", f"{gutter} |", f"{line} | {text}", f"{gutter} | {mark}"]
        return "\n".join([*rows, *(f"   = note: {n}" for n in self.notes), ""])


class QuerySyntaxError(Exception):
    """All errors found in one query; message and position are those of the first."""

    def __init__(self, diagnostics: list[Diagnostic], source: str):
        super().__init__(diagnostics[0].message)
        self.diagnostics, self.source = diagnostics, source

    @property
    def message(self) -> str:
        return self.diagnostics[0].message

    @property
    def position(self) -> int:
        return self.diagnostics[0].start

    def render(self, name: str = "query.sql") -> str:
        source = self.source.encode()
        return "\n\n".join(d.render(name, source) for d in self.diagnostics)
