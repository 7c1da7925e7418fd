"""Memo of text units for tokenizers that never join across certain borders.

A text is cut into units at borders that no token can cross; a unit's result is
worked out once and kept.  The memo is bounded by its estimated bytes: two
generations of ``BYTES_KEPT`` at most, the older one being dropped when the newer is
full, so words in use stay.  Units longer than ``LONGEST_KEPT`` aren't kept.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Estimated bytes of a generation.
BYTES_KEPT = 40 << 20
#: Estimated bytes of a unit beside its characters and those of its result.
UNIT_BYTES = 300
LONGEST_KEPT = 64


def _size(unit: str, result: Any) -> int:
    return UNIT_BYTES + len(unit) + (sum([len(x) for x in result if type(x) is str]) if type(result) is tuple else 0)


class UnitMemo:
    def __init__(self, work: Callable[[list[str]], list[Any]], kept: int = BYTES_KEPT):
        """work: results of some different units."""
        self.work, self.kept = work, kept
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.held = 0

    def ready(self, units: set[str]) -> dict[str, Any]:
        """A mapping that holds every one of these units."""
        new, old = self.new, self.old
        missing = units.difference(new)
        if not missing:
            return new
        unknown = missing.difference(old)
        for u in missing.difference(unknown) if old else ():
            new[u] = old[u]
            self.held += _size(u, old[u])
        todo = list(unknown)
        done = self.work(todo)
        new.update(zip(todo, done, strict=True))
        long = [u for u in todo if len(u) > LONGEST_KEPT]
        self.held += sum([_size(u, r) for u, r in zip(todo, done, strict=True) if len(u) <= LONGEST_KEPT])
        if not long and self.held <= self.kept:
            return new
        now = new
        if long:
            now = {u: new[u] for u in units}
            for u in long:
                del new[u]
        if self.held > self.kept:
            self.old, self.new, self.held = new, {}, 0
        return now
