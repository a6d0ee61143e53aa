"""Named transforms (DataFrame -> DataFrame) by kind; names are case-insensitive."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str, item: Callable | None = None):
        key = name.strip().lower()
        if not key:
            raise ValueError(f"{self.kind}: empty name")
        if item is None:
            return lambda f: self.register(name, f)
        self._items[key] = item
        return item

    def get(self, name: str) -> Callable:
        try:
            return self._items[name.strip().lower()]
        except KeyError:
            raise KeyError(f"{self.kind}: unknown {name!r}; known: {', '.join(self.names())}") from None

    def names(self) -> list[str]:
        return sorted(self._items)


SAMPLERS, SCORERS, GROUPERS, SELECTORS, PACKERS = (Registry(k) for k in ("sampler", "scorer", "grouper", "selector", "packer"))


def available() -> dict[str, list[str]]:
    return {r.kind: r.names() for r in (SAMPLERS, SCORERS, GROUPERS, SELECTORS, PACKERS)}
