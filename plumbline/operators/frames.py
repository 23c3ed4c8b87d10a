"""Relations by name: each is a function of other relations, put together as one DataFrame when it is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

RELATIONS: dict[str, Callable[[Frames], DataFrame]] = {}


def relation(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
    RELATIONS[f.__name__] = f
    return f


class Frames:
    """The given DataFrames and all that can be made from them; each relation is made once and shared."""

    def __init__(self, **given: DataFrame):
        self._held = dict(given)
        self._given = frozenset(given)

    def gives(self, *names: str) -> bool:
        """Whether any of these relations was given, so that it has to be read as it is."""
        return not self._given.isdisjoint(names)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in self._held and name not in RELATIONS):
            raise AttributeError(name)
        if name not in self._held:
            self._held[name] = RELATIONS[name](self)
        return self._held[name]
