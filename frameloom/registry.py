"""A name-to-factory table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from frameloom.errors import DuplicateName, UnknownName

T = TypeVar("T")


class Registry(Generic[T]):
    def __init__(self, kind: str, missing: type[UnknownName] = UnknownName):
        self.kind, self.missing, self._made = kind, missing, {}

    def register(self, name: str, factory: T) -> T:
        if name in self._made:
            raise DuplicateName(f"{self.kind} {name!r} is registered already")
        self._made[name] = factory
        return factory

    def named(self, *names: str) -> Callable[[T], T]:
        def wrap(factory: T) -> T:
            for name in names:
                self.register(name, factory)
            return factory

        return wrap

    def get(self, name: str) -> T:
        if name not in self._made:
            raise self.missing(f"no {self.kind} {name!r}; there are {', '.join(self.names())}")
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._made)

    def __contains__(self, name: str) -> bool:
        return name in self._made
