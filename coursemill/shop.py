"""A shop is a set of named tables; how they are obtained is up to the loader."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

from .schema import TABLES


class Shop(Mapping[str, DataFrame]):
    """Read-only table name -> DataFrame mapping that loads each table on first use."""

    def __init__(self, load: Callable[[str], DataFrame], names: tuple[str, ...] = tuple(TABLES)):
        self._load = load
        self._names = names
        self._loaded: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, **tables: DataFrame) -> Shop:
        return cls(tables.__getitem__, tuple(tables))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            if name not in self._names:
                raise KeyError(name)
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def replace(self, **tables: DataFrame) -> Shop:
        """The same shop with some tables exchanged, e.g. after a write job."""
        names = tuple(dict.fromkeys([*self._names, *tables]))
        return Shop(lambda name: tables[name] if name in tables else self[name], names)
