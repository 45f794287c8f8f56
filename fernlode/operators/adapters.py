"""Ports: operators by name with adapters that are asked first, and what a calibrator and an ingestor have to offer."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame


class Calibrator(Protocol):
    """Turns labels into shares for each agent."""

    def __call__(self, labels: DataFrame) -> DataFrame: ...


class Ingestor(Protocol):
    """Turns documents of a foreign format into a tape."""

    def __call__(self, documents: DataFrame) -> DataFrame: ...


class Operators:
    """Operators by name; an adapter that returns None passes the call on, to the next adapter and then to the operator."""

    def __init__(self, core: dict[str, Callable[..., object]]):
        self.core = dict(core)
        self.adapters: list[Callable[[str, dict], object]] = []

    def adapt(self, adapter: Callable[[str, dict], object]) -> None:
        self.adapters.append(adapter)

    def names(self) -> list[str]:
        return sorted(self.core)

    def call(self, name: str, **arguments: object) -> object:
        for adapter in self.adapters:
            answer = adapter(name, arguments)
            if answer is not None:
                return answer
        if name not in self.core:
            raise KeyError(f"no operator {name}")
        return self.core[name](**arguments)
