"""Hooks: named functions from DataFrame to DataFrame, run at a stage in order of priority, then id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Hooks:
    def __init__(self, stages: tuple[str, ...]):
        self._stages: dict[str, dict[str, tuple[int, Callable[[DataFrame], DataFrame]]]] = {s: {} for s in stages}

    def add(self, stage: str, hook_id: str, f: Callable[[DataFrame], DataFrame], priority: int = 100) -> None:
        """Register f; an unknown stage or an id already there raises ValueError."""
        if stage not in self._stages or hook_id in self._stages[stage]:
            raise ValueError(f"{stage}: {hook_id}")
        self._stages[stage][hook_id] = (priority, f)

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        """df through all hooks of the stage; they only build the plan, nothing is computed here."""
        for _, (_, f) in sorted(self._stages[stage].items(), key=lambda kv: (kv[1][0], kv[0])):
            df = f(df)
        return df
