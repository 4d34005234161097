"""Pipelines: named transforms in order, with a policy for those that fail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    transform: Transform
    on_failure: str = "fail"  # or "skip": its input goes on as it is


@dataclass
class Pipeline:
    name: str
    steps: list[Step]
    degradations: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [s.name for s in self.steps]
        if len(set(names)) < len(names):
            raise ValueError("step names must be unique")

    def run(self, df: DataFrame) -> DataFrame:
        """The plan of all steps; a step that fails while its plan is made is skipped if it says so."""
        for step in self.steps:
            try:
                df = df.transform(step.transform)
            except Exception as error:
                if step.on_failure != "skip":
                    raise
                self.degradations.append((step.name, str(error)))
        return df

    def describe(self) -> str:
        return f"{self.name}: " + " -> ".join(s.name for s in self.steps)
