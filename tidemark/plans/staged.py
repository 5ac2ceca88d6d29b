"""A feature family: projections on top of each other, all over the same windows.

Each stage is one ``select``; a stage may use the columns of those before it. All windows of a family
share one partitioning and order, so the Spark plan has one exchange and one sort however many
features it makes, and Catalyst drops what the final projection does not need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.functions.dialect import DUCK, SPARK, Dialect

Stages = Callable[[Dialect], list[dict[str, str]]]


@dataclass(frozen=True)
class Family:
    name: str
    stages: Stages
    keep: tuple[str, ...]
    keys: tuple[str, ...] = ("symbol", "Date")

    def apply(self, df: DataFrame) -> DataFrame:
        """The family's columns beside all columns of df."""
        for stage in self.stages(SPARK):
            df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in stage.items()))
        return df

    def select(self, d: Dialect, base: str) -> str:
        """The family over the SQL query ``base``, in a dialect."""
        q = base
        for stage in self.stages(d):
            q = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM ({q}) q"
        return q

    def rounded(self, df: DataFrame, digits: int = 6) -> DataFrame:
        return self.apply(df).selectExpr(*self.keys, *(f"round({k}, {digits}) AS {k}" for k in self.keep))

    def sql(self, base: str, digits: int = 6) -> str:
        """The same as ``rounded`` over the SQL query ``base``, for the oracle."""
        q = base
        for stage in self.stages(DUCK):
            q = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM ({q})"
        return f"SELECT {', '.join(self.keys)}, {', '.join(f'round({k}, {digits}) AS {k}' for k in self.keep)} FROM ({q})"
