"""The candidate-model dimension.

Its size is the number of cost columns of the benchmark table, so it is known
from the schema and lives on the driver: operators turn it into literals and
need neither a join nor a broadcast to use it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Models:
    names: tuple[str, ...]
    costs: tuple[float, ...]

    def __post_init__(self) -> None:
        if not self.names:
            raise ValueError("at least one model is needed")
        if len(self.names) != len(self.costs):
            raise ValueError("one cost per model is needed")

    def __len__(self) -> int:
        return len(self.names)

    @property
    def cost_literals(self) -> list[Column]:
        return [F.lit(float(c)) for c in self.costs]

    @property
    def max_cost(self) -> float:
        return max(self.costs)

    @property
    def cheapest(self) -> int:
        """Index of the cheapest model, first one on ties."""
        return min(range(len(self)), key=lambda i: (self.costs[i], i))

    def name_of(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in self.names]), index)

    def cost_of(self, index: Column) -> Column:
        return F.get(F.array(*self.cost_literals), index)

    def index_of(self, name: Column) -> Column:
        """Model name -> index; null when the name is null or unknown."""
        position = F.array_position(F.array(*[F.lit(n) for n in self.names]), name)
        return F.when(position > 0, (position - 1).cast("int"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(model_idx, model, model_cost), one row per model."""
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("model_idx"),
                    F.lit(n).alias("model"),
                    F.lit(float(c)).alias("model_cost"),
                )
                for i, (n, c) in enumerate(zip(self.names, self.costs))
            ]
        )
        return spark.range(1).select(F.inline(rows))
