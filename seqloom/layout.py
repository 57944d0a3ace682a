"""Names and sizes of a sequence table.

A sequence table holds many independent sequences. Each has an id, consecutive steps from 0, a
warm-up prefix without required predictions, feature columns and two targets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY = "seq_ix"
STEP = "step_in_seq"
NEED = "need_prediction"
SCORED = "is_scored"


@dataclass(frozen=True)
class SequenceSpec:
    """Contract of one sequence table; defaults are those of the full-size data."""

    length: int = 20_000
    warmup: int = 99
    targets: tuple[str, ...] = ("t0", "t1")
    position_edges: tuple[int, ...] = (6_667, 13_333)
    # Rows of one sequence that a single task may hold. Windows and recursions are cut into
    # chunks of this many steps, so that a very long sequence spreads over the cluster.
    chunk: int = 4_096


@dataclass(frozen=True)
class FeatureLayout:
    """Ordered feature columns with their group, instrument and side."""

    names: tuple[str, ...]
    groups: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def order_book(cls) -> "FeatureLayout":
        """112 columns: per instrument 22 p, 22 v, 4 dp, 4 dv; then 8 auxiliary columns."""
        names: list[str] = []
        groups: dict[str, list[int]] = {}
        # The block sizes and the group name of each block.
        blocks = (("p", 22, "position"), ("v", 22, "velocity"),
                  ("dp", 4, "delta_position"), ("dv", 4, "delta_velocity"))
        for instrument in (0, 1):
            for stem, size, group in blocks:
                for k in range(size):
                    groups.setdefault(group, []).append(len(names))
                    names.append(f"i{instrument}_{stem}{k}")
        for k in range(8):
            groups.setdefault("auxiliary", []).append(len(names))
            names.append(f"a{k}")
        return cls(tuple(names), {g: tuple(ix) for g, ix in groups.items()})

    def frame(self, spark: SparkSession) -> DataFrame:
        """Metadata table `(feature, position, feature_group)`."""
        owner = {ix: g for g, members in self.groups.items() for ix in members}
        rows = [(n, i, owner.get(i, "other")) for i, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "feature string, position int, feature_group string")

    def schema(self, spec: SequenceSpec, scored: bool) -> T.StructType:
        """Exact ordered schema of a split."""
        fields = [T.StructField(KEY, T.LongType()), T.StructField(STEP, T.IntegerType()),
                  T.StructField(NEED, T.BooleanType())]
        if scored:
            fields.append(T.StructField(SCORED, T.BooleanType()))
        fields += [T.StructField(n, T.FloatType()) for n in (*self.names, *spec.targets)]
        return T.StructType(fields)
