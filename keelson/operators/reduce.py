"""Global aggregates with running values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RunningAggregate:
    """A value that syncs fold rounds of updates into.

    `reduce` is the aggregate over a round's rows (partial and final aggregation), `combine` folds a round's result into the
    value. With `reset` each sync starts from the initial value again. Updates are unseen until a sync; while inactive
    they wait.
    """

    def __init__(self, init: Any = 0, combine: Callable[[Any, Any], Any] | None = None, reduce: Callable[[Column], Column] = F.sum, reset: bool = False):
        self.init, self.value, self.combine, self.reduce, self.reset = init, init, combine or (lambda a, b: a + b), reduce, reset
        self.active, self.pending = True, []

    def update(self, rows: DataFrame, value: Column) -> RunningAggregate:
        self.pending.append(rows.select(value.alias("v")))
        return self

    def update_value(self, value: Any) -> RunningAggregate:
        """A single update from the driver."""
        self.pending.append(value)
        return self

    def get(self) -> Any:
        return self.value


class Aggregates:
    """Aggregates that sync together."""

    def __init__(self, *members: RunningAggregate):
        self.members = list(members)

    def activate_all(self, on: bool = True) -> None:
        for m in self.members:
            m.active = on

    def sync(self) -> None:
        """All active members take their pending updates; a reset member without any becomes its initial value."""
        for m in self.members:
            if not m.active:
                continue
            value = m.init if m.reset else m.value
            for p in m.pending:
                if isinstance(p, DataFrame):
                    p = p.agg(m.reduce(F.col("v")).alias("v")).first()["v"]
                if p is not None:
                    value = m.combine(value, p)
            m.pending, m.value = [], value


def monoid(rows: DataFrame, column: str, zero: Any, update: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], kind: str) -> Any:
    """A user-defined fold: one partial for each partition, Arrow batches in, partials merged on the driver (one small row a task)."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches):
        value = zero
        for b in batches:
            for x in b.column(0).to_pylist():
                value = update(value, x)
        yield pa.RecordBatch.from_arrays([pa.array([value], arrow)], names=["v"])

    total = zero
    for r in rows.select(column).mapInArrow(run, f"v {kind}").toLocalIterator():
        total = merge(total, r["v"])
    return total
