"""Keyed collections: a DataFrame with a declared key, attributes with defaults, and a catalogue of names."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.plans.lineage import materialize


class Collection:
    """An immutable keyed collection; every operation returns a new one."""

    def __init__(self, rows: DataFrame, key: str, attributes: dict[str, Any] | None = None):
        if key not in rows.columns:
            raise KeyError(key)
        self.rows, self.key, self.attributes = rows, key, dict(attributes or {})

    def _with(self, rows: DataFrame, attributes: dict[str, Any] | None = None) -> Collection:
        return Collection(rows, self.key, self.attributes if attributes is None else attributes)

    # rows
    def add(self, rows: DataFrame) -> Collection:
        """Appends rows; attributes they lack take their defaults. Equal keys stay side by side."""
        for name, default in self.attributes.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(default).cast(self.rows.schema[name].dataType))
        return self._with(self.rows.unionByName(rows))

    def delete(self, keys: DataFrame) -> Collection:
        """Without the rows whose key is in the first column of `keys`."""
        return self._with(self.rows.join(keys.select(F.col(keys.columns[0]).alias(self.key)).distinct(), self.key, "left_anti"))

    def delete_where(self, condition: Column) -> Collection:
        return self._with(self.rows.where(~F.coalesce(condition, F.lit(False))))

    def execute(self, *columns: Column | str, where: Column | None = None) -> DataFrame:
        """The columns of each object that `where` holds for: one pass over the collection, without a shuffle."""
        return (self.rows if where is None else self.rows.where(where)).select(*columns)

    def find_rows(self, key: Any) -> DataFrame:
        """The rows of that key; the filter reaches the scan."""
        return self.rows.where(F.col(self.key) == F.lit(key))

    def find(self, key: Any) -> Any | None:
        """One row of that key, or None."""
        return next(iter(self.find_rows(key).limit(1).collect()), None)

    def size(self) -> int:
        return self.rows.count()

    def sort(self) -> Collection:
        """By key within each partition."""
        return self._with(self.rows.sortWithinPartitions(self.key))

    def globalize(self, partitions: int | None = None) -> Collection:
        """Dealt by key, and sorted within partitions."""
        dealt = self.rows.repartition(partitions, self.key) if partitions else self.rows.repartition(self.key)
        return self._with(dealt.sortWithinPartitions(self.key))

    def shuffle(self, seed: int = 0) -> Collection:
        """Rows, with their attributes, in a random order."""
        return self._with(self.rows.orderBy(F.rand(seed)))

    def positions(self) -> DataFrame:
        """The position of each row in key order, from 0: ranks within range partitions plus their offsets, so no task sorts everything."""
        keyed = self.rows.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
        keyed = materialize(keyed, "positions")  # ranges come from a sample: what is counted and what is numbered must be one run of it
        counts = keyed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_low"))
        before = counts.select("_p", "_low", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
        return keyed.join(F.broadcast(before), "_p").withColumn("position", F.col("_i") - F.col("_low") + F.col("_before")).drop("_p", "_i", "_low", "_before")  # one row a partition

    def at(self, index: int) -> Any:
        row = next(iter(self.positions().where(F.col("position") == index).limit(1).collect()), None)
        if row is None:
            raise IndexError(index)
        return row

    def estimated_bytes(self, rate: float = 0.005, seed: int = 0) -> float:
        """Serialised size, from a sample of rows."""
        width = F.length(F.to_json(F.struct(*self.rows.columns)))
        seen = self.rows.sample(rate, seed).agg(F.avg(width)).first()[0]
        if seen is None:
            seen = self.rows.limit(100).agg(F.avg(width)).first()[0] or 0.0
        return seen * self.rows.count()

    # attributes
    def create_attribute(self, name: str, default: Any, kind: str) -> Collection:
        if name in self.rows.columns:
            raise ValueError(f"there is a column {name} already")
        return self._with(self.rows.withColumn(name, F.lit(default).cast(kind)), self.attributes | {name: default})

    def attribute(self, name: str) -> Column:
        if name not in self.attributes:
            raise KeyError(name)
        return F.coalesce(F.col(name), F.lit(self.attributes[name]))

    def set_attribute(self, name: str, value: Column) -> Collection:
        if name not in self.attributes:
            raise KeyError(name)
        return self._with(self.rows.withColumn(name, F.coalesce(value.cast(self.rows.schema[name].dataType), F.lit(self.attributes[name]))))

    def drop_attribute(self, name: str) -> tuple[Collection, int]:
        """The collection without it, and how many were dropped: 0 or 1."""
        if name not in self.attributes:
            return self, 0
        return self._with(self.rows.drop(name), {k: v for k, v in self.attributes.items() if k != name}), 1

    # storage
    def write(self, path: str) -> None:
        self.rows.sortWithinPartitions(self.key).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, key: str, attributes: dict[str, Any] | None = None) -> Collection:
        return Collection(spark.read.parquet(path), key, attributes)


class Registry:
    """Named things; a name is taken once, and dropping an unknown one is an error."""

    def __init__(self, what: str = "collection"):
        self.what, self.items, self._made = what, {}, 0

    def create(self, item: Any, name: str | None = None) -> str:
        if name is None:
            name, self._made = f"{self.what}-{self._made}", self._made + 1
        if name in self.items:
            raise ValueError(f"there is a {self.what} {name} already")
        self.items[name] = item
        return name

    def get(self, name: str) -> Any:
        return self.items[name]

    def has(self, name: str) -> bool:
        return name in self.items

    def drop(self, name: str) -> None:
        del self.items[name]

    def drop_all(self) -> None:
        self.items.clear()

    def size(self) -> int:
        return len(self.items)


def top_k(counts: DataFrame, count: str, tie: str, k: int = 10) -> DataFrame:
    """The k largest by (count, tie), larger ties first; one bounded heap a task."""
    return counts.orderBy(F.desc(count), F.desc(tie)).limit(k)


def arg_max(rows: DataFrame, what: str, by: str) -> DataFrame:
    """The largest `by` and its `what`; of ties the larger `what`."""
    best = F.max(F.struct(F.col(by), F.col(what))).alias("b")
    return rows.agg(best).select(F.col(f"b.{what}").alias(what), F.col(f"b.{by}").alias(by))
