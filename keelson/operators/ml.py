"""Learning: scalers, gradient descent, regressions, a linear SVM and a small network.

Rows are (x, y double) with x dense (array<double>) or sparse (array<struct<fea int, val double>>, fea from 0, repeated ones add up). The
network and sgd take dense rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.functions.vectors import divide_by, multiply_by


class Parameters:
    """A dense parameter vector on the driver."""

    def __init__(self, n: int, value: float = 0.0):
        self.values = [value] * n

    def get_all(self) -> list[float]:
        return list(self.values)

    def param_at(self, i: int) -> float:
        return self.values[i]

    def update(self, deltas: dict[int, float] | list[float]) -> None:
        for i, d in deltas.items() if isinstance(deltas, dict) else enumerate(deltas):
            self.values[i] += d

    def present(self) -> str:
        return " ".join(f"{v:.6g}" for v in self.values)


#: Up to so many dense features, sums and products are unrolled, so that they compile to plain arithmetic; beyond it features become rows.
UNROLLED = 64


def is_sparse(rows: DataFrame) -> bool:
    return isinstance(rows.schema["x"].dataType.elementType, StructType)


def feature_count(rows: DataFrame) -> int:
    """The longest dense vector, or the largest sparse index plus one."""
    n = F.array_max(F.transform("x", lambda e: e["fea"])) + 1 if is_sparse(rows) else F.size("x")
    return rows.select(F.max(n)).first()[0] or 0


def by_feature(rows: DataFrame, n: int, value: Callable[[Column], Column], fold: Callable[[Column], Column], *more: Column) -> tuple[list[float], list[float]]:
    """fold of value(x_i) for each of n features, and of the columns `more`, in one pass. The driver gets a number for each, the size of the model."""
    if not is_sparse(rows) and n <= UNROLLED:
        r = rows.agg(*(fold(value(F.get("x", F.lit(i)))).alias(f"s{i}") for i in range(n)), *(fold(m).alias(f"m{k}") for k, m in enumerate(more))).first()
        return [r[f"s{i}"] or 0.0 for i in range(n)], [r[f"m{k}"] or 0.0 for k in range(len(more))]
    # the columns follow the features as if they were further ones
    entries = F.col("x") if is_sparse(rows) else F.transform("x", lambda v, i: F.struct(i.alias("fea"), v.alias("val")))
    last = F.array(*(F.struct(F.lit(n + k).alias("fea"), m.cast("double").alias("val")) for k, m in enumerate(more)))
    each = rows.select(F.explode(F.concat(F.coalesce(entries, F.slice(last, 1, 0)), last) if more else entries).alias("e"), *(c for c in rows.columns if c != "x"))
    each = each.select(F.col("e.fea").alias("pos"), F.when(F.col("e.fea") < n, value(F.col("e.val"))).otherwise(F.col("e.val")).alias("v"))
    out = [0.0] * (n + len(more))
    for r in each.groupBy("pos").agg(fold(F.col("v")).alias("s")).collect():
        out[r["pos"]] = r["s"] or 0.0
    return out[:n], out[n:]


class MaxAbsScaler:
    """Divides each feature, and the label, by its largest absolute value; all-zero ones stay."""

    def __init__(self):
        self.x: list[float] = []
        self.y = 0.0

    def fit(self, *sets: DataFrame) -> MaxAbsScaler:
        n = None
        for rows in sets:
            n = feature_count(rows) if n is None else n
            now, (y,) = by_feature(rows, n, F.abs, F.max, F.abs("y"))
            self.x = [max(a, b) for a, b in zip(self.x, now, strict=True)] if self.x else now
            self.y = max(self.y, y)
        return self

    def _apply(self, rows: DataFrame, f: Callable[[Column, Column], Column], one: Callable[[Column, Column], Column], y: Callable[[Column], Column]) -> DataFrame:
        by = F.array(*[F.lit(float(v)) for v in self.x])
        if is_sparse(rows):
            by = F.transform(by, lambda d: F.when(d != 0, d).otherwise(F.lit(1.0)))
            x = F.transform("x", lambda e: F.struct(e["fea"].alias("fea"), one(e["val"], F.coalesce(F.get(by, e["fea"]), F.lit(1.0))).alias("val")))
        else:
            x = f(F.col("x"), by)
        return rows.withColumn("x", x).withColumn("y", y(F.col("y")) if self.y else F.col("y"))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self._apply(rows, divide_by, lambda v, d: v / d, lambda y: y / self.y)

    def inverse(self, rows: DataFrame) -> DataFrame:
        return self._apply(rows, multiply_by, lambda v, d: v * d, lambda y: y * self.y)

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).transform(rows)


def linear(w: list[float], sparse: bool = False) -> Column:
    """w . x + b with b last."""
    if sparse or len(w) - 1 > UNROLLED:
        weights = F.array(*[F.lit(float(v)) for v in w[:-1]])  # folded to one constant
        part = (lambda e: F.coalesce(F.get(weights, e["fea"]), F.lit(0.0)) * e["val"]) if sparse else None
        return F.lit(float(w[-1])) + F.aggregate(F.transform("x", part) if sparse else F.zip_with("x", weights, lambda x, v: x * v), F.lit(0.0), lambda s, v: s + v)
    out = F.lit(float(w[-1]))
    for i, v in enumerate(w[:-1]):
        out = out + F.lit(float(v)) * F.get("x", F.lit(i))
    return out


class Regression:
    """Batch gradient descent: one aggregation a round.

    gradient(w) is the factor g of each row in the update w += rate / n * sum(g * [x, 1]); error(w) a row's error, predict(w)
    its prediction. A function that is missing where it is needed is an error. Whether rows are sparse is seen in training, or set.
    """

    def __init__(self, gradient: Callable | None = None, error: Callable | None = None, predict: Callable | None = None, rate: float = 0.1):
        self.gradient, self.error, self.predict_column, self.rate, self.w, self.history, self.sparse = gradient, error, predict, rate, [], [], False

    def linear(self, w: list[float]) -> Column:
        return linear(w, self.sparse)

    def set_predict_func(self, f: Callable) -> None:
        self.predict_column = f

    def _start(self, rows: DataFrame) -> int:
        if not self.rate:
            raise ValueError("the learning rate is zero")
        if self.gradient is None:
            raise ValueError("no gradient function")
        self.sparse, n = is_sparse(rows), rows.count()
        if not n:
            raise ValueError("no training rows")
        self.w = self.w or [0.0] * (feature_count(rows) + 1)
        return n

    def _round(self, rows: DataFrame, n: int) -> None:
        sums, bias = by_feature(rows.select("x", self.gradient(self.w).alias("g")), len(self.w) - 1, lambda v: F.col("g") * v, F.sum, F.col("g"))
        self.w = [w + self.rate / n * s for w, s in zip(self.w, [*sums, *bias], strict=True)]

    def train(self, rows: DataFrame, rounds: int) -> Regression:
        n = self._start(rows)
        for _ in range(rounds):
            self._round(rows, n)
        return self

    def train_test(self, rows: DataFrame, test: DataFrame, rounds: int) -> Regression:
        """Stops early when the test error is 0 or rises."""
        n = self._start(rows)
        for _ in range(rounds):
            self._round(rows, n)
            self.history.append(self.avg_error(test))
            if self.history[-1] == 0 or len(self.history) > 1 and self.history[-1] > self.history[-2]:
                break
        return self

    def avg_error(self, rows: DataFrame) -> float:
        if self.error is None:
            raise ValueError("no error function")
        return rows.agg(F.avg(self.error(self.w))).first()[0]

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.predict_column is None:
            raise ValueError("no predict function")
        return rows.withColumn("prediction", self.predict_column(self.w))

    def present_param(self) -> str:
        return " ".join(f"{v:.6g}" for v in self.w)


class LinearRegression(Regression):
    def __init__(self, rate: float = 0.1):
        super().__init__(lambda w: F.col("y") - self.linear(w), lambda w: F.pow(F.col("y") - self.linear(w), F.lit(2.0)), self.linear, rate)

    def score(self, rows: DataFrame) -> float:
        """The coefficient of determination."""
        r = rows.select("y", self.error(self.w).alias("e")).agg(F.sum("e").alias("e"), F.var_pop("y").alias("v"), F.count("*").alias("n")).first()
        return 1 - r["e"] / (r["v"] * r["n"])


class LogisticRegression(Regression):
    """Labels 0 and 1; predicts 1 where w . x + b > 0; the error is the share of wrong predictions."""

    def __init__(self, rate: float = 0.1):
        says = lambda w: (self.linear(w) > 0).cast("double")
        super().__init__(lambda w: F.col("y") - 1 / (1 + F.exp(-self.linear(w))), lambda w: (says(w) != F.col("y")).cast("double"), says, rate)


class SVM:
    """Pegasos-style linear SVM; labels are -1 and 1.

    A round first shrinks all parameters to the ball of radius 1 / sqrt(lam); margins, and the norm in the loss, are those of the shrunk
    ones. The bias is not shrunk for good.
    """

    def __init__(self, lam: float = 0.01):
        self.lam, self.w, self.b, self.losses, self.sparse = lam, [], 0.0, [], False

    def train(self, rows: DataFrame, rounds: int) -> SVM:
        n, bad = rows.select(F.count("*"), F.max(F.when(F.abs("y") == 1, 0).otherwise(1))).first()
        if not n or bad:
            raise ValueError("labels must be -1 and 1")
        self.sparse = is_sparse(rows)
        self.w = self.w or [0.0] * feature_count(rows)
        for i in range(rounds):
            norm = sum(v * v for v in self.w)
            shrink = min(1.0, 1 / math.sqrt(norm * self.lam)) if norm else 1.0
            w, norm = [v * shrink for v in self.w], 1 / self.lam if shrink < 1 else norm
            margin = F.col("y") * linear([*w, self.b * shrink], self.sparse)
            near = rows.select("x", "y", margin.alias("m"), (margin < 1).cast("double").alias("in"))
            sums, (bias, hinge) = by_feature(near, len(w), lambda v: F.col("in") * F.col("y") * v, F.sum, F.col("in") * F.col("y"), F.greatest(F.lit(0.0), 1 - F.col("m")))
            eta = 1 / (i + 1)
            self.losses.append(self.lam / 2 * norm + hinge / n)
            self.w = [v * (1 - eta) + eta / (n * self.lam) * g for v, g in zip(w, sums, strict=True)]
            self.b += eta / n * bias
        return self

    def error(self, rows: DataFrame) -> float:
        """The share of rows on the wrong side; zero counts as right."""
        return rows.agg(F.avg((F.col("y") * linear([*self.w, self.b], is_sparse(rows)) < 0).cast("double"))).first()[0]


def sgd(rows: DataFrame, w: list[float], rate: float, gradient: Callable[[np.ndarray, np.ndarray, float], np.ndarray], rounds: int = 1) -> list[float]:
    """Each partition descends row by row from the same parameters; their changes are averaged by rows. Depends on partitioning, as the method does."""
    import pandas as pd

    if not rate:
        raise ValueError("the learning rate is zero")
    for _ in range(rounds):
        start = np.array(w, float)

        def run(batches, start=start):
            p, n = start.copy(), 0
            for pdf in batches:
                for x, y in zip(pdf["x"], pdf["y"], strict=True):
                    p += rate * gradient(p, np.append(np.asarray(x, float), 1.0), float(y))
                    n += 1
            yield pd.DataFrame({"n": [n], "d": [((p - start) * n).tolist()]})

        parts = rows.select("x", "y").mapInPandas(run, "n long, d array<double>")
        sums = parts.agg(F.sum("n").alias("n"), *(F.sum(F.get("d", F.lit(i))).alias(f"d{i}") for i in range(len(w)))).first()
        w = [a + (sums[f"d{i}"] or 0.0) / max(1, sums["n"] or 0) for i, a in enumerate(w)]
    return w


def linear_gradient(p: np.ndarray, x: np.ndarray, y: float) -> np.ndarray:
    return (y - p @ x) * x


def logistic_gradient(p: np.ndarray, x: np.ndarray, y: float) -> np.ndarray:
    return (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, p @ x))))) * x


class Network:
    """Sigmoid layers, quadratic cost; partitions train on their own in minibatches, then weights are averaged by rows."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.layers = [(rng.standard_normal((b, a)), rng.standard_normal(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    @staticmethod
    def _run(layers, x):
        out = [x]
        for w, b in layers:
            out.append(1 / (1 + np.exp(-np.clip(out[-1] @ w.T + b, -30, 30))))
        return out

    def train(self, rows: DataFrame, epochs: int = 10, batch: int = 10, rate: float = 3.0, seed: int = 0) -> Network:
        """rows: x, y with y the class number."""
        import pandas as pd

        classes = self.layers[-1][0].shape[0]
        for epoch in range(epochs):
            layers = [(w.copy(), b.copy()) for w, b in self.layers]

            def run(batches, layers=layers, epoch=epoch):
                n = 0
                for k_frame, p in enumerate(batches):  # a frame at a time, so no task holds its whole partition
                    if not len(p):
                        continue
                    x, want = np.stack(p["x"]), np.eye(classes)[p["y"].to_numpy().astype(int)]
                    order = np.random.default_rng([seed + epoch, k_frame]).permutation(len(p))
                    n += len(p)
                    for s in range(0, len(p), batch):
                        at = order[s : s + batch]
                        act = Network._run(layers, x[at])
                        delta = (act[-1] - want[at]) * act[-1] * (1 - act[-1])
                        for k in range(len(layers) - 1, -1, -1):
                            w, b = layers[k]
                            back = (delta @ w) * act[k] * (1 - act[k])
                            layers[k] = (w - rate / len(at) * delta.T @ act[k], b - rate / len(at) * delta.sum(axis=0))
                            delta = back
                yield pd.DataFrame({"n": [n], "p": [np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers]).tolist()]})

            parts = rows.select("x", "y").mapInPandas(run, "n long, p array<double>").where("n > 0")
            total, flat = 0, 0.0
            for r in parts.toLocalIterator():  # one row a partition
                total, flat = total + r["n"], flat + r["n"] * np.array(r["p"])
            if total:
                flat, at, new = flat / total, 0, []
                for w, b in self.layers:
                    new.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
                    at += w.size + b.size
                self.layers = new
        return self

    def accuracy(self, rows: DataFrame) -> float:
        import pandas as pd

        layers = self.layers

        def run(batches):
            for p in batches:
                if len(p):
                    yield pd.DataFrame({"n": [len(p)], "ok": [int((Network._run(layers, np.stack(p["x"]))[-1].argmax(axis=1) == p["y"]).sum())]})

        r = rows.select("x", "y").mapInPandas(run, "n long, ok long").agg(F.sum("ok"), F.sum("n")).first()
        return (r[0] or 0) / max(1, r[1] or 0)
