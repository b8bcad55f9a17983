"""The superstep loop: state in, state out, lineage cut every few rounds, driver sees one row a round at most."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.plans.lineage import discard, materialize


def supersteps(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, cut_every: int = 4) -> DataFrame:
    """step applied `rounds` times; a plan never holds more than cut_every rounds."""
    last = None
    for i in range(rounds):
        state = step(state, i)
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            state = materialize(state, "superstep")
            if last is not None:
                discard(last)  # no later round reads it
            last = state
    return state


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str = "changed", most: int | None = None, seconds: float | None = None) -> DataFrame:
    """step until no row has `changed`; step must set that boolean column.

    Rounds have no bound unless asked for: a state not settled after `most` rounds raises. `seconds` of wall clock is the deadline of
    the asynchronous loop: the state then is returned as it is, and its `changed` tells which rows are not settled.
    """
    begun, done, last = time.monotonic(), 0, None
    while most is None or done < most:
        state = materialize(step(state), "fixpoint")
        done += 1
        if last is not None:
            discard(last)  # no later round reads it
        last = state
        if state.where(F.col(changed)).limit(1).count() == 0:
            return state
        if seconds is not None and time.monotonic() - begun > seconds:
            return state
    raise RuntimeError(f"not settled after {most} rounds")
