"""Driver loop for iterative plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cohesia.storage import cut, drop


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], DataFrame], most: int = 100_000, name: str = "round") -> DataFrame:
    """Apply ``step`` until ``changed(new state)`` has no row.  Every round is a table in the shared folder, so the plan stays small,
    estimates are true, and the round before it is deleted."""
    state = cut(state, name)
    for _ in range(most):
        state, old = cut(step(state), name), state
        drop(old)
        if changed(state).isEmpty():
            return state
    raise RuntimeError(f"{name}: no fixpoint after {most} rounds")
