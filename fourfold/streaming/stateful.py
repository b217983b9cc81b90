"""Trackers and machines as streaming state: a few numbers for each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fourfold.operators.adaptive import MomentTracker, code


def moments(stream: DataFrame, key: str, ts: str, tie: str, value: str, alpha: float = 0.01) -> DataFrame:
    """Thresholds and code after every row of each key; rows of a batch are taken in time order."""
    kind = stream.schema[key].dataType.simpleString()
    tie_kind = stream.schema[tie].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = MomentTracker(alpha)
        if state.exists:
            t.n, t.mean, t.m2, t.ti, t.tq = state.get
        rows = pd.concat(list(frames)).sort_values([ts, tie])
        out = []
        for row in rows.itertuples(index=False):
            x = getattr(row, value)
            t.step(x)
            out.append((k[0], getattr(row, tie), t.n, t.mean, t.std, t.ti, t.tq, code(x, t.ti, t.tq)))
        state.update((t.n, float(t.mean), float(t.m2), float(t.ti), float(t.tq)))
        yield pd.DataFrame(out, columns=[key, tie, "n", "mean", "std", "threshold_i", "threshold_q", "s"])

    return stream.select(key, ts, tie, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {tie} {tie_kind}, n long, mean double, std double, threshold_i double, threshold_q double, s int", "n long, mean double, m2 double, ti double, tq double", "append", GroupStateTimeout.NoTimeout)


def machine(stream: DataFrame, key: str, ts: str, tie: str, s: str, table: Sequence[tuple[str, int, str, str]], start: str, default: str = "hold") -> DataFrame:
    """A finite-state machine for each key."""
    moves: dict[tuple[str, int], tuple[str, str]] = {}
    for mode, got, to, action in table:
        moves.setdefault((mode, got), (to, action))
    kind, tie_kind = (stream.schema[c].dataType.simpleString() for c in (key, tie))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode = state.get[0] if state.exists else start
        out = []
        for row in pd.concat(list(frames)).sort_values([ts, tie]).itertuples(index=False):
            mode, action = moves.get((mode, int(getattr(row, s))), (mode, default))
            out.append((k[0], getattr(row, tie), mode, action))
        state.update((mode,))
        yield pd.DataFrame(out, columns=[key, tie, "mode", "action"])

    return stream.select(key, ts, tie, s).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {tie} {tie_kind}, mode string, action string", "mode string", "append", GroupStateTimeout.NoTimeout)
