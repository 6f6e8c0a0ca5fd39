"""Keyed upsert of incidents as a stateful stream; its batch form is ``q_stm08_keyed_upsert``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MERGE_MINUTES = 180


def merged_status(prev: str, new: str) -> str:
    """A confirmation falls only to a recovery, a rejection only to a confirmation; else reports replace what was."""
    if prev == "CONFIRMED":
        return "CLEARED" if new == "CLEARED" else prev
    if prev == "REJECTED":
        return new if new == "CONFIRMED" else prev
    return new if new in ("REPORTED", "CONFIRMED") else prev


def upserts(reports: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changed incidents (id, start, status, reports) of a stream (id, at, seq, status) for output mode ``update``.

    A report within MERGE_MINUTES of the start of its key's open incident merges into it; a later one supersedes it.
    A sink keeps the last row per (id, start), the one with most reports. State is one incident a key and goes once the
    watermark is past its merge window, so it is bounded by the keys that are active within it.
    """
    span = MERGE_MINUTES * 60_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = list(state.get) if state.exists else None
        done = {}
        for r in pd.concat(batches).sort_values(["at", "seq"]).itertuples():
            at = r.at.value // 1_000
            if open_ is None or at - open_[0] > span * 1_000:
                open_ = [at, r.status, 1]
            else:
                open_ = [open_[0], merged_status(open_[1], r.status), open_[2] + 1]
            done[open_[0]] = tuple(open_)
        state.update(tuple(open_))
        state.setTimeoutTimestamp(max(open_[0] // 1_000 + span, state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], pd.Timestamp(s, unit="us"), status, n) for s, status, n in done.values()]
        yield pd.DataFrame(rows, columns=["id", "start", "status", "reports"])

    marked = reports.withWatermark("at", late).groupBy("id")
    return marked.applyInPandasWithState(fold, "id long, start timestamp, status string, reports long", "start long, status string, reports long", "update", GroupStateTimeout.EventTimeTimeout)
