"""Which sources to scan again: changes that have settled, changes that go on for long, and all of them now and then.

Every poll of a source is a row (source, at_ms, token, nudge): the token stands for the state of its files.
What is decided depends on the rows of a source in their order alone, so it is the same however they are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values: milliseconds after which a change is scanned unsettled, all is scanned again, and a nudge counts again
MAX_PENDING, RECONCILE, NUDGE_GAP = 15_000, 300_000, 5_000
OUT = "source string, at_ms long, reason string, token string"
STATE = "token string, synced string, pending long, reconciled long"


def decided(state: tuple, at: int, token: str | None, nudge: bool) -> tuple[tuple, str | None]:
    """(next state, reason or None) of one poll. The first poll of a source only sets what it is compared with; a change
    is scanned when two polls agree (`settled`) or MAX_PENDING after it was first seen (`overdue`); every RECONCILE, or
    NUDGE_GAP when nudged, all is scanned (`reconcile`). A poll without a token sees nothing."""
    last, synced, pending, reconciled = state
    reason = None
    reconciled = at if reconciled is None else reconciled
    if token is not None:
        if last is None:
            synced = token
        elif token == synced:
            pending = None
        else:
            pending = at if pending is None else pending
            if token == last or at - pending >= MAX_PENDING:
                reason = "settled" if token == last else "overdue"
                synced, pending = token, None
        last = token
    if at - reconciled >= RECONCILE or nudge and at - reconciled >= NUDGE_GAP:
        reason, synced, pending, reconciled = "reconcile", last, None, at
    return (last, synced, pending, reconciled), reason


def _run(source: str, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    out = []
    for r in rows.sort_values(["at_ms", "n"] if "n" in rows else "at_ms", kind="stable").itertuples(index=False):
        token = None if pd.isna(r.token) else r.token
        state, reason = decided(state, int(r.at_ms), token, bool(r.nudge) if not pd.isna(r.nudge) else False)
        if reason:
            out.append((source, int(r.at_ms), reason, state[0]))
    return pd.DataFrame(out, columns=["source", "at_ms", "reason", "token"]), state


def settled_changes(polls: DataFrame) -> DataFrame:
    """(source, at_ms, reason, token) of a stream of polls, or of a table of them. In a stream the rows of a source must
    arrive in order (those of one batch are sorted); its state are two tokens and two times, whatever it has seen."""
    if polls.isStreaming:

        def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
            out, state = _run(key[0], pd.concat(list(frames)), group.get if group.exists else (None,) * 4)
            group.update(state)
            yield out

        return polls.groupBy("source").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return polls.groupBy("source").applyInPandas(lambda key, rows: _run(key[0], rows, (None,) * 4)[0], OUT)
