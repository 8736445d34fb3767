"""Streams: detection row by row, and one dictionary a session kept across batches. An extension; batches remain the core."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.masking import mask_text
from ..operators.pipeline import all_candidates, merge, with_candidates


def detect_stream(docs: DataFrame) -> DataFrame:
    """Candidates of each row of a stream (or a batch); nothing is kept."""
    return with_candidates(docs)


def _session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entries, revision = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], -1)
    out = []
    for batch in batches:
        for row in batch.sort_values("revision").itertuples():
            if row.revision <= revision:  # came late: a newer text of the session has been seen
                continue
            revision = row.revision
            entries = merge(row.text or "", entries, all_candidates(row.text or ""))
            out.append((key[0], row.revision, mask_text(row.text or "", entries), len(entries)))
    state.update((json.dumps(entries, ensure_ascii=False), revision))
    yield pd.DataFrame(out, columns=["session_id", "revision", "masked", "n_entries"])


def session_dictionary(messages: DataFrame, at: str | None = None, idle_minutes: int = 24 * 60) -> DataFrame:
    """``messages`` (session_id string, revision long, text string) masked with a dictionary that grows with its session.

    With ``at``, a column of event times, a session that is silent for ``idle_minutes`` of them is forgotten, so state does
    not grow for ever. Without it, state is kept as long as the query's checkpoint.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from _session(key, batches, state)
        if at is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_minutes * 60_000)

    own = messages if at is None else messages.withWatermark(at, f"{idle_minutes} minutes")
    timeout = GroupStateTimeout.NoTimeout if at is None else GroupStateTimeout.EventTimeTimeout
    return own.groupBy("session_id").applyInPandasWithState(run, "session_id string, revision long, masked string, n_entries int", "entries string, revision long", "append", timeout)
