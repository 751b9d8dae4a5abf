"""Host health as a stream: failures in a row by host, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.sources.health import FAILURES, FORGET_DAYS, HOURS

_OUT = "host string, failures long, last_failure timestamp, unwell boolean"
_HOUR_MS = 3_600_000
#: How late an attempt may come.
LATE = "1 hour"


def _row(host: str, failures: int, last: object, unwell: bool) -> pd.DataFrame:
    return pd.DataFrame({"host": [host], "failures": [failures], "last_failure": pd.Series([last], dtype="datetime64[ns]"), "unwell": [unwell]})


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts a host's failures since its last answer; counts and times are kept, not attempts.

    A host of which nothing is heard for HOURS (of the stream's own time) is well again, so that it may be tried; after FORGET_DAYS it is forgotten.
    """
    if state.hasTimedOut:
        failures, _, last, rested = state.get
        if rested:
            state.remove()
            return
        state.update((failures, state.get[1], last, True))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + FORGET_DAYS * 24 * _HOUR_MS)
        yield _row(key[0], failures, last, False)
        return
    failures, answered, last, _ = state.get if state.exists else (0, None, None, False)
    heard = state.getCurrentWatermarkMs()
    later = pd.Series(dtype="datetime64[ns]")  # times of this batch's failures that no answer has followed so far
    for x in frames:
        heard = max(heard, int(x["at"].max().timestamp() * 1000)) if len(x) else heard
        good = x.loc[~x["failed"], "at"]
        if len(good) and (answered is None or good.max() > answered):
            answered = good.max()
        later = pd.concat([later, x.loc[x["failed"], "at"]])
        if answered is not None:
            later = later[later > answered]
    if answered is not None and last is not None and last <= answered:
        failures, last = 0, None
    failures += len(later)
    if len(later):
        last = later.max() if last is None else max(last, later.max())
    state.update((failures, answered, last, False))
    state.setTimeoutTimestamp(heard + HOURS * _HOUR_MS)
    yield _row(key[0], failures, last, failures >= FAILURES)


def follow_health(attempts: DataFrame, host: str = "host", at: str = "at", failed: str = "failed") -> DataFrame:
    """A stream of host, failures (since the last answer), last_failure and unwell, one row for each host that a batch touches or that has rested for HOURS.

    attempts is a stream in rough order of time, LATE at most behind; a failure that comes after a later answer of its host isn't counted,
    and an answer that comes after a later failure takes none back.
    """
    rows = attempts.select(attempts[host].cast("string").alias("host"), attempts[at].cast("timestamp").alias("at"), attempts[failed].alias("failed"))
    state = "failures long, answered timestamp, last timestamp, rested boolean"
    rows = rows.where("at is not null").withWatermark("at", LATE)
    return rows.groupBy("host").applyInPandasWithState(_follow, _OUT, state, "update", GroupStateTimeout.EventTimeTimeout)
