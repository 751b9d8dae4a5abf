"""Requests as a stream: engines that rest after an empty answer, and addresses that a run asks for once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values. Seconds that an engine rests after it gave nothing.
REST_SECONDS = 40
#: How late a request may come.
LATE, LATE_SECONDS = "1 hour", 3600
#: Requests that are judged and given on at once.
PIECE = 100_000
_ASKED = "engine string, id long, at timestamp, hits long"


def _rest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The requests of an engine that are made, in order of time: one that gives nothing lets it rest. Of what a batch holds of an engine three numbers a request are kept and sorted; what is made leaves piece by piece."""
    if state.hasTimedOut:
        state.remove()
        return
    until = int(pd.Timestamp(state.get[0]).value) if state.exists else None
    kept = [(x["at"].to_numpy("datetime64[ns]").astype(np.int64), x["id"].to_numpy(np.int64), x["hits"].to_numpy(np.int64)) for x in frames]
    at, ids, hits = (np.concatenate(c) for c in zip(*kept, strict=True))
    del kept
    order = np.lexsort((ids, at))
    for start in range(0, len(order), PIECE):
        some = order[start : start + PIECE]
        made = np.zeros(len(some), bool)
        for n, (t, h) in enumerate(zip(at[some].tolist(), hits[some].tolist(), strict=True)):
            if until is None or t >= until:
                made[n] = True
                if h == 0:
                    until = t + REST_SECONDS * 1_000_000_000
        some = some[made]
        yield pd.DataFrame({"engine": key[0], "id": ids[some], "at": at[some].astype("datetime64[ns]"), "hits": hits[some]}, columns=["engine", "id", "at", "hits"])
    if until is not None:
        state.update((pd.Timestamp(until),))
        state.setTimeoutTimestamp(max(until // 1_000_000, state.getCurrentWatermarkMs()) + 1)


def made_requests(requests: DataFrame) -> DataFrame:
    """The requests (engine, id, at, hits) that are made, for a stream in order of time: an engine that gave no hits isn't asked for REST_SECONDS, and what isn't asked doesn't prolong the rest.

    Engines rest apart, each with its own state, the end of its rest, which goes when that is over. Null hits count as none; requests without a time are left out.
    """
    rows = requests.select(F.col("engine").cast("string"), F.col("id").cast("long"), F.col("at").cast("timestamp"), F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"))
    rows = rows.where("at is not null").withWatermark("at", LATE)
    return rows.groupBy("engine").applyInPandasWithState(_rest, _ASKED, "until timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def _first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The earliest request of an address in its first batch; of each frame one row is kept."""
    if state.hasTimedOut:
        state.remove()
        return
    least = None
    for x in frames:
        if state.exists or x.empty:
            continue
        x = x if least is None else pd.concat([least, x], ignore_index=True)
        least = x.sort_values([c for c in ("at", "id") if c in x.columns], kind="stable").head(1)
    if least is not None:
        known = int(least["at"].iloc[0].timestamp() * 1000)
        state.update((known,))
        state.setTimeoutTimestamp(max(known + LATE_SECONDS * 1000, state.getCurrentWatermarkMs()) + 1)
        yield least


def first_requests(requests: DataFrame) -> DataFrame:
    """Of a stream of requests (run, url, at, ...) the first by time (then by id, if there is one) of each address of a run, whatever its case; later ones are served from it.

    Rows may stand in any order in a batch. State, the time of the first, goes with the watermark. Requests without a time are left out.
    """
    keyed = requests.where("at is not null").withWatermark("at", LATE).withColumn("key", F.lower(F.coalesce("url", F.lit(""))))
    return keyed.groupBy("run", "key").applyInPandasWithState(_first, keyed.schema, "known long", "append", GroupStateTimeout.EventTimeTimeout)


def served(requests: DataFrame, firsts: DataFrame) -> DataFrame:
    """requests (run, url, ...) each with the body that the run's first request of the address had. firsts: run, key, body; both tables or one a stream."""
    return requests.withColumn("key", F.lower(F.coalesce("url", F.lit("")))).join(firsts.select("run", "key", "body"), ["run", "key"], "left")
