"""The hiring process as keyed state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from screenloom.dims.stages import TRANSITIONS

LOG_SCHEMA = (
    "candidate_id string, event_id bigint, ts timestamp, previous string, requested string, state string, "
    "success boolean, first boolean"
)
STATE_SCHEMA = "state string, waiting array<struct<ts:bigint,event_id:bigint,new_state:string,forced:boolean>>, logged boolean"


def transition_stream(events: DataFrame, start: str = "applied", delay: str | None = None) -> DataFrame:
    """Log of every stage change of a stream of (candidate_id, event_id, ts, new_state, forced).

    Without ``delay``, events are taken in time order within a micro-batch and in order of arrival across batches.
    With ``delay`` (such as "10 minutes") events wait until the watermark has passed them, so batches may overlap
    in time; the wait bounds the state of a candidate.
    """

    def advance(key, batches, state):
        from bisect import bisect_right

        import numpy as np
        import pandas as pd

        current, waiting, logged = state.get if state.exists else (start, [], False)
        # Plain lists: a candidate has few events, and a frame costs more than they do.
        events = [tuple(w) for w in waiting]
        for batch in batches:
            micros = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
            ids, names, forces = (batch[c].tolist() for c in ("event_id", "new_state", "forced"))
            events += [(t, int(i), n, bool(f)) for t, i, n, f in zip(micros, ids, names, forces, strict=True)]
        events.sort(key=lambda e: e[:2])
        ready = len(events)
        if delay is not None:
            ready = bisect_right(events, state.getCurrentWatermarkMs() * 1000, key=lambda e: e[0])
        rows, kept = events[:ready], events[ready:]
        after = [current]
        if rows:
            micros, ids, requested, forces = (list(c) for c in zip(*rows, strict=True))
            previous, after, success = walk(current, requested, forces)
        state.update((after[-1], kept, logged or ready > 0))
        if kept:
            state.setTimeoutTimestamp(max(kept[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(
                {
                    "candidate_id": [key[0]] * ready,
                    "event_id": np.array(ids, "int64"),
                    "ts": pd.to_datetime(np.array(micros, "int64"), unit="us"),
                    "previous": previous,
                    "requested": requested,
                    "state": after,
                    "success": success,
                    "first": [not logged] + [False] * (ready - 1),
                }
            )

    timeout = GroupStateTimeout.NoTimeout
    if delay is not None:
        events = events.withWatermark("ts", delay)
        timeout = GroupStateTimeout.EventTimeTimeout
    return events.groupBy("candidate_id").applyInPandasWithState(advance, LOG_SCHEMA, STATE_SCHEMA, "append", timeout)


def walk(current: str, requested: list[str], forced) -> tuple[list[str], list[str], list[bool]]:
    """Stages before and after each of a series of requests, and whether it was accepted.

    A request is a function from stage to stage, an array of results. Composing neighbours at doubling distances gives
    the stage after every request in log2(n) array steps, as the batch fold does over chunks.
    """
    import numpy as np

    names = sorted({*TRANSITIONS, *(x for following in TRANSITIONS.values() for x in following), *filter(None, requested), current})
    number = {name: i for i, name in enumerate(names)}
    n, none = len(requested), len(names)  # a missing request is a stage that none may enter
    allowed = np.zeros((len(names), len(names) + 1), bool)
    for name, following in TRANSITIONS.items():
        allowed[number[name], [number[f] for f in following]] = True
    to = np.array([number.get(r, none) for r in requested], np.int64)
    may = allowed[:, to].T | np.asarray(forced, bool)[:, None]
    maps = np.where(may & (to < none)[:, None], to[:, None], np.arange(len(names))[None, :])
    step = 1
    while step < n:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    after = maps[:, number[current]] if n else np.zeros(0, np.int64)
    before = np.concatenate([[number[current]], after[:-1]])[:n]
    success = may[np.arange(n), before]
    return [names[i] for i in before], [names[i] for i in after], success.tolist()


def promotion_stream(scheduled: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows (candidate_id, slot, state) as interviews pass: a stream of (candidate_id, ts, slot) whose slots become
    interviewed once the watermark on ``ts`` has reached them. An event-time timer wakes a candidate without new rows."""

    def advance(key, batches, state):
        import pandas as pd

        waiting = list(state.get[0]) if state.exists else []
        for batch in batches:
            waiting += batch["slot"].dropna().astype("datetime64[us]").astype("int64").tolist()
        limit = state.getCurrentWatermarkMs() * 1000
        passed, waiting = [w for w in waiting if w <= limit], sorted(w for w in waiting if w > limit)
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(-(-waiting[0] // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        slots = pd.to_datetime(pd.Series(sorted(passed), dtype="int64"), unit="us")
        yield pd.DataFrame({"candidate_id": [key[0]] * len(slots), "slot": slots, "state": ["interviewed"] * len(slots)})

    keyed = scheduled.withWatermark("ts", delay).groupBy("candidate_id")
    return keyed.applyInPandasWithState(
        advance, "candidate_id string, slot timestamp, state string", "waiting array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def funnel_changes(log: DataFrame, start: str = "applied") -> DataFrame:
    """Running number of candidates per stage, from a (streamed) transition log."""
    entered = F.when(F.col("first"), F.struct(F.lit(start).alias("stage"), F.lit(1).alias("delta")))
    left = F.struct(F.col("previous").alias("stage"), F.lit(-1).alias("delta"))
    joined = F.struct(F.col("state").alias("stage"), F.lit(1).alias("delta"))
    moves = log.select(F.inline(F.array_compact(F.array(entered, left, joined))))
    return moves.groupBy("stage").agg(F.sum("delta").alias("candidates"))


def daily_requests(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests per day and requested stage, with late events dropped after ``delay``."""
    day = F.window("ts", "1 day")
    counted = events.withWatermark("ts", delay).groupBy(day, "new_state").agg(F.count("*").alias("requests"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "new_state", "requests")
