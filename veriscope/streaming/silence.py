"""Silence of agents, raised when it has lasted long enough and not when the next event comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriscope import constants as K
from veriscope.session import ship_package

# times are microseconds since 1970 on their way through Python, so no session time zone touches them
_STRETCH = "agent_type string, first long, last long, events long"
_STATE = "starts array<long>, ends array<long>, events array<long>"


def merged(stretches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Stretches (first, last, events) in order, those less than `gap` apart made one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(stretches):
        if out and first < out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _reduced(gap: int):
    """Stretches of a task's own rows: a hot agent is reduced before its rows are shuffled."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[int, int, int]]] = {}
        for f in frames:
            for agent, times in f["t"].groupby(f["agent_type"]):
                t = times.sort_values().to_numpy()
                cut = [0, *((t[1:] - t[:-1] >= gap).nonzero()[0] + 1).tolist(), len(t)]
                found = [(int(t[a]), int(t[b - 1]), b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                held[agent] = merged(held.get(agent, []) + found, gap)
        yield pd.DataFrame([(a, *s) for a, stretches in held.items() for s in stretches], columns=["agent_type", "first", "last", "events"])

    return run


def _watch(gap: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                held += list(zip(f["first"].tolist(), f["last"].tolist(), f["events"].tolist(), strict=True))
        held = merged(held, gap)
        passed = state.getCurrentWatermarkMs() * 1000
        over = [s for s in held if s[1] + gap < passed]
        still = [s for s in held if s[1] + gap >= passed]
        if still:
            state.update(tuple(map(list, zip(*still, strict=True))))
            # the timer stands where the first of the open stretches has been silent for the whole gap
            state.setTimeoutTimestamp(max(min(s[1] for s in still) + gap, passed + 1000) // 1000)
        elif state.exists:
            state.remove()
        found = pd.DataFrame(over, columns=["first", "last", "events"]).astype("int64")
        yield found.assign(agent_type=key[0])[["agent_type", "first", "last", "events"]]

    return run


def silent_agents(
    events: DataFrame, time: str = "created_at", delay: str = "1 hour", minutes: int = K.TELEMETRY_GAP_MINUTES, agent: str = "agent_type",
) -> DataFrame:
    """A row (agent_type, first_seen, last_seen, silent_since, events) for each stretch of telemetry once its silence has lasted `minutes`.

    A timer per agent raises it as soon as the watermark (newest event time of all agents, less `delay`) has passed
    last_seen by that long, also if the agent never sends again. Events less than `minutes` apart are one stretch. What an agent keeps in state are its
    stretches within the delay. Rows without an agent or a time count nowhere; rows behind the watermark are late (see `lateness`).
    """
    ship_package(events.sparkSession)
    gap = minutes * 60_000_000
    told = events.select(F.col(agent).cast("string").alias("agent_type"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")).dropna()
    stretches = told.mapInPandas(_reduced(gap), _STRETCH).withColumn("at", F.timestamp_micros("last"))
    closed = stretches.withWatermark("at", delay).groupBy("agent_type").applyInPandasWithState(
        _watch(gap), _STRETCH, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return closed.select(
        "agent_type", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"),
        F.timestamp_micros(F.col("last") + gap).alias("silent_since"), "events",
    )
