"""Activity markers on a stream: the batch operator's, sample by sample, with state for each series.

A sample is settled once the watermark has passed it, in the order of time
and tie, so that the result doesn't depend on how the stream is cut into
batches.  State of a series: the samples that are waiting, those settled in
the last seven days, and what the cooldown, the last drop and an open run of
zeros need.  A timer wakes a series when the watermark passes its samples.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import timeseries
from ..operators.timeseries import COOLDOWN, DAY, HOUR, JUMP, SHARE, WINDOW

#: Zeros that have gone on for so long are real ones.
WAIT = 30 * DAY
_SAMPLE = "at long, tie long, players double"
#: began: whether the first sample is out; marked, drop_at, drop_players: the last marker and drop; before, before_players: the last sample above zero.
_STATE = "began boolean, marked long, drop_at long, drop_players double, before long, before_players double"


class Markers(StatefulProcessor):
    """Rows of a series in, markers out: item, at (microseconds), players, marker, gap."""

    def __init__(self, gap: int = 2 * HOUR, wait: int = WAIT):
        self.gap, self.wait = gap, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.week = handle.getListState("waiting", _SAMPLE), handle.getListState("week", _SAMPLE)
        self.zeros, self.now = handle.getListState("zeros", _SAMPLE), handle.getValueState("now", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for frame in rows for r in frame[["at", "tie", "players"]].itertuples(index=False)]
        self.waiting.appendList([(int(at), int(tie), float(players)) for at, tie, players in new])
        for millis in {int(at) // 1000 + 1 for at, *_ in new}:
            self.handle.registerTimer(millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        every = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [s for s in every if s[0] < until], [s for s in every if s[0] >= until]
        self._put(self.waiting, rest)
        zeros, out = [tuple(r) for r in self.zeros.get()], []
        state = list(self.now.get()) if self.now.exists() else [False, None, None, None, None, None]
        week = [tuple(r) for r in self.week.get()]
        for at, tie, players in ready:
            if players == 0:
                zeros.append((at, tie, players))
                if not self._may_be_blip(zeros, state):
                    out += self._settled(zeros, state, week)
                    zeros = []
                continue
            if zeros:
                blip = at - zeros[-1][0] <= self.gap and players > 0
                out += [] if blip else self._settled(zeros, state, week)
                zeros = []
            out += self._settled([(at, tie, players)], state, week)
            state[4], state[5] = at, players
        if zeros and until - zeros[-1][0] > self.wait:
            out += self._settled(zeros, state, week)
            zeros = []
        elif zeros:
            self.handle.registerTimer((zeros[-1][0] + self.wait) // 1000 + 2)
        self._put(self.zeros, zeros)
        self._put(self.week, week)
        self.now.update(tuple(state))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["item", "at", "players", "marker", "gap"])

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _may_be_blip(self, zeros: list[tuple], state: list) -> bool:
        """Whether a run of zeros has a sample above zero close before it; then it waits for what follows."""
        return state[4] is not None and zeros[0][0] - state[4] <= self.gap and state[5] > 0

    @staticmethod
    def _settled(samples: list[tuple], state: list, week: list[tuple]) -> list[tuple]:
        """The markers that these samples, in order behind all settled ones, give."""
        out = []
        for at, tie, players in samples:
            if not state[0]:
                out.append((at, players, "first_tracked", None))
                state[0] = True
            del week[: bisect.bisect_left(week, (at - WINDOW,))]
            prior = [p for t, _, p in week if t < at]
            bisect.insort(week, (at, tie, players))
            base = float(median(prior)) if len(prior) >= 2 else 0.0
            if base <= 0:
                continue
            diff = players - base
            if state[1] is None or at - state[1] >= COOLDOWN:
                if abs(diff) >= JUMP and abs(diff) / base >= SHARE:
                    out.append((at, players, "major_surge" if diff > 0 else "major_drop", abs(diff)))
                    state[1] = at
                    if diff < 0:
                        state[2], state[3] = at, players
                    continue
                risen = None if state[2] is None or at <= state[2] else players - state[3]
                if risen is not None and risen >= JUMP and state[3] > 0 and risen / state[3] >= SHARE:
                    out.append((at, players, "rebound", risen))
                    state[1], state[2], state[3] = at, None, None
            if state[2] is not None and at - state[2] > WINDOW:
                state[2], state[3] = None, None
        return out


def markers(samples: DataFrame, late: str = "2 hours", item: str = "item", ts: str = "sampled_at", value: str = "players", tie: str = "sample_id", wait: int = WAIT) -> DataFrame:
    """item, at, players, marker, label, detail of a stream of samples: what ``timeseries.markers`` gives for all of them together.

    Samples later than ``late`` behind the newest one don't count, and null
    times or values are no samples.  A run of zeros that may be a blip is held
    back until a sample above zero follows; if none does for ``wait``
    microseconds, the zeros are real.  Samples are settled when the watermark
    has passed them, so the last ones of a stream wait for newer ones.  Needs
    the RocksDB state store.
    """
    kind = samples.schema[item].dataType.simpleString()
    narrow = samples.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(F.col(item).alias("item"), F.col(ts).cast("timestamp").alias("seen"), timeseries.micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("players"))
    found = narrow.withWatermark("seen", late).groupBy("item").transformWithStateInPandas(Markers(wait=wait), f"item {kind}, at long, players double, marker string, gap double", "Append", "EventTime")
    return timeseries.described(found).select(F.col("item").alias(item), F.timestamp_micros("at").alias("at"), "players", "marker", "label", "detail")
