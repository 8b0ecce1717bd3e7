"""The stability gate: an observation counts only once it has been confirmed.

``step`` is the whole rule, one pure function of (state, observation). Batch
(``fold``) and streaming (``GateProcessor``) both fold it over the observations
of a camera in time order. Time is event time; rows that arrive after the
watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import truthy
from ..operators.ranking import RELAXED


class State(NamedTuple):
    """Current candidate, its count, when it was last seen, and the last accepted one with its time (seconds)."""

    key: str | None = None
    count: int = 0
    seen: float = float("-inf")
    accepted_key: str | None = None
    accepted_at: float = float("-inf")


def step(state: State, key: str | None, required: int, now: float, manual: bool = False, timeout: float = 8.0, cooldown: float = 12.0) -> tuple[State, bool, int]:
    """The next state, whether the observation is accepted, and its count.

    Manual scans pass and observations without a key are held; neither touches
    the state. A pause over ``timeout`` starts anew; within ``cooldown`` of its
    acceptance a key is held. Acceptance leaves the count as it is.
    """
    if manual:
        return state, True, 1
    if not key:
        return state, False, 0
    current, count = (None, 0) if now - state.seen > timeout else (state.key, state.count)
    count = count + 1 if key == current else 1
    state = State(key, count, now, state.accepted_key, state.accepted_at)
    if key == state.accepted_key and now - state.accepted_at < cooldown:
        return state, False, count
    if count >= required:
        return State(key, count, now, key, now), True, count
    return state, False, count


def stability_key(product_id: Column, name: Column, set_code: Column, number: Column) -> Column:
    """The identity of an observation: its product, else its name, set and number; null without a name."""
    low = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    pid = truthy(F.trim(product_id.cast("string")))
    named = F.concat(F.lit("name:"), low(name), F.lit("|set:"), low(set_code), F.lit("|num:"), low(number))
    return F.when(pid.isNotNull(), F.concat(F.lit("pid:"), pid)).when(low(name) != "", named)


def required_confirmations(fallback_reason: Column, review: Column) -> Column:
    relaxed = F.lower(F.trim(F.coalesce(fallback_reason, F.lit("")))) == RELAXED
    return F.when(relaxed | F.coalesce(review, F.lit(False)), 3).otherwise(2)


def runs(observations: DataFrame, camera: str, key: str, ts: str, tie: str, timeout: float, manual: str | None = None) -> DataFrame:
    """observations with ``run_position``: the count of the gate, by window functions alone.

    Rows without a key count 0 and manual ones 1; neither ends a run.
    """
    by_hand = F.coalesce(F.col(manual), F.lit(False)) if manual else F.lit(False)
    counts = truthy(F.col(key)).isNotNull() & ~by_hand
    w = Window.partitionBy(camera).orderBy(ts, tie)
    keyed = observations.where(counts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    new = F.coalesce((F.col(key) != F.lag(key).over(w)) | (gap > F.lit(int(timeout * 1_000_000))), F.lit(True))
    marked = keyed.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = marked.withColumn("run_position", F.row_number().over(Window.partitionBy(camera, "_run").orderBy(ts, tie))).drop("_run")
    return placed.unionByName(observations.where(~counts).withColumn("run_position", F.when(by_hand, 1).otherwise(0)))


def state_changes(observations: DataFrame, camera: str, state: str, order: list[str]) -> DataFrame:
    """The observations whose state isn't that of the one before."""
    before = F.lag(state).over(Window.partitionBy(camera).orderBy(*order))
    started = F.row_number().over(Window.partitionBy(camera).orderBy(*order)) == 1
    return observations.withColumns({"_before": before, "_started": started}).where(F.col("_started") & F.col(state).isNotNull() | ~F.col("_before").eqNullSafe(F.col(state))).drop("_before", "_started")


def every_nth(observations: DataFrame, camera: str, order: list[str], n: int, count: str = "up_count") -> DataFrame:
    """Every n-th observation of a camera, with its number."""
    number = F.row_number().over(Window.partitionBy(camera).orderBy(*order)).cast("bigint")
    return observations.withColumn(count, number).where(F.col(count) % n == 0)


def running_mean(observations: DataFrame, camera: str, value: str, order: list[str], mean: str = "mean") -> DataFrame:
    """observations with the mean of the values up to each."""
    w = Window.partitionBy(camera).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return observations.withColumn(mean, F.avg(value).over(w))


def _decide(frame: pd.DataFrame, state: State, timeout: float, cooldown: float) -> tuple[pd.DataFrame, State]:
    frame = frame.sort_values(["ts", "obs_id"], kind="stable")
    accepted, counts = [], []
    for key, required, ts, manual in zip(frame["key"], frame["required"], frame["ts"], frame["manual"], strict=True):
        state, ok, n = step(state, None if pd.isna(key) else key, int(required), pd.Timestamp(ts).value / 1e9, bool(manual), timeout, cooldown)
        accepted.append(ok)
        counts.append(n)
    return frame.assign(accepted=accepted, count=counts), state


_OUT = "obs_id long, camera string, ts timestamp, key string, accepted boolean, count int"


def fold(observations: DataFrame, timeout: float = 8.0, cooldown: float = 12.0) -> DataFrame:
    """Decisions on (obs_id, camera, ts, key, required, manual).

    After a pause between keyed observations that is longer than both timeout
    and cooldown nothing is left of the state, so a camera's history is cut
    there, and each stretch is a group of its own.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out, _ = _decide(frame, State(), timeout, cooldown)
        return out[["obs_id", "camera", "ts", "key", "accepted", "count"]]

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    keyed = truthy(F.col("key")).isNotNull() & ~F.coalesce(F.col("manual"), F.lit(False))
    w = Window.partitionBy("camera").orderBy("ts", "obs_id")
    before = F.last(F.when(keyed, at), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(keyed & (at - before > int(max(timeout, cooldown) * 1_000_000)), F.lit(False))
    cut = observations.withColumn("_new", new).withColumn("_stretch", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("camera", "_stretch").applyInPandas(run, _OUT)


class GateProcessor(StatefulProcessor):
    """``step`` under Structured Streaming, with the state of a camera kept between micro-batches."""

    def __init__(self, timeout: float = 8.0, cooldown: float = 12.0):
        self.timeout, self.cooldown = timeout, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "key string, count int, seen double, accepted_key string, accepted_at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = State(*self.state.get()) if self.state.exists() else State()
        frames = list(rows)
        if frames:
            out, state = _decide(pd.concat(frames, ignore_index=True), state, self.timeout, self.cooldown)
            self.state.update(tuple(state))
            yield out[["obs_id", "camera", "ts", "key", "accepted", "count"]]

    def close(self) -> None:
        pass


def gated(observations: DataFrame, timeout: float = 8.0, cooldown: float = 12.0, late: str = "30 seconds") -> DataFrame:
    """Streaming decisions on (obs_id, camera, ts, key, required, manual); needs the RocksDB state store."""
    return observations.withWatermark("ts", late).groupBy("camera").transformWithStateInPandas(GateProcessor(timeout, cooldown), _OUT, "Append", "None")


def first_seen_stream(observations: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the inventory check on a stream."""
    return observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def throttled(times: list[float], pause: float = 2.0) -> list[bool]:
    """Which scans start if each needs a pause since the last one that did."""
    out, last = [], float("-inf")
    for t in times:
        out.append(t - last > pause)
        last = t if out[-1] else last
    return out


def throttle(observations: DataFrame, pause: float = 2.0) -> DataFrame:
    """observations of (obs_id, camera, ts) that start a scan."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "obs_id"], kind="stable")
        keep = throttled([pd.Timestamp(t).value / 1e9 for t in frame["ts"]], pause)
        return frame.loc[keep, ["obs_id", "camera", "ts"]]

    return observations.select("obs_id", "camera", "ts").groupBy("camera").applyInPandas(run, "obs_id long, camera string, ts timestamp")
