"""Per-sample deadlines: best states, soft checkpoints, hard cap and tail stagnation, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_states(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` (with distance) with the best distance so far and whether the row is a new best."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.min("distance").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = F.min("distance").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("best", best).withColumn("promoted", before.isNull() | (F.col("distance") < before))


def step(state: dict | None, at: int, distance: int, soft: int, hard: int, tail: int) -> dict:
    """State after one observation: running, extended, restored (hard cap, best kept), failed or stagnated."""
    if state is None:
        return {"start": at, "deadline": at + soft, "best": distance, "first": distance, "mark": distance, "improved_at": at, "status": "running", "n": 1}
    if state["status"] not in ("running", "extended"):
        return state
    state = {**state, "n": state["n"] + 1}
    if at - state["start"] > hard:
        state["status"] = "restored" if state["best"] < state["first"] else "failed"
    elif at - state["improved_at"] > tail and state["best"] < state["first"]:
        state["status"] = "stagnated"
    elif at > state["deadline"]:
        if state["best"] < state["mark"]:
            state |= {"deadline": at + soft, "mark": state["best"], "status": "extended"}
        else:
            state["status"] = "failed"
    if state["status"] in ("running", "extended") and distance < state["best"]:
        state |= {"best": distance, "improved_at": at}
    return state


_RESULT = "status string, n long, best long, first long, deadline long"


def fold(rows: DataFrame, soft: int, hard: int, tail: int) -> DataFrame:
    """key, status, n, best, first, deadline after all observations (key, at, distance, event_id) of each key in order.

    A running sample has few observations; they are sorted within their key by Spark and folded in one Arrow pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in batches:
            out = []
            for k, at, distance in zip(frame["key"], frame["at"], frame["distance"]):
                if state is not None and k != key:
                    out.append((key, state["status"], state["n"], state["best"], state["first"], state["deadline"]))
                    state = None
                key, state = k, step(state, at, distance, soft, hard, tail)
            yield pd.DataFrame(out, columns=["key", "status", "n", "best", "first", "deadline"])
        if state is not None:
            yield pd.DataFrame([(key, state["status"], state["n"], state["best"], state["first"], state["deadline"])], columns=["key", "status", "n", "best", "first", "deadline"])

    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.filter("key IS NOT NULL").repartition("key").sortWithinPartitions("key", F.col("at").asc_nulls_last(), F.col("event_id").asc_nulls_last()).select("key", "at", "distance")
    return ordered.mapInPandas(run, f"key {kind}, {_RESULT}")


_STATE = "start long, deadline long, best long, first long, mark long, improved_at long, status string, n long"


_NAMES = [f.split()[0] for f in _STATE.split(", ")]
#: How long a sample that has ended is remembered, so that late observations don't begin it anew.
REMEMBERED_MS = 3_600_000


def observed(key: tuple, frames: Iterable[pd.DataFrame], state, soft: int, hard: int, tail: int) -> Iterator[pd.DataFrame]:
    """One key's turn in a stream: new observations, or the time at which its deadline passed without any."""
    now = dict(zip(_NAMES, state.get)) if state.exists else None
    if state.hasTimedOut:
        if now["status"] not in ("running", "extended"):
            state.remove()
            return
        # The deadline itself is what is observed: better than at the last mark extends, anything else ends the sample.
        now = {**step(now, now["deadline"] + 1, now["best"], soft, hard, tail), "n": now["n"]}
        at = now["deadline"] - soft
    else:
        frame = pd.concat(list(frames)).sort_values("at", kind="stable")
        for at, distance in zip(frame["at"].tolist(), frame["distance"].tolist()):
            now = step(now, at, distance, soft, hard, tail)
    state.update(tuple(now[n] for n in _NAMES))
    running = now["status"] in ("running", "extended")
    state.setTimeoutDuration(max(1, now["deadline"] - at + 1) * 1000 if running else REMEMBERED_MS)
    yield pd.DataFrame([(*key, now["status"], now["n"], now["best"], now["first"], now["deadline"])], columns=["key", "status", "n", "best", "first", "deadline"])


def stream(rows: DataFrame, soft: int, hard: int, tail: int) -> DataFrame:
    """The same fold over a stream of (key, at, distance; seconds): one row a key and micro-batch with its state so far.

    A sample whose deadline passes without an observation is ended (or extended) by the clock. State is a few numbers
    a sample and is dropped an hour after it has ended.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        return observed(key, frames, state, soft, hard, tail)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, {_RESULT}", _STATE, "update", "ProcessingTimeTimeout")
