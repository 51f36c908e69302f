"""Intensities of an event stream, kept up to date per realization."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.hawkes import ExpParameters
from tidewire.session import ship

_OUT = "r bigint, node int, t double, intensity double, late boolean"
_STATE = "t double, left array<double>, after array<double>, top double, waiting_t array<double>, waiting_node array<int>"


def online_intensities(stream: DataFrame, p: ExpParameters, delay: float = 0.0, idle: str | None = None) -> DataFrame:
    """The intensity of every event's own node just before it: r, node, t, intensity, late.

    stream has r, node and t. An event waits until its realization has one that is later by
    delay, so events may come out of order by that much; then they go in the order of their
    times. State per realization is the last time, the decayed sums before and after it, and
    the events that wait. With idle, a duration as '30 seconds', a realization without new
    events for so long lets all that wait go. An event that comes when later ones have gone
    can't be placed any more: it is sent out too, with late set and no intensity, and adds
    nothing; late_events and late_counts are that side output. Nulls are dropped.
    """
    rates, w, mu, n = np.array(p.rates), p.weights(), p.mu, p.n_nodes
    pause = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def updated(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            t, left, after, top, times, nodes = state.get
            left, after = np.array(left).reshape(n, -1), np.array(after).reshape(n, -1)
        else:
            t, left, after, top, times, nodes = -np.inf, np.zeros((n, len(rates))), np.zeros((n, len(rates))), -np.inf, [], []
        came = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame({"t": [], "node": []})
        out = [(key[0], int(node), at, None, True) for node, at in zip(came["node"], came["t"], strict=True) if at < t]
        came = came[came["t"] >= t]
        times, nodes = [*times, *came["t"].tolist()], [*nodes, *came["node"].tolist()]
        top = max([top, *times])
        edge = np.inf if state.hasTimedOut else top - delay
        order = sorted(range(len(times)), key=lambda i: (times[i], nodes[i]))
        for i in order:
            at, node = times[i], int(nodes[i])
            if at > edge:
                continue
            if at > t:
                left = after * np.exp(-rates * (at - t)) if np.isfinite(t) else after.copy()
                after, t = left.copy(), at
            out.append((key[0], node, at, float(mu[node] + w[node] @ left.ravel()), False))
            after[node] += rates
        wait = [i for i in order if times[i] > edge]
        state.update((float(t), left.ravel().tolist(), after.ravel().tolist(), float(top), [float(times[i]) for i in wait], [int(nodes[i]) for i in wait]))
        if pause is not None and wait:
            state.setTimeoutDuration(pause)
        yield pd.DataFrame(out, columns=["r", "node", "t", "intensity", "late"])

    ship(stream.sparkSession)
    kept = stream.where("r is not null and node is not null and t is not null").select(F.col("r").cast("bigint").alias("r"), F.col("node").cast("int").alias("node"), F.col("t").cast("double").alias("t"))
    return kept.groupBy("r").applyInPandasWithState(updated, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout if pause is None else GroupStateTimeout.ProcessingTimeTimeout)


def late_events(intensities: DataFrame) -> DataFrame:
    """The events that came too late to be placed: r, node, t."""
    return intensities.where("late").select("r", "node", "t")


def late_counts(intensities: DataFrame) -> DataFrame:
    """Late events and all events per node, as running totals in complete or update mode."""
    return intensities.groupBy("node").agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, node: str, width: str, late: str) -> DataFrame:
    """Events per node and window of time, final once the watermark has passed: start, node, n.

    Timestamps without zone are taken as those of the session's zone."""
    t = stream.select(F.col(time).cast("timestamp").alias("_t"), F.col(node).alias("node")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width), "node").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "node", "n")
