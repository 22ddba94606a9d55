"""Structured Streaming: the greedy linker with its open tracks as state, running field summaries, track sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.planes import _COLUMNS, LINKED, GreedyLinker


def linked(detections: DataFrame, reach: float = 2.0, gap: int = 1) -> DataFrame:
    """Detections of a stream with their track, appended. State of an image: its open tracks only, evicted by the gap rule.
    Detections of a frame that is already done are late: they come out with track -1, so they can be counted."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, next_id, done = ([], 0, -1)
        if state.exists:
            saved, next_id, done = state.get
            tracks = [tuple(x) for x in json.loads(saved)]
        linker = GreedyLinker(reach, gap, tracks, next_id)
        pdf = pd.concat(list(parts)).sort_values(["frame", "object_id"])
        made = []
        for t, part in pdf.groupby("frame", sort=True):
            ids = linker.frame(int(t), part["y_um"].to_numpy(), part["x_um"].to_numpy()) if t > done else np.full(len(part), -1)
            done = max(done, int(t))
            made.append(part.assign(track_id=ids))
        state.update((json.dumps(linker.tracks), linker.next_id, done))
        yield pd.concat(made)[_COLUMNS]

    return detections.select(*_COLUMNS[:-1]).groupBy("img").applyInPandasWithState(run, LINKED, "tracks string, next_id long, done int", "append", GroupStateTimeout.NoTimeout)


def field_summaries(detections: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", value: str = "value", keys=("event_type",)) -> DataFrame:
    """Count, mean and extremes of each key and tumbling window, appended once the watermark passes its end."""
    w = detections.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.col("window.start").alias("start"), *keys, "n", "mean", "lo", "hi")


def sliding_means(detections: DataFrame, window: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", time: str = "ts", value: str = "value", keys=("event_type",)) -> DataFrame:
    w = detections.withWatermark(time, late).groupBy(F.window(time, window, step), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


def sessions(detections: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Lifetimes: runs of a track's detections without a gap."""
    w = detections.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Append-only sink of the long table; runs through what is there and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
