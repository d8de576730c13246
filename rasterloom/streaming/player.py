"""Frames as a stream: windows over event time with late data, and the screen of each video as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WRITTEN = "video string, frame int, n_written int, n_changed int"


def windowed(events: DataFrame, length: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Counts and sums by event type in tumbling windows; events later than the watermark are dropped by the stream."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Screen(StatefulProcessor):
    """State: the last block written to each cell. Emits, for each frame, how many cells were written and how many changed.

    Frames of one micro-batch are replayed in order; a frame before the last one replayed is late and is passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "idx int", "color int")
        self.last = handle.getValueState("last", "frame int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        last = self.last.get()[0] if self.last.exists() else -1
        out = []
        for frame, writes in batch.sort_values(["frame", "idx"]).groupby("frame"):
            if frame <= last:
                continue
            changed = 0
            for idx, color in zip(writes["idx"].tolist(), writes["color"].tolist(), strict=True):
                before = self.cells.getValue((idx,))[0] if self.cells.containsKey((idx,)) else None
                if before != color:
                    changed += 1
                    self.cells.updateValue((idx,), (color,))
            last = int(frame)
            out.append((key[0], last, len(writes), changed))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["video", "frame", "n_written", "n_changed"])

    def close(self) -> None:
        pass


def played(writes: DataFrame) -> DataFrame:
    """A stream of (video, frame, idx, color) writes to one row a frame."""
    return writes.groupBy("video").transformWithStateInPandas(Screen(), WRITTEN, "Append", "None")
