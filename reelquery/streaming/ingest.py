"""Streams: micro-batch upsert into the index, and the centred ring buffer as a stateful operator."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelquery.operators.store import IndexTable
from reelquery.operators.temporal import rate_of


def upsert_stream(stream: DataFrame, table: IndexTable, checkpoint: str, name: str | None = None, **trigger):
    """Upserts every micro-batch exactly once.

    The table notes the batch of the stream ``name`` (its checkpoint, if not given) in the step that shows the rows: a batch that is replayed after a
    crash is written if it had not taken effect, and left out if it had, even when other writers have changed its keys since.
    """
    own = name or checkpoint
    return stream.writeStream.foreachBatch(lambda batch, n: table.write(batch, (own, n)) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


WINDOW = "video_id string, center_frame long, timestamp_sec double, window array<binary>"
STATE = "first long, idx array<long>, frames array<binary>"


def ring_buffer_windows(frames: DataFrame, fps: float | None = None, k_seconds: float = 0.5) -> DataFrame:
    """Centred windows of a frame stream ``(video_id, frame_idx, data[, fps])``; state is the last 2k+1 frames of a video.

    The rate is ``fps``, or else each video's own (that of the first frame of a batch).  Frames of one video must arrive in order
    across batches; inside a batch they are sorted.
    """
    rows = frames.withColumn("fps", rate_of(frames, fps))

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, idx, buf = state.get if state.exists else (None, [], [])
        idx, buf, out = list(idx), list(buf), []
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        rate = float(rows["fps"].iloc[0])
        step, radius = max(1, int(rate)), max(1, int(rate * k_seconds))
        size = 2 * radius + 1
        for i, data in zip(rows["frame_idx"], rows["data"], strict=True):
            first = int(i) if first is None else first
            idx, buf = [*idx, int(i)][-size:], [*buf, data][-size:]
            centre = int(i) - radius
            if len(buf) == size and (centre - first) % step == 0:
                out.append((key[0], centre, centre / rate, list(buf)))
        state.update((first, idx, buf))
        yield pd.DataFrame(out, columns=["video_id", "center_frame", "timestamp_sec", "window"])

    return rows.groupBy("video_id").applyInPandasWithState(advance, WINDOW, STATE, "append", GroupStateTimeout.NoTimeout)
