"""A Python data source for frames with a pluggable decoder: ``spark.read.format("frames")``, or ``read_frames``.

Options: ``path`` (a local folder of video files) or ``files`` (a JSON list of paths), ``decoder`` and ``counter`` (``module:callable``), ``split``,
``start_frame``, ``end_frame``.  A decoder takes a path, a first frame and an end (exclusive, or None) and yields ``(frame_idx, fps, bytes)``; a
counter takes a path and gives the number of frames.  With a counter a file is cut into ranges of ``split`` frames, a partition each; without one a
file is a partition.

Filters on ``video_id`` (equal, in) choose files, those on ``frame_idx`` (equal, less, greater) cut the ranges, before anything is decoded.
"""

import importlib
import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

DEFAULT_FPS = 30.0
FRAME_BYTES = 64


def raw_decoder(path: str, first: int = 0, end: int | None = None, frame_bytes: int = FRAME_BYTES):
    """STAND-IN decoder: fixed-size byte blocks as frames.  It knows no video format."""
    with open(path, "rb") as f:
        f.seek(first * frame_bytes)
        i = first
        while (end is None or i < end) and (block := f.read(frame_bytes)):
            yield i, DEFAULT_FPS, block
            i += 1


def raw_counter(path: str) -> int:
    return -(-os.path.getsize(path) // FRAME_BYTES)


def _named(path: str):
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


class FrameRange(InputPartition):
    """Frames ``first`` to ``end`` (exclusive; None is the last) of a file."""

    def __init__(self, path: str, first: int, end: int | None):
        super().__init__((path, first, end))
        self.path, self.first, self.end = path, first, end


class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"]) if "files" in options else [os.path.join(options["path"], n) for n in sorted(os.listdir(options["path"])) if n.endswith(".mp4")]
        self.decoder = options.get("decoder", "reelquery.sources.frames:raw_decoder")
        self.counter = options.get("counter")
        self.split = int(options.get("split", 10_000))
        self.first = int(options.get("start_frame", 0))
        self.end = int(options["end_frame"]) if "end_frame" in options else None
        self.videos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        if column == ("video_id",) and isinstance(f, (EqualTo, In)):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.videos = named if self.videos is None else self.videos & named
            return True
        if column == ("frame_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value + (not isinstance(f, LessThan))
                self.end = end if self.end is None else min(self.end, end)
            return True
        return False

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files:
            if self.videos is not None and video_of(path) not in self.videos:
                continue
            end = self.end
            if self.counter:
                n = _named(self.counter)(path)
                end = n if end is None else min(n, end)
                out += [FrameRange(path, i, min(end, i + self.split)) for i in range(self.first, end, self.split)]
            elif end is None or self.first < end:
                out.append(FrameRange(path, self.first, end))
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        if partition is None:  # no file is left
            return
        for idx, fps, data in _named(self.decoder)(partition.path, partition.first, partition.end):
            yield video_of(partition.path), idx, float(fps or DEFAULT_FPS), data


def video_of(path: str) -> str:
    return os.path.basename(path).replace(".mp4", "")


class FramesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return "video_id string, frame_idx long, fps double, data binary"

    def reader(self, schema):
        return FramesReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers the source; filters reach it only with Spark's switch for them, which is set here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesDataSource)


def read_frames(spark: SparkSession, directory: str, **options) -> DataFrame:
    """Frames of the .mp4 files of a folder that Spark can list, in any of its file systems; a decoder gets local paths without their scheme.

    Names only are gathered on the driver, as for any file source.
    """
    from reelquery.sources.manifest import list_videos

    register(spark)
    files = [p[len("file:") :] if (p := r["path"]).startswith("file:") else p for r in list_videos(spark, directory).select("path").orderBy("path").collect()]
    return spark.read.format("frames").option("files", json.dumps(files)).options(**options).load()
