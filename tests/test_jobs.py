"""The job from manifest to index: each video is decoded once and each frame encoded once, also over a stop and a restart."""

import colorsys
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.functions.encode import ByteStatsEncoder, hsv, hsv_change, unit_vectors
from reelquery.operators import store
from reelquery.plans import cli, jobs
from reelquery.sources import manifest as M


class Corpus:
    """Videos of a folder with a decoder and an encoder that note each call in a file, as they run in other processes."""

    def __init__(self, folder, videos):
        self.log = str(folder / "log")
        open(self.log, "w").close()
        for v in videos:
            (folder / f"{v}.mp4").write_bytes(b"x")
        (folder / "m.json").write_text(json.dumps({"database": {v: {"subset": "validation"} for v in [*videos, "nowhere"]}}))
        self.folder = str(folder)

    def decoder(self):
        log = self.log

        def decode(path):
            with open(log, "a") as f:
                f.write("d")
            if path.endswith("broken.mp4"):
                raise OSError("no video")
            for i in range(40):
                yield i, 5.0, bytes([(200 if i >= 20 else 10) + i % 3, 1, 2, 3])

        return decode

    def encoder(self):
        log = self.log

        class Counting(ByteStatsEncoder):
            def encode(self, frames):
                with open(log, "a") as f:
                    f.write("e" * len(frames))
                return super().encode(frames)

        return lambda: Counting(16)

    def calls(self):
        text = open(self.log).read()
        return text.count("d"), text.count("e")

    def run(self, spark, table, **more):
        return jobs.index_corpus(spark, table, f"{self.folder}/m.json", "validation", self.folder, M.LocalFetcher(), self.decoder(), self.encoder(), f"counting {self.log}", **more)


def fresh(spark, name):
    t = store.IndexTable(spark, name, 16, 4)
    t.delete()
    jobs.VideoStage(spark, name).delete()
    return t


def test_one_decode_a_video_one_encode_a_frame(spark, tmp_path):
    c, t = Corpus(tmp_path, ["a", "b", "c", "broken"]), fresh(spark, "once_index_test")
    assert c.run(spark, t, wave=2).count() == 0
    assert c.calls() == (4, 3 * 40)
    got = {}
    for r in t.read().collect():
        got.setdefault(r["video_id"], []).append(r["center_frame"])
    assert {v: sorted(x) for v, x in got.items()} == {v: [5, 10, 15, 25, 30, 35] for v in "abc"}
    # what was tried is not tried again; a video that comes later is
    c.run(spark, t)
    assert c.calls() == (4, 120)
    (tmp_path / "nowhere.mp4").write_bytes(b"x")
    c.run(spark, t)
    assert c.calls() == (5, 160) and t.indexed("nowhere")
    assert spark.table("once_index_test_frames").count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    c, t = Corpus(tmp_path, ["a", "b", "c"]), fresh(spark, "stopped_index_test")
    with monkeypatch.context() as m:
        m.setattr(store.IndexTable, "write", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            c.run(spark, t, wave=2)
    assert c.calls() == (2, 80) and t.read().count() == 0
    c.run(spark, t, wave=2)
    assert c.calls() == (3, 120) and t.read().select("video_id").distinct().count() == 3
    # a stop between the frames and the list of the wave: the frames are written over
    c2 = Corpus(tmp_path, ["a", "b", "c", "d"])
    with monkeypatch.context() as m:
        m.setattr(jobs.VideoStage, "read", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            c2.run(spark, t)
    c2.run(spark, t)
    assert t.read().filter("video_id = 'd'").count() == 6
    assert spark.table("stopped_index_test_frames").count() == 0


def test_command_line_from_a_manifest(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(bytes(range(256)) * 64)
    (tmp_path / "m.json").write_text(json.dumps({"database": {"v": {"subset": "validation"}}}))
    fresh(spark, "cli_manifest_test")
    out = cli.main(["index", "--manifest", str(tmp_path / "m.json"), "--directory", str(tmp_path), "--table", "cli_manifest_test", "--dims", "64"], spark)
    # 256 frames at 30 a second: centres 30, 60, ... 240
    assert out.count() == 8 and out.agg(F.max("norm")).first()[0] == pytest.approx(1.0, abs=1e-5)


def test_hsv_and_a_bad_frame():
    r = np.random.default_rng(0)
    p = r.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    p[0, 0] = 0
    p[0, 1] = 77
    for i in range(6):
        for j in range(5):
            b, g, red = (int(x) for x in p[i, j])
            h, s, v = colorsys.rgb_to_hsv(red / 255, g / 255, b / 255)
            want = np.array([h * 180, s * 255, v * 255])
            off = np.abs(hsv(p)[i, j] - want)
            assert min(off[0], 180 - off[0]) <= 0.51 and off[1] <= 0.51 and off[2] <= 1e-9
    assert hsv_change(p, p) == 0.0 and hsv_change(p, p[:3]) == 0.0
    black, white = np.zeros((4, 4, 3), np.uint8), np.full((4, 4, 3), 255, np.uint8)
    assert hsv_change(black, white) == pytest.approx(85.0)

    class Picky(ByteStatsEncoder):
        def encode(self, frames):
            if any(f == b"bad" for f in frames):
                raise ValueError
            return super().encode(frames)

    out = unit_vectors(Picky(8), [b"good", None, b"", b"bad", b"fine"])
    assert [v is not None for v in out] == [True, False, False, False, True]
