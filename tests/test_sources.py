"""Frames: pushed filters, file ranges; and streams that take effect once."""

import pytest
from pyspark.sql import functions as F

from reelquery.operators import store
from reelquery.sources import frames as FR
from reelquery.streaming import ingest

DECODER = """
import os
from reelquery.sources.frames import raw_decoder

def decode(path, first=0, end=None):
    for i, fps, data in raw_decoder(path, first, end):
        with open(os.path.join(os.path.dirname(path), "log"), "a") as f:
            f.write("x")
        yield i, fps, data
"""


@pytest.fixture
def videos(spark, tmp_path):
    for v in "abc":
        (tmp_path / f"{v}.mp4").write_bytes(v.encode() * 64 * 100)
    (tmp_path / "counting_decoder_test.py").write_text(DECODER)
    spark.sparkContext.addPyFile(str(tmp_path / "counting_decoder_test.py"))

    def decoded():
        path = tmp_path / "log"
        n = len(path.read_text()) if path.exists() else 0
        path.unlink(missing_ok=True)
        return n

    return str(tmp_path), decoded


def test_filters_choose_files_and_ranges(spark, videos):
    folder, decoded = videos
    read = lambda **o: FR.read_frames(spark, folder, decoder="counting_decoder_test:decode", counter="reelquery.sources.frames:raw_counter", **o)
    all_of = read(split=30)
    assert all_of.rdd.getNumPartitions() == 12 and all_of.count() == 300 and decoded() == 300
    for df, n, parts in [
        (read(split=30).filter("video_id = 'b' and frame_idx >= 40 and frame_idx < 75"), 35, 2),
        (read(split=30).filter("video_id in ('a', 'c') and frame_idx > 97"), 4, 2),
        (read(split=30).filter("frame_idx = 7"), 3, 3),
        (read(split=30).filter("frame_idx <= 3 and video_id = 'a' and video_id = 'b'"), 0, 1),
        (read(split=30, start_frame=10, end_frame=50).filter("frame_idx < 20"), 30, 3),
    ]:
        assert df.count() == n and decoded() == n
        assert df.rdd.getNumPartitions() <= parts
    # what cannot be pushed is still applied
    odd = read(split=30).filter("frame_idx % 2 = 1 and video_id = 'a' and fps > 1 and data is not null")
    assert odd.count() == 50 and decoded() == 100
    got = read(split=7).filter("video_id = 'c'").orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in got] == list(range(100)) and bytes(got[-1]["data"]) == b"c" * 64


def test_without_a_counter_a_file_is_a_partition(spark, videos):
    folder, decoded = videos
    df = FR.read_frames(spark, folder, decoder="counting_decoder_test:decode")
    assert df.rdd.getNumPartitions() == 3
    assert df.filter("frame_idx between 5 and 9").count() == 15 and decoded() == 15
    assert spark.read.format("frames").option("path", folder).load().filter("video_id = 'a'").count() == 100


def rows(spark, values):
    return spark.createDataFrame([(v, 1, s, [1.0, 2.0]) for v, s in values], "video_id string, center_frame int, timestamp_sec double, embedding array<double>")


def seen(table):
    return {r["video_id"]: r["timestamp_sec"] for r in table.read().collect()}


def test_a_batch_of_a_stream_takes_effect_once(spark, monkeypatch):
    t = store.IndexTable(spark, "ledger_index_test", 2, 4)
    t.delete()
    t.create()
    t.write(rows(spark, [("a", 1.0), ("b", 1.0)]), ("s", 0))
    t.write(rows(spark, [("a", 5.0)]))
    # a replay does not undo what came after it; nor does an earlier batch, but another stream has its own numbers
    t.write(rows(spark, [("a", 1.0), ("b", 1.0)]), ("s", 0))
    assert seen(t) == {"a": 5.0, "b": 1.0} and t.ledger() == {"s": 0}
    t.write(rows(spark, [("c", 2.0)]), ("other's stream", 0))
    # killed before the batch is shown: nothing of it is there, and the replay writes it
    with monkeypatch.context() as m:
        m.setattr(store.IndexTable, "_show", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.write(rows(spark, [("b", 9.0), ("d", 9.0)]), ("s", 1))
    assert seen(t) == {"a": 5.0, "b": 1.0, "c": 2.0} and t.ledger()["s"] == 0
    t.write(rows(spark, [("b", 9.0), ("d", 9.0)]), ("s", 1))
    assert seen(t) == {"a": 5.0, "b": 9.0, "c": 2.0, "d": 9.0}
    # killed after it is shown: the replay is left out
    with monkeypatch.context() as m:
        m.setattr(store.IndexTable, "_drop_old", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.write(rows(spark, [("d", 10.0)]), ("s", 2))
    t.write(rows(spark, [("d", 11.0)]), ("s", 2))
    assert seen(t)["d"] == 10.0
    # a batch without rows, or with bad ones only, counts too
    t.write(rows(spark, []), ("s", 3))
    assert t.ledger() == {"s": 3, "other's stream": 0}
    t.fit(cells=2)
    assert t.ledger()["s"] == 3
    t.delete()


def test_a_stream_restarted_from_an_old_checkpoint(spark, tmp_path):
    t = store.IndexTable(spark, "restart_index_test", 2, 4)
    t.delete()
    t.create()
    source = str(tmp_path / "in")
    rows(spark, [("a", 1.0), ("b", 1.0)]).coalesce(1).write.parquet(source)
    schema = rows(spark, []).schema
    ingest.upsert_stream(spark.readStream.schema(schema).parquet(source), t, str(tmp_path / "one"), name="s").awaitTermination()
    t.write(rows(spark, [("a", 7.0)]))
    ingest.upsert_stream(spark.readStream.schema(schema).parquet(source), t, str(tmp_path / "two"), name="s").awaitTermination()
    assert seen(t) == {"a": 7.0, "b": 1.0}
    t.delete()


def test_errors_are_counted_while_a_batch_is_evaluated(spark, tmp_path):
    t = store.IndexTable(spark, "counts_index_test", 2, 4)
    t.delete()
    t.create()
    log = str(tmp_path / "log")

    @F.udf("array<double>")
    def counted(v):
        with open(log, "a") as f:
            f.write("x")
        return v

    vectors = [[1.0, 2.0], None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [3.0, 0.0], [0.0, 0.0]]
    batch = spark.createDataFrame([("a", i, 0.0, v) for i, v in enumerate(vectors)], "video_id string, center_frame int, timestamp_sec double, embedding array<double>")
    bad = t.write(batch.withColumn("embedding", counted("embedding")))
    assert t.counts == {"rows": 7, "missing": 1, "dims": 1, "value": 1, "zero": 2}
    assert bad.count() == 5 and len(open(log).read()) == 7
    t.write(rows(spark, []))
    assert t.counts == {"rows": 0, "missing": 0, "dims": 0, "value": 0, "zero": 0}
    t.write(batch.filter("false"))
    assert t.counts["rows"] == 0
    batch.write.parquet(str(tmp_path / "in"))
    ingest.upsert_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), t, str(tmp_path / "c")).awaitTermination()
    assert t.counts["rows"] == 7
    t.delete()
