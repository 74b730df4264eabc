"""Jobs for spark-submit: ``index`` pending videos, ``search`` by a video, ``list`` the videos of a folder.

    spark-submit reelquery/plans/cli.py index --frames FRAMES --fps 30 [--scenes SCENES]
    spark-submit reelquery/plans/cli.py index --manifest JSON --subset validation --directory DIR --decoder MODULE:NAME --encoder MODULE:NAME
    spark-submit reelquery/plans/cli.py search --frames FRAMES --video ID --fps 30 [--order-bonus]

With a manifest the job starts at the video files in DIR; the decoder takes a path and yields (frame_idx, fps, data), the encoder is a class
or function without arguments.  FRAMES is Parquet with (video_id, frame_idx, embedding[, fps]), SCENES with (video_id, scene_id, start_sec, end_sec).
"""

import argparse
import importlib

from pyspark.sql import SparkSession

from reelquery.operators.ranking import ranked_report
from reelquery.operators.store import IndexTable
from reelquery.plans.jobs import index_corpus, index_videos, search_by_video, setup_logger
from reelquery.sources.manifest import LocalFetcher, list_videos


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=["index", "search", "list"])
    p.add_argument("--frames")
    p.add_argument("--scenes")
    p.add_argument("--video")
    p.add_argument("--directory")
    p.add_argument("--manifest")
    p.add_argument("--subset", default="validation")
    p.add_argument("--decoder", default="reelquery.sources.frames:raw_decoder")
    p.add_argument("--encoder", default="reelquery.functions.encode:ByteStatsEncoder")
    p.add_argument("--limit", type=int, default=1000, help="first entries of the subset")
    p.add_argument("--wave", type=int, default=1000, help="videos decoded before they are indexed")
    p.add_argument("--fps", type=float, help="one rate for all; without it each row's own, or 30")
    p.add_argument("--table", default="video_index")
    p.add_argument("--dims", type=int, default=512)
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--order-bonus", action="store_true")
    return p


def named(path: str):
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


def main(args: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(args)
    log = setup_logger()
    spark = spark or SparkSession.builder.appName(f"reelquery-{a.job}").getOrCreate()
    if a.job == "list":
        return list_videos(spark, a.directory)
    table = IndexTable(spark, a.table, a.dims)
    if a.job == "index" and a.manifest:
        bad = index_corpus(spark, table, a.manifest, a.subset, a.directory, LocalFetcher(), named(a.decoder), named(a.encoder), a.encoder, limit=a.limit, wave=a.wave)
        log.info("rows that could not be indexed: %d", bad.count())
        return table.read()
    frames = spark.read.parquet(a.frames)
    if a.job == "index":
        bad = index_videos(table, frames, spark.read.parquet(a.scenes) if a.scenes else None, a.fps)
        log.info("rows that could not be indexed: %d", bad.count())
        return table.read()
    out = ranked_report(search_by_video(table, frames.filter(frames.video_id == a.video), a.fps, a.top_k, a.order_bonus), a.video)
    for r in out.orderBy("rank").collect():  # at most top-k rows
        print(f"{r['rank']:>3}. {r['video_id']}  score={r['score_text']}  {r['mark']}")
    return out


if __name__ == "__main__":
    main()
