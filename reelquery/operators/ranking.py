"""From frame hits to ranked videos."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.operators.knn import best_per_video, knn_join

SCORE_DIGITS = 6


def best_hit_per_video(hits: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Of each query's hits at or above ``threshold``, the first in rank for every video."""
    w = Window.partitionBy("query_idx", "video_id").orderBy("hit_rank")
    return hits.filter(F.col("cosine") >= threshold).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def dedup_frames(best: DataFrame) -> DataFrame:
    """A frame counts once, for the earliest query that hit it."""
    w = Window.partitionBy("video_id", "center_frame").orderBy("query_idx")
    return best.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rank_videos(hits: DataFrame, n_queries: int, top_k: int = 10, threshold: float = 0.2, order_bonus: bool = False) -> DataFrame:
    """Sum of kept cosines over *all* queries, the optional order factor, and the ranking.

    Ties go to the earlier first query, then to the better first hit rank, then to video_id.
    """
    best = best_hit_per_video(hits, threshold)
    kept = dedup_frames(best)
    w = Window.partitionBy("video_id").orderBy("query_idx")
    agg = (
        kept.withColumn("_prev", F.lag("timestamp_sec").over(w))
        .groupBy("video_id")
        .agg((F.sum("cosine") / F.lit(float(n_queries))).alias("_base"), F.count(F.lit(1)).alias("_m"), F.count_if(F.col("_prev") <= F.col("timestamp_sec")).alias("_o"))
    )
    first = best.groupBy("video_id").agg(F.min(F.struct("query_idx", "hit_rank")).alias("_first"))
    factor = F.when(F.col("_m") >= 2, F.lit(0.7) + F.lit(0.3) * F.try_divide(F.col("_o").cast("double"), (F.col("_m") - 1).cast("double"))).otherwise(1.0)
    score = F.round(F.col("_base") * factor if order_bonus else F.col("_base"), SCORE_DIGITS)
    # one row per video is ranked, and only top_k of them: the limit comes before the unpartitioned row number
    top = agg.join(first, "video_id").withColumn("score", score).orderBy(F.desc("score"), "_first.query_idx", "_first.hit_rank", "video_id").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "_first.query_idx", "_first.hit_rank", "video_id"))
    return top.withColumn("rank", rank).select("rank", "video_id", "score")


def search_video(queries: DataFrame, index: DataFrame, top_k: int = 10, candidates_per_query: int = 50, threshold: float = 0.2, order_bonus: bool = False) -> DataFrame:
    """The flagship: queries ``(query_idx, embedding)`` against an index, as ``(rank, video_id, score)``.

    Zero-norm queries find nothing but still count in the denominator.  No query or no hit gives no row.
    """
    n = queries.count()
    return rank_videos(knn_join(queries, index, candidates_per_query), max(n, 1), top_k, threshold, order_bonus)


def chamfer_score(queries: DataFrame, index: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per video: the mean over queries of the best cosine, of those strictly above ``threshold``; 0 when none is."""
    best = best_per_video(queries, index)
    return best.groupBy("video_id").agg(F.coalesce(F.avg(F.when(F.round("cosine", 9) > threshold, F.col("cosine"))), F.lit(0.0)).alias("score"))


def chamfer_rank(queries: DataFrame, index: DataFrame, query_id: str | None = None, top_k: int = 10) -> DataFrame:
    """Videos by Chamfer score, the query's own excluded; zero scores stay; ties follow the stored file name."""
    if queries.limit(1).count() == 0:
        raise ValueError("the query video has no embeddings")
    rows = index if query_id is None else index.filter(F.col("video_id") != query_id)
    scored = chamfer_score(queries, rows).withColumn("score", F.round("score", SCORE_DIGITS))
    name = F.concat(F.col("video_id").cast("string"), F.lit(".json"))
    top = scored.orderBy(F.desc("score"), name).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), name))).select("rank", "video_id", "score")


def ranked_report(ranking: DataFrame, query_id: str | None = None) -> DataFrame:
    """The printed lines: rank, id, score to four places, and a mark on the query's own video."""
    mark = F.when(F.col("video_id") == F.lit(query_id), F.lit("← consulta")).otherwise(F.lit(""))
    return ranking.select("rank", "video_id", F.format_string("%.4f", F.col("score")).alias("score_text"), mark.alias("mark"))
