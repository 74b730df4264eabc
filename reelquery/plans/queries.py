"""The registered queries over the test tables, and the same in SQL.

Stand-ins: an index is ``embeddings`` with label as video and vec_id as frame; the query video is label 0; frames are the
vectors of a label in vec_id order at 5 frames a second; scene scores are ``events.value`` per user.
"""

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelquery.functions import timing
from reelquery.functions import vector as V
from reelquery.operators import ann, knn, ranking, store, temporal
from reelquery.sources import manifest as M

FPS = 5.0
QUERY_LABEL = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("center_frame"), (F.col("vec_id") / F.lit(30.0)).alias("timestamp_sec"), "embedding")


def query_video(spark, d) -> DataFrame:
    q = table(spark, d, "embeddings").filter(F.col("label") == QUERY_LABEL)
    return q.select((F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("query_idx"), "embedding")


def frames(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("video_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame_idx"), "embedding")


def scenes(spark, d) -> DataFrame:
    """Six-second scenes for even labels, half-second scenes (too short) for odd ones."""
    f = frames(spark, d).groupBy("video_id").agg(F.max("frame_idx").alias("_n"))
    step = F.when(F.col("video_id").cast("int") % 2 == 0, F.lit(6.0)).otherwise(F.lit(0.5))
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") + 1) / F.lit(FPS) / step).cast("int"))).alias("scene_id")
    return f.select("video_id", step.alias("_s"), starts).select("video_id", "scene_id", (F.col("scene_id") * F.col("_s")).alias("start_sec"), ((F.col("scene_id") + 1) * F.col("_s")).alias("end_sec"))


def hits(spark, d) -> DataFrame:
    return knn.knn_join(query_video(spark, d), index(spark, d), 50)


def _exploded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("embedding").alias("d", "v")).select(*keys, F.col("d").cast("long").alias("d"), F.round("v", 6).alias("v"))


def _first_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def q_l2_norm(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.l2_norm(F.col("embedding")), 6).alias("norm"))


def q_normalize_safe(s, d):
    e = table(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return _exploded(e.withColumn("embedding", V.normalize(F.col("embedding"), zero="keep")), "vec_id")


def q_normalize_drop_zero(s, d):
    e = table(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return e.withColumn("embedding", V.normalize(F.col("embedding"))).filter(F.col("embedding").isNotNull()).select("vec_id", F.round(V.l2_norm(F.col("embedding")), 6).alias("norm"))


def q_cosine_pairs(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    return knn.cosine_pairs(e, other, "vec_id").select("vec_id", F.round("cosine", 6).alias("cosine"))


def q_score_transform(s, d):
    return hits(s, d).select("query_idx", "center_frame", F.round(V.score_of(F.col("cosine")), 6).alias("score"), F.round(V.cosine_of(V.score_of(F.col("cosine"))), 6).alias("cosine"))


def _hit(df):
    return df.select(F.round("score", 6).alias("score"), "video_id", "center_frame", F.round("timestamp_sec", 6).alias("timestamp_sec"))


def q_knn_topk(s, d):
    return _hit(knn.knn_topk(index(s, d), _first_vector(s, d), 10))


def q_knn_filtered(s, d):
    return _hit(knn.knn_topk(index(s, d), _first_vector(s, d), 10, video_id="3"))


def _hits_out(df):
    return df.select("query_idx", F.col("hit_rank").cast("int").alias("hit_rank"), "video_id", "center_frame", F.round("cosine", 6).alias("cosine"))


def q_knn_join(s, d):
    return _hits_out(hits(s, d))


def q_ivf_search(s, d):
    """The inverted file with every cell probed, which must be exact."""
    return _hits_out(ann.IvfIndex(index(s, d), cells=8).search(query_video(s, d), k=50, probes=8))


def _stored(s, d):
    """A stored index with cells: half of the rows before the codebook, half as an upsert after it."""
    t = store.IndexTable(s, f"stored_{uuid.uuid4().hex}", 64, buckets=4)
    t.create()
    atexit.register(_forget, t)
    rows = index(s, d)
    t.write(rows.filter("center_frame % 2 = 0"))
    t.fit(cells=16)
    t.write(rows.filter("center_frame % 3 <> 0 or center_frame % 2 <> 0"))
    return t


def _forget(t) -> None:
    try:
        t.delete()
    except Exception:  # the session has ended before
        pass


def q_index_exact(s, d):
    """The stored index, searched in no more cells than an exact answer needs."""
    return _hits_out(ann.search_exact(_stored(s, d), query_video(s, d), 50, probes=4))


def q_index_probed(s, d):
    """The stored index with the fewest probes that find 0.95 of the exact hits."""
    t, q = _stored(s, d), query_video(s, d)
    return _hits_out(ann.search(t, q, 50, ann.calibrate(t, q, 50, 0.95)))


def q_best_hit(s, d):
    return _hits_out(ranking.best_hit_per_video(hits(s, d)))


def q_dedup(s, d):
    return _hits_out(ranking.dedup_frames(ranking.best_hit_per_video(hits(s, d))))


def q_search_video(s, d):
    return ranking.search_video(query_video(s, d), index(s, d))


def q_search_bonus(s, d):
    return ranking.search_video(query_video(s, d), index(s, d), order_bonus=True)


def q_search_zero(s, d):
    q = query_video(s, d).withColumn("embedding", F.when(F.col("query_idx") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return ranking.search_video(q, index(s, d))


def q_chamfer_score(s, d):
    return ranking.chamfer_score(query_video(s, d), index(s, d)).select("video_id", F.round("score", 6).alias("score"))


def q_chamfer_rank(s, d):
    return ranking.chamfer_rank(query_video(s, d), index(s, d), query_id="0")


def q_ranked_report(s, d):
    return ranking.ranked_report(q_search_video(s, d), "0")


def q_fps_params(s, d):
    fps = F.round(F.col("value") / 3.0, 3)
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit(0.0)).otherwise(fps).alias("fps"))
    f = F.col("fps")
    radius = timing.radius_of(f)
    return e.select("event_id", timing.fps_or_default(f).alias("fps"), timing.interval_of(f).alias("interval"), radius.alias("radius"), (radius * 2 + 1).alias("win_size"))


def q_sync_indices(s, d):
    v = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total_frames"))
    return temporal.sync_indices(v.select(F.col("user_id").cast("string").alias("video_id"), (F.col("user_id") % 31).cast("double").alias("fps"), "total_frames"))


def q_clipped(s, d):
    w = temporal.clipped_windows(frames(s, d), 2)
    return w.select("video_id", "frame_idx", F.size("window").cast("long").alias("n_frames"), F.round(F.aggregate("window", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0))), 6).alias("first_sum"))


def _windows_out(w, *more):
    return w.select("video_id", *more, "center_frame", F.round("timestamp_sec", 6).alias("timestamp_sec"), F.size("window").cast("long").alias("n_frames"))


def q_keyframe_windows(s, d):
    return _windows_out(temporal.keyframe_windows(frames(s, d), ["video_id"], 0.5, FPS))


def q_mixed_fps(s, d):
    f = frames(s, d)
    n = F.col("video_id").cast("int") % 3
    return _windows_out(temporal.keyframe_windows(f.withColumn("fps", F.when(n == 0, 5.0).when(n == 1, 3.7).otherwise(0.0)), ["video_id"]))


def q_scene_segments(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("video_id"), "ts", "event_id", "value")
    seg = temporal.scene_segments(e, 200.0, order=("ts", "event_id"))
    return seg.groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


def q_scenes_of(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("video_id"), "ts", "event_id", "value")
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    scored = e.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.lit(FPS).alias("fps"), F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)).alias("score"))
    return temporal.scenes_of(scored, 100.0).select("video_id", "scene_id", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


def q_scene_min_length(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("video_id"), "ts", "event_id", "value")
    seg = temporal.scene_segments(e, 100.0, order=("ts", "event_id")).groupBy("video_id", "scene_id").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b"))
    sec = seg.select("video_id", "scene_id", (F.col("a") / 1e6).alias("start_sec"), (F.col("b") / 1e6).alias("end_sec"))
    return temporal.scene_min_length(sec, 1.0).select("video_id", "scene_id", F.round(F.col("end_sec") - F.col("start_sec"), 3).alias("seconds"))


def q_scene_windows(s, d):
    return _windows_out(temporal.scene_windows(frames(s, d), scenes(s, d), FPS), F.col("scene_id").cast("long").alias("scene_id"))


def q_fallback(s, d):
    return _windows_out(temporal.windows_with_fallback(frames(s, d), scenes(s, d), FPS))


def _pooled(method, unit=False):
    def run(s, d):
        w = temporal.keyframe_windows(frames(s, d), ["video_id"], 0.5, FPS)
        out = temporal.embed_windows(w, method) if unit else w.withColumn("embedding", V.pool(F.col("window"), method))
        return _exploded(out, "video_id", "center_frame")

    return run


def q_doc_id(s, d):
    return index(s, d).select(store.doc_id(F.col("video_id"), F.col("center_frame")).alias("doc_id"), "center_frame")


def q_upsert(s, d):
    base = index(s, d).select("video_id", "center_frame", "timestamp_sec")
    batch = base.withColumn("ord", F.lit(1)).unionByName(base.withColumn("ord", F.lit(2)).withColumn("timestamp_sec", F.col("timestamp_sec") + 1)).filter("center_frame % 2 = 0")
    return store.upsert(base, batch, ["video_id", "center_frame"], "ord").withColumn("timestamp_sec", F.round("timestamp_sec", 6))


def q_quarantine(s, d):
    e = index(s, d).withColumn("embedding", F.when(F.col("center_frame") % 7 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("center_frame") % 11 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return store.with_reason(e, 64).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_pending(s, d):
    return store.pending(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id")


def q_manifest_subset(s, d):
    m = table(s, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("video_id"), F.col("lang").alias("subset"))
    return M.manifest_subset(m, "en", 1000)


def q_json_extract(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def q_video_id(s, d):
    return table(s, d, "pages").select("page_id", M.video_id_of(F.col("url")).alias("video_id"))


def q_count_suffix(s, d):
    return table(s, d, "pages").agg(F.count_if(F.endswith("url", F.lit("1"))).alias("n"))


QUERIES = {
    "search_video": q_search_video, "search_video_order_bonus": q_search_bonus, "search_video_zero_query": q_search_zero, "chamfer_score": q_chamfer_score, "chamfer_rank": q_chamfer_rank,
    "ranked_report": q_ranked_report, "knn_topk": q_knn_topk, "knn_filtered": q_knn_filtered, "knn_join": q_knn_join, "ivf_search": q_ivf_search, "index_exact": q_index_exact, "index_probed": q_index_probed, "best_hit_per_video": q_best_hit, "dedup_frames": q_dedup,
    "l2_norm": q_l2_norm, "normalize_safe": q_normalize_safe, "normalize_drop_zero": q_normalize_drop_zero, "cosine_pairs": q_cosine_pairs, "score_transform": q_score_transform,
    "fps_params": q_fps_params, "sync_indices": q_sync_indices, "clipped_windows": q_clipped, "keyframe_windows": q_keyframe_windows, "keyframe_windows_mixed_fps": q_mixed_fps, "scene_segments": q_scene_segments, "scenes_of": q_scenes_of,
    "scene_min_length": q_scene_min_length, "scene_windows": q_scene_windows, "windows_with_fallback": q_fallback, "pool_mean": _pooled("mean"), "pool_max": _pooled("max"),
    "pool_center": _pooled("center"), "embed_windows": _pooled("mean", unit=True), "doc_id": q_doc_id, "upsert_last_wins": q_upsert, "quarantine_counts": q_quarantine,
    "pending_videos": q_pending, "manifest_subset": q_manifest_subset, "json_extract": q_json_extract, "video_id_from_path": q_video_id, "count_suffix": q_count_suffix,
}

_VEC = """
vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
idx AS (SELECT label::VARCHAR AS video_id, vec_id AS center_frame, vec_id / 30.0::DOUBLE AS timestamp_sec, v, sqrt(list_inner_product(v, v)) AS n FROM vec),
qry AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query_idx, v, sqrt(list_inner_product(v, v)) AS n FROM vec WHERE label = 0)"""


def _hits_sql(queries: str = "qry") -> str:
    return f"""{_VEC},
pairs AS (SELECT query_idx, video_id, center_frame, timestamp_sec, round(list_inner_product(q.v, i.v) / (q.n * i.n), 9) AS cosine FROM {queries} q, idx i WHERE q.n > 0 AND i.n > 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY cosine DESC, video_id, center_frame) AS hit_rank FROM pairs) WHERE hit_rank <= 50),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx, video_id ORDER BY hit_rank) AS r FROM hits WHERE cosine >= 0.2) WHERE r = 1),
kept AS (SELECT * FROM (SELECT * EXCLUDE r, row_number() OVER (PARTITION BY video_id, center_frame ORDER BY query_idx) AS r FROM best) WHERE r = 1)"""


def _search_sql(bonus: bool, queries: str = "qry", extra: str = "") -> str:
    factor = "CASE WHEN m >= 2 THEN 0.7::DOUBLE + 0.3::DOUBLE * o / (m - 1) ELSE 1.0::DOUBLE END" if bonus else "1.0::DOUBLE"
    return f"""WITH {_VEC.strip()}{extra}, {_hits_sql(queries)[len(_VEC):].strip().lstrip(',')},
lagged AS (SELECT *, lag(timestamp_sec) OVER (PARTITION BY video_id ORDER BY query_idx) AS prev FROM kept),
agg AS (SELECT video_id, sum(cosine) / (SELECT count(*) FROM {queries}) AS base, count(*) AS m, count(*) FILTER (WHERE prev <= timestamp_sec) AS o FROM lagged GROUP BY 1),
firsts AS (SELECT video_id, min(struct_pack(query_idx := query_idx, hit_rank := hit_rank)) AS f FROM best GROUP BY 1),
scored AS (SELECT video_id, round(base * {factor}, 6) AS score, f FROM agg JOIN firsts USING (video_id)),
ranked AS (SELECT row_number() OVER (ORDER BY score DESC, f.query_idx, f.hit_rank, video_id)::INTEGER AS rank, video_id, score FROM scored)"""


_ZEROED = "SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN vec_id % 7 = 0 THEN 0 ELSE x END::DOUBLE) AS v FROM embeddings"
_FRAMES = "frames AS (SELECT label::VARCHAR AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_SCENES = """scenes AS (SELECT video_id, scene_id, scene_id * s AS start_sec, (scene_id + 1) * s AS end_sec FROM (
  SELECT video_id, s, unnest(range(0, floor((n + 1) / 5.0::DOUBLE / s)::BIGINT + 1)) AS scene_id FROM (
    SELECT video_id, max(frame_idx) AS n, CASE WHEN video_id::INT % 2 = 0 THEN 6.0::DOUBLE ELSE 0.5::DOUBLE END AS s FROM frames GROUP BY 1)))"""


def _windows_sql(source: str, keys: str, name: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
    return f"""{name} AS (SELECT * FROM (SELECT {keys}, frame_idx AS center_frame, frame_idx / 5.0::DOUBLE AS timestamp_sec, list(v) OVER ({w}) AS win, count(*) OVER ({w}) AS n_frames,
  min(frame_idx) OVER (PARTITION BY {keys}) AS f0 FROM {source}) WHERE n_frames = 5 AND (center_frame - f0) % 5 = 0)"""


_INSIDE = f"{_FRAMES}, {_SCENES}, inside AS (SELECT f.video_id, scene_id, frame_idx, v FROM frames f JOIN scenes s ON f.video_id = s.video_id AND s.end_sec - s.start_sec >= 1.0 AND frame_idx >= trunc(start_sec * 5.0)::BIGINT AND frame_idx < trunc(end_sec * 5.0)::BIGINT)"
_WIN = f"{_FRAMES}, {_windows_sql('frames', 'video_id', 'win')}"
_POOL = {
    "mean": "list_transform(range(1, 65), lambda i: list_sum(list_transform(win, lambda w: w[i])) / len(win))",
    "max": "list_transform(range(1, 65), lambda i: list_max(list_transform(win, lambda w: w[i])))",
    "center": "win[len(win) // 2 + 1]",
}


def _pool_sql(method: str, unit: bool = False) -> str:
    v = "list_transform(p, lambda x: x / sqrt(list_inner_product(p, p)))" if unit else "p"
    return f"WITH {_WIN}, pooled AS (SELECT video_id, center_frame, {_POOL[method]} AS p FROM win), o AS (SELECT video_id, center_frame, {v} AS p FROM pooled) SELECT video_id, center_frame, d - 1 AS d, round(p[d], 6) AS v FROM o, range(1, 65) t(d)"


_HIT_OUT = "query_idx, hit_rank::INTEGER AS hit_rank, video_id, center_frame, round(cosine, 6) AS cosine"
_SCENE_CUT = "PARTITION BY user_id ORDER BY ts, event_id"


def _scene_sql(threshold: float) -> str:
    return f"""seg AS (SELECT *, sum(cut) OVER ({_SCENE_CUT} ROWS UNBOUNDED PRECEDING)::BIGINT AS scene_id FROM (
  SELECT user_id, ts, event_id, value, CASE WHEN abs(value - lag(value) OVER ({_SCENE_CUT})) >= {threshold} THEN 1 ELSE 0 END AS cut FROM events))"""


def _topk_sql(where: str) -> str:
    return f"""WITH {_VEC}, q AS (SELECT v, sqrt(list_inner_product(v, v)) AS n FROM vec WHERE vec_id = 0)
SELECT round((1 + c) / 2, 6) AS score, video_id, center_frame, round(timestamp_sec, 6) AS timestamp_sec FROM (SELECT idx.*, round(list_inner_product(idx.v, q.v) / (idx.n * q.n), 9) AS c FROM idx, q {where}) ORDER BY c DESC, video_id, center_frame LIMIT 10"""


_CHAMFER = f"""WITH {_VEC}, mx AS (SELECT video_id, query_idx, max(list_inner_product(q.v, i.v) / (q.n * i.n)) AS mx FROM qry q, idx i GROUP BY 1, 2),
scored AS (SELECT video_id, round(coalesce(avg(mx) FILTER (WHERE round(mx, 9) > 0.2), 0), 6) AS score FROM mx GROUP BY 1)"""

ORACLE = {
    "search_video": _search_sql(False) + " SELECT * FROM ranked WHERE rank <= 10",
    "search_video_order_bonus": _search_sql(True) + " SELECT * FROM ranked WHERE rank <= 10",
    "search_video_zero_query": _search_sql(False, "zq", ", zq AS (SELECT query_idx, v, CASE WHEN query_idx % 5 = 0 THEN 0 ELSE n END AS n FROM qry)") + " SELECT * FROM ranked WHERE rank <= 10",
    "ranked_report": _search_sql(False) + " SELECT rank, video_id, printf('%.4f', score) AS score_text, CASE WHEN video_id = '0' THEN '← consulta' ELSE '' END AS mark FROM ranked WHERE rank <= 10",
    "chamfer_score": _CHAMFER + " SELECT * FROM scored",
    "chamfer_rank": _CHAMFER + " SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, video_id || '.json')::INTEGER AS rank, * FROM scored WHERE video_id <> '0') WHERE rank <= 10",
    "knn_topk": _topk_sql(""),
    "knn_filtered": _topk_sql("WHERE video_id = '3'"),
    "ivf_search": f"WITH {_hits_sql()} SELECT {_HIT_OUT} FROM hits",
    "index_exact": f"WITH {_hits_sql()} SELECT {_HIT_OUT} FROM hits",
    "knn_join": f"WITH {_hits_sql()} SELECT {_HIT_OUT} FROM hits",
    "best_hit_per_video": f"WITH {_hits_sql()} SELECT {_HIT_OUT} FROM best",
    "dedup_frames": f"WITH {_hits_sql()} SELECT {_HIT_OUT} FROM kept",
    "score_transform": f"WITH {_hits_sql()} SELECT query_idx, center_frame, round((1 + cosine) / 2, 6) AS score, round(cosine, 6) AS cosine FROM hits",
    "l2_norm": f"WITH {_VEC} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vec",
    "normalize_safe": f"WITH z AS ({_ZEROED}), u AS (SELECT vec_id, v, coalesce(nullif(sqrt(list_inner_product(v, v)), 0), 1) AS n FROM z) SELECT vec_id, d - 1 AS d, round(v[d] / n, 6) AS v FROM u, range(1, 65) t(d)",
    "normalize_drop_zero": f"WITH z AS ({_ZEROED}), u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM z) SELECT vec_id, round(n / n, 6) AS norm FROM u WHERE n > 0",
    "cosine_pairs": f"WITH {_VEC} SELECT a.vec_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS cosine FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1",
    "fps_params": "WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.0::DOUBLE ELSE round(value / 3.0::DOUBLE, 3) END AS f FROM events), g AS (SELECT event_id, coalesce(nullif(f, 0), 30.0::DOUBLE) AS fps FROM e), h AS (SELECT *, greatest(1, trunc(fps)::BIGINT) AS interval, greatest(1, trunc(fps * 0.5::DOUBLE)::BIGINT) AS radius FROM g) SELECT event_id, fps, interval, radius, radius * 2 + 1 AS win_size FROM h",
    "sync_indices": "WITH v AS (SELECT user_id::VARCHAR AS video_id, coalesce(nullif(user_id % 31, 0), 30) AS step, count(*) AS n FROM events GROUP BY 1, 2) SELECT video_id, unnest(range(0, n, step)) AS frame_idx FROM v",
    "clipped_windows": f"WITH {_FRAMES} SELECT video_id, frame_idx, count(*) OVER w AS n_frames, round(sum(v[1]) OVER w, 6) AS first_sum FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "keyframe_windows_mixed_fps": f"""WITH {_FRAMES},
r AS (SELECT *, CASE video_id::INT % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 3.7::DOUBLE ELSE 30.0::DOUBLE END AS rate, min(frame_idx) OVER (PARTITION BY video_id) AS f0 FROM frames)
SELECT c.video_id, c.frame_idx AS center_frame, round(c.frame_idx / c.rate, 6) AS timestamp_sec, count(*) AS n_frames
FROM r c JOIN r o ON c.video_id = o.video_id AND abs(o.frame_idx - c.frame_idx) <= trunc(c.rate * 0.5::DOUBLE)::BIGINT
WHERE (c.frame_idx - c.f0) % trunc(c.rate)::BIGINT = 0 GROUP BY ALL HAVING count(*) = 2 * trunc(any_value(c.rate) * 0.5::DOUBLE)::BIGINT + 1""",
    "scenes_of": """WITH RECURSIVE s AS (SELECT user_id::VARCHAR AS video_id, row_number() OVER w - 1 AS frame_idx, coalesce(abs(value - lag(value) OVER w), 0) AS score FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
starts AS (SELECT video_id, min(frame_idx) AS f FROM s GROUP BY 1 UNION ALL SELECT t.video_id, min(s.frame_idx) FROM starts t JOIN s ON s.video_id = t.video_id AND s.score >= 100 AND s.frame_idx >= t.f + 15 GROUP BY 1),
scenes AS (SELECT video_id, row_number() OVER w - 1 AS scene_id, f, coalesce(lead(f) OVER w, (SELECT max(frame_idx) + 1 FROM s WHERE s.video_id = starts.video_id)) AS e, count(*) OVER (PARTITION BY video_id) AS n FROM starts WINDOW w AS (PARTITION BY video_id ORDER BY f))
SELECT video_id, scene_id, round(f / 5.0::DOUBLE, 6) AS start_sec, round(e / 5.0::DOUBLE, 6) AS end_sec FROM scenes WHERE n > 1""",
    "keyframe_windows": f"WITH {_WIN} SELECT video_id, center_frame, round(timestamp_sec, 6) AS timestamp_sec, n_frames FROM win",
    "scene_segments": f"WITH {_scene_sql(200)} SELECT user_id AS video_id, scene_id, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM seg GROUP BY 1, 2",
    "scene_min_length": f"WITH {_scene_sql(100)}, b AS (SELECT user_id AS video_id, scene_id, epoch_us(min(ts)) / 1e6 AS a, epoch_us(max(ts)) / 1e6 AS b FROM seg GROUP BY 1, 2) SELECT video_id, scene_id, round(b - a, 3) AS seconds FROM b WHERE b - a >= 1.0",
    "scene_windows": f"WITH {_INSIDE}, {_windows_sql('inside', 'video_id, scene_id', 'win')} SELECT video_id, scene_id, center_frame, round(timestamp_sec, 6) AS timestamp_sec, n_frames FROM win",
    "windows_with_fallback": f"WITH {_INSIDE}, {_windows_sql('inside', 'video_id, scene_id', 'win')}, rest AS (SELECT * FROM frames WHERE video_id NOT IN (SELECT video_id FROM win)), {_windows_sql('rest', 'video_id', 'whole')}, u AS (SELECT video_id, center_frame, timestamp_sec, n_frames FROM win UNION ALL SELECT video_id, center_frame, timestamp_sec, n_frames FROM whole) SELECT video_id, center_frame, round(timestamp_sec, 6) AS timestamp_sec, n_frames FROM u",
    "pool_mean": _pool_sql("mean"), "pool_max": _pool_sql("max"), "pool_center": _pool_sql("center"), "embed_windows": _pool_sql("mean", unit=True),
    "doc_id": "SELECT label || '_' || vec_id AS doc_id, vec_id AS center_frame FROM embeddings",
    "upsert_last_wins": "SELECT label::VARCHAR AS video_id, vec_id AS center_frame, round(vec_id / 30.0::DOUBLE + CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END, 6) AS timestamp_sec FROM embeddings",
    "quarantine_counts": "SELECT CASE WHEN vec_id % 7 = 0 THEN 'zero' WHEN vec_id % 11 = 0 THEN 'dims' ELSE 'ok' END AS reason, count(*) AS n FROM embeddings GROUP BY 1",
    "pending_videos": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "manifest_subset": "SELECT doc_id AS ord, doc_id::VARCHAR AS video_id, lang AS subset FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 1000",
    "json_extract": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "video_id_from_path": "SELECT page_id, replace(string_split(url, '/')[-1], '.mp4', '') AS video_id FROM pages",
    "count_suffix": "SELECT count(*) FILTER (WHERE ends_with(url, '1')) AS n FROM pages",
}
