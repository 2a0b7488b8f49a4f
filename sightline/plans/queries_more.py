"""Registered queries: appearance, diagnostics, selections and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import align, appearance, datasets, diagnose, retrieve, tracks
from sightline.plans.frames import frame, rounded, with_frames
from sightline.plans.queries_align import IOU


def a5_track_vectors(spark, sf_dir):
    v = frame(spark, sf_dir, "appearances").select("video_id", F.col("track").alias("track_id"), F.col("embedding").alias("vector"))
    t = appearance.track_vectors(v)
    return t.select("video_id", "track_id", "observation_count", rounded(F.element_at("vector", 1)).alias("v1"), rounded(F.element_at("vector", 64)).alias("v64"))


A5 = (
    with_frames("appearances")
    + """, f AS (SELECT video_id, track, unnest(embedding) AS v, unnest(range(1, 65)) AS place FROM appearances), m AS (SELECT video_id, track, place, avg(v::DOUBLE) AS m FROM f GROUP BY 1, 2, 3),
n AS (SELECT video_id, track, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1, 2), c AS (SELECT video_id, track, count(*) AS k FROM appearances GROUP BY 1, 2)
SELECT n.video_id, n.track AS track_id, k AS observation_count, round(a.m / norm, 4) AS v1, round(b.m / norm, 4) AS v64 FROM n JOIN c USING (video_id, track) JOIN m a ON a.video_id = n.video_id AND a.track = n.track AND a.place = 1 JOIN m b ON b.video_id = n.video_id AND b.track = n.track AND b.place = 64"""
)


def f15_prompt_attributes(spark, sf_dir):
    v = frame(spark, sf_dir, "appearances").select("appearance_id", F.col("embedding").alias("vector"))
    prompts = v.filter("appearance_id < 12").select(F.expr("CASE appearance_id%3 WHEN 0 THEN 'color' WHEN 1 THEN 'garment' ELSE 'glasses' END").alias("name"), F.concat(F.lit("p"), "appearance_id").alias("value"), F.col("vector").alias("prompt_vector"))
    return appearance.attributes(v, prompts).select("appearance_id", "name", "value", rounded("confidence").alias("confidence"))


F15 = (
    with_frames("appearances")
    + """, p AS (SELECT CASE appearance_id%3 WHEN 0 THEN 'color' WHEN 1 THEN 'garment' ELSE 'glasses' END AS name, 'p' || appearance_id AS value, embedding AS e FROM appearances WHERE appearance_id < 12),
s AS (SELECT a.appearance_id, name, value, 100 * list_dot_product(a.embedding::DOUBLE[], e::DOUBLE[]) AS s FROM appearances a CROSS JOIN p),
b AS (SELECT *, max(s) OVER w AS top FROM s WINDOW w AS (PARTITION BY appearance_id, name)), c AS (SELECT appearance_id, name, arg_max(value, s) AS value, 1 / sum(exp(s - top)) AS confidence FROM b GROUP BY 1, 2)
SELECT appearance_id, name, value, round(confidence, 4) AS confidence FROM c WHERE confidence >= 0.45e0"""
)


def a6_scope_counts(spark, sf_dir):
    return diagnose.scope_counts(frame(spark, sf_dir, "detections"), frame(spark, sf_dir, "actions"))


def a7_inventory(spark, sf_dir):
    return diagnose.inventory(frame(spark, sf_dir, "actions")).withColumn("confidence", rounded("confidence"))


A7 = (
    with_frames("actions")
    + """, s AS (SELECT label, source_method, count(*) AS k, max(coalesce(confidence, 0e0)) AS c FROM actions GROUP BY 1, 2)
SELECT label, sum(k)::BIGINT AS n, round(max(c), 4) AS confidence, string_agg(source_method || '=' || k, ',' ORDER BY source_method) AS sources FROM s GROUP BY 1"""
)


def _matched(spark, sf_dir):
    d = frame(spark, sf_dir, "annotations").selectExpr("row_id AS detection_id", "video_id", "timestamp", "x1+0.05e0*(row_id%3) AS x1", "y1", "x2", "y2")
    return d, frame(spark, sf_dir, "annotations"), diagnose.annotated_entities(d, frame(spark, sf_dir, "annotations"))


def j11_annotated_entities(spark, sf_dir):
    _, _, m = _matched(spark, sf_dir)
    return m.select("detection_id", "entity_id", rounded("iou").alias("iou"))


J11 = (
    with_frames("annotations")
    + f""", d AS (SELECT row_id AS detection_id, video_id, timestamp, x1+0.05e0*(row_id%3) AS x1, y1, x2, y2 FROM annotations),
e AS (SELECT video_id, timestamp, entity_id, arg_min(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2), row_id) AS bx, min(row_id) AS place FROM annotations GROUP BY 1, 2, 3),
f AS (SELECT video_id, timestamp, entity_id, place, bx.x1 AS x1, bx.y1 AS y1, bx.x2 AS x2, bx.y2 AS y2 FROM e),
p AS (SELECT a.detection_id, b.entity_id, {IOU} AS iou, row_number() OVER (PARTITION BY a.detection_id ORDER BY {IOU} DESC, b.place) AS rn FROM d a JOIN f b ON a.video_id = b.video_id AND a.timestamp = b.timestamp WHERE {IOU} >= 0.3e0)
SELECT d.detection_id, entity_id, round(iou, 4) AS iou FROM d LEFT JOIN p ON p.detection_id = d.detection_id AND rn = 1"""
)


def j12_enriched_nodes(spark, sf_dir):
    d, a, m = _matched(spark, sf_dir)
    nodes = diagnose.enriched(d.join(m, "detection_id"), a)
    return nodes.groupBy("video_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("entity_id").alias("named"))


def j14_matched_windows(spark, sf_dir):
    d = frame(spark, sf_dir, "detections")
    segments = align.spine(d.select("video_id", F.col("timestamp").alias("end_time")))
    labels = d.select("video_id", F.expr("floor(timestamp/5)*5e0+0.03e0").alias("label_start"), F.expr("floor(timestamp/5)*5e0+4.98e0").alias("label_end")).distinct()
    return align.matched_windows(labels, segments).select("segment_id", "label_start")


J14 = (
    with_frames("detections")
    + """, v AS (SELECT video_id, greatest(5e0, max(timestamp)) AS duration, greatest(1, ceil(greatest(5e0, max(timestamp)) / 5))::BIGINT AS n FROM detections GROUP BY 1), s AS (SELECT *, unnest(range(n)) AS idx FROM v),
g AS (SELECT video_id, idx * 5e0 AS start_time, least(duration, idx * 5e0 + 5) AS end_time FROM s), l AS (SELECT DISTINCT video_id, floor(timestamp / 5) * 5e0 + 0.03e0 AS label_start, floor(timestamp / 5) * 5e0 + 4.98e0 AS label_end FROM detections)
SELECT g.video_id || ':' || round(start_time * 1000)::BIGINT || ':' || round(end_time * 1000)::BIGINT AS segment_id, label_start FROM g JOIN l ON l.video_id = g.video_id AND abs(label_start - start_time) <= 0.05e0 AND abs(label_end - end_time) <= 0.05e0"""
)


def j27_keep_higher(spark, sf_dir):
    r = frame(spark, sf_dir, "runs").select("query_id", F.col("video_id").alias("segment_id"), "score", "method")
    return retrieve.keep_higher(*(r.filter(F.col("method") == m).drop("method") for m in ("lexical", "hybrid"))).withColumn("score", rounded("score"))


def u1_union_of_readings(spark, sf_dir):
    r = frame(spark, sf_dir, "runs").select("query_id", F.col("start_time").cast("int").cast("string").alias("segment_id"), "score", F.col("method").alias("hypothesis_id"), F.expr("CASE method WHEN 'lexical' THEN 0 ELSE 1 END").alias("reading"))
    return retrieve.union_of_readings(r).select("query_id", "segment_id", rounded("score").alias("score"), "best_reading", F.array_join("readings", ",").alias("readings"))


U1 = (
    with_frames("runs")
    + """ SELECT query_id, start_time::INT::VARCHAR AS segment_id, round(max(score), 4) AS score, arg_max(method, struct_pack(s := score, r := CASE method WHEN 'lexical' THEN 0 ELSE -1 END)) AS best_reading, string_agg(DISTINCT method, ',' ORDER BY method) AS readings FROM runs GROUP BY 1, 2"""
)


def w9_first_turns(spark, sf_dir):
    return frame(spark, sf_dir, "speaker_turns").groupBy("video_id", "speaker").agg(F.min(F.struct("start_time", "turn_id")).alias("t")).select("video_id", "speaker", "t.start_time", "t.turn_id")


def d2_lexicographic_split(spark, sf_dir):
    """The last tenth of suppliers' videos by name is the test split."""
    v = frame(spark, sf_dir, "annotations").select("video_id").distinct()
    ordered = datasets.ordered_split(v)
    return ordered


D2 = with_frames("annotations") + ", v AS (SELECT DISTINCT video_id FROM annotations), k AS (SELECT video_id, row_number() OVER (ORDER BY video_id DESC) AS r, count(*) OVER () AS n FROM v) SELECT video_id, CASE WHEN r <= greatest(1, floor(n * 0.1e0)) THEN 'test' ELSE 'train' END AS split FROM k"


def d6_growing_splits(spark, sf_dir):
    s = datasets.hash_split(frame(spark, sf_dir, "annotations").select("video_id"))
    return datasets.growing_splits(s, 0, [10, 20, 40]).groupBy("size", "split").agg(F.count(F.lit(1)).alias("videos")).withColumn("size", F.col("size").cast("long"))


D6 = (
    with_frames("annotations")
    + """, v AS (SELECT DISTINCT video_id FROM annotations), k AS (SELECT video_id, row_number() OVER (ORDER BY sha256('2026:' || video_id), video_id) AS rank, count(*) OVER () AS n FROM v),
sp AS (SELECT video_id, rank, CASE WHEN rank > n - greatest(1, floor(n * 0.1e0)) THEN 'test' WHEN rank > n - 2 * greatest(1, floor(n * 0.1e0)) THEN 'validation' ELSE 'train' END AS split FROM k)
SELECT s::BIGINT AS size, split, count(*) AS videos FROM sp CROSS JOIN (VALUES (10), (20), (40)) z(s) WHERE split <> 'train' OR rank <= s GROUP BY 1, 2"""
)


def p7_manifest_faults(spark, sf_dir):
    r = frame(spark, sf_dir, "relevant").select("query_id", F.expr("query_id%5=0").alias("negative"), F.expr("CASE WHEN query_id%7=1 THEN NULL ELSE moment END").alias("moment"), "start_time", F.expr("CASE WHEN query_id%11=0 THEN start_time ELSE end_time END").alias("end_time"), "peak_time")
    return diagnose.manifest_faults(r)


P7 = (
    with_frames("relevant")
    + """, r AS (SELECT query_id, query_id%5=0 AS negative, CASE WHEN query_id%7=1 THEN NULL ELSE moment END AS moment, start_time, CASE WHEN query_id%11=0 THEN start_time ELSE end_time END AS end_time, peak_time FROM relevant)
SELECT query_id, 'error' AS severity, 'a negative query has moments' AS message FROM r WHERE negative AND moment IS NOT NULL UNION ALL SELECT query_id, 'error', 'a positive query lacks moments' FROM r WHERE NOT negative AND moment IS NULL
UNION ALL SELECT query_id, 'error', 'an interval is empty' FROM r WHERE moment IS NOT NULL AND end_time <= start_time UNION ALL SELECT query_id, 'error', 'a peak is outside its interval' FROM r WHERE moment IS NOT NULL AND NOT (peak_time BETWEEN start_time AND end_time)"""
)


def u7_citations(spark, sf_dir):
    r = frame(spark, sf_dir, "runs")
    cited = r.filter("rank_id%4=0").groupBy("query_id").agg(F.collect_set(F.concat(F.lit("E"), (F.col("rank_id") % 9).cast("string"))).alias("cited"))
    ids = r.filter("rank_id%3=0").groupBy("query_id").agg(F.collect_set(F.concat(F.lit("E"), (F.col("rank_id") % 9).cast("string"))).alias("ids"))
    return diagnose.citations(cited, ids).select("query_id", F.array_join(F.sort_array("unknown"), ",").alias("unknown"), "stands")


U7 = (
    with_frames("runs")
    + """, c AS (SELECT DISTINCT query_id, 'E' || rank_id%9 AS e FROM runs WHERE rank_id%4=0), i AS (SELECT DISTINCT query_id, 'E' || rank_id%9 AS e FROM runs WHERE rank_id%3=0)
SELECT c.query_id, coalesce(string_agg(c.e, ',' ORDER BY c.e) FILTER (i.e IS NULL), '') AS unknown, count(*) FILTER (i.e IS NULL) = 0 AS stands FROM c LEFT JOIN i ON i.query_id = c.query_id AND i.e = c.e GROUP BY 1"""
)


def w6_pooled_vectors(spark, sf_dir):
    v = frame(spark, sf_dir, "appearances").select("video_id", F.col("appearance_id").cast("double").alias("time"), F.col("embedding").alias("vector"))
    return tracks.pooled(v, 200.0).select("video_id", "time", rounded(F.element_at("vector", 1)).alias("v1"))


W6 = (
    with_frames("appearances")
    + """, s AS (SELECT video_id, appearance_id AS t, embedding::DOUBLE[] AS own, CASE WHEN appearance_id - lag(appearance_id) OVER w <= 200 THEN lag(embedding) OVER w ELSE embedding END::DOUBLE[] AS p, CASE WHEN lead(appearance_id) OVER w - appearance_id <= 200 THEN lead(embedding) OVER w ELSE embedding END::DOUBLE[] AS n FROM appearances WINDOW w AS (PARTITION BY video_id ORDER BY appearance_id)),
m AS (SELECT video_id, t, unnest(range(1, 65)) AS place, unnest(own) AS o, unnest(p) AS p, unnest(n) AS n FROM s), x AS (SELECT video_id, t, place, 0.25e0 * p + 0.25e0 * n + 0.25e0 * (n - p) + 0.5e0 * o AS v FROM m)
SELECT video_id, t::DOUBLE AS time, round(max(v) FILTER (place = 1) / sqrt(sum(v * v)), 4) AS v1 FROM x GROUP BY 1, 2"""
)

QUERIES = {f.__name__: f for f in (a5_track_vectors, f15_prompt_attributes, a6_scope_counts, a7_inventory, j11_annotated_entities, j12_enriched_nodes, j14_matched_windows, j27_keep_higher, u1_union_of_readings, w9_first_turns, d2_lexicographic_split, d6_growing_splits, p7_manifest_faults, u7_citations, w6_pooled_vectors)}
ORACLES = {
    "a5_track_vectors": A5,
    "f15_prompt_attributes": F15,
    "a6_scope_counts": with_frames("detections", "actions") + " SELECT 'videos' AS what, count(DISTINCT video_id) AS n FROM detections UNION ALL SELECT 'frames', count(DISTINCT frame_id) FROM detections UNION ALL SELECT 'classes', count(DISTINCT class_label) FROM detections UNION ALL SELECT 'labels', count(DISTINCT label) FROM actions",
    "a7_inventory": A7,
    "j11_annotated_entities": J11,
    "j14_matched_windows": J14,
    "j27_keep_higher": with_frames("runs") + " SELECT query_id, video_id AS segment_id, round(max(score), 4) AS score FROM runs GROUP BY 1, 2",
    "u1_union_of_readings": U1,
    "w9_first_turns": with_frames("speaker_turns") + " SELECT video_id, speaker, min(start_time) AS start_time, arg_min(turn_id, struct_pack(s := start_time, t := turn_id)) AS turn_id FROM speaker_turns GROUP BY 1, 2",
    "d2_lexicographic_split": D2,
    "d6_growing_splits": D6,
    "p7_manifest_faults": P7,
    "u7_citations": U7,
    "w6_pooled_vectors": W6,
}
