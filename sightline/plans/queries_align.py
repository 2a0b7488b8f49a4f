"""Registered queries: alignment, relations and tracks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import text as t
from sightline.operators import align, relations, tracks
from sightline.plans import lexicon
from sightline.plans.frames import frame, ocr_lines, rounded, with_frames

#: IoU, centres and distance of boxes a and b in SQL.
_IW = "greatest(0e0, least(a.x2,b.x2)-greatest(a.x1,b.x1))"
_IH = "greatest(0e0, least(a.y2,b.y2)-greatest(a.y1,b.y1))"
_INTER = f"({_IW}*{_IH})"
_AREA = "(greatest(0e0,{0}.x2-{0}.x1)*greatest(0e0,{0}.y2-{0}.y1))"
_UNION = f"({_AREA.format('a')}+{_AREA.format('b')}-{_INTER})"
IOU = f"(CASE WHEN {_UNION}>0 THEN {_INTER}/{_UNION} ELSE 0e0 END)"
CX, CY = "(({0}.x1+{0}.x2)/2)", "(({0}.y1+{0}.y2)/2)"
_DX, _DY = f"({CX.format('a')}-{CX.format('b')})", f"({CY.format('a')}-{CY.format('b')})"
DIST = f"sqrt({_DX}*{_DX}+{_DY}*{_DY})"


def j1_spatial_relations(spark, sf_dir):
    r = relations.spatial_relations(frame(spark, sf_dir, "detections"))
    return r.select("relationship_id", "frame_id", "source_id", "target_id", "predicate", rounded("confidence", 4).alias("confidence"))


SPATIAL = f"""
pairs AS (SELECT a.frame_id, a.timestamp, a.detection_id AS i, b.detection_id AS j, {IOU} AS iou, {DIST} AS d, {CX.format("a")} AS ax, {CX.format("b")} AS bx, {CY.format("a")} AS ay, {CY.format("b")} AS by_
  FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id < b.detection_id),
edges AS (
  SELECT frame_id, timestamp, i AS source_id, j AS target_id, 'overlaps_with' AS predicate, least(1e0, iou) AS confidence FROM pairs WHERE iou > 0
  UNION ALL SELECT frame_id, timestamp, i, j, 'near', greatest(0e0, 1 - d / 0.22e0) FROM pairs WHERE d <= 0.22e0
  UNION ALL SELECT frame_id, timestamp, CASE WHEN ax < bx THEN i ELSE j END, CASE WHEN ax < bx THEN j ELSE i END, 'left_of', least(1e0, abs(ax - bx)) FROM pairs WHERE abs(ax - bx) >= 0.05e0
  UNION ALL SELECT frame_id, timestamp, CASE WHEN ay < by_ THEN i ELSE j END, CASE WHEN ay < by_ THEN j ELSE i END, 'above', least(1e0, abs(ay - by_)) FROM pairs WHERE abs(ay - by_) >= 0.05e0),
relations AS (
  SELECT 'rel_' || substr(sha1(source_id || ':' || target_id || ':' || predicate || ':' || printf('%.3f', timestamp) || ':bounding_box_geometry'), 1, 20) AS relationship_id,
    frame_id, timestamp, source_id, target_id, predicate, confidence, 'bounding_box_geometry' AS source_method FROM edges)
"""
J1 = with_frames("detections") + "," + SPATIAL + "SELECT relationship_id, frame_id, source_id, target_id, predicate, round(confidence, 4) AS confidence FROM relations"


def j2_pixel_relations(spark, sf_dir):
    px = frame(spark, sf_dir, "detections").withColumns({c: F.col(c) * 1000 for c in ("x1", "y1", "x2", "y2")})
    return relations.pixel_relations(px).select("frame_id", "source_id", "target_id", "predicate")


J2 = (
    with_frames("detections")
    + f""", px AS (SELECT detection_id, frame_id, x1*1000 AS x1, y1*1000 AS y1, x2*1000 AS x2, y2*1000 AS y2 FROM detections),
pairs AS (SELECT a.frame_id, a.detection_id AS source_id, b.detection_id AS target_id, {IOU} AS iou, {_INTER} AS inter, {DIST} AS d,
  {CX.format("a")} AS ax, {CX.format("b")} AS bx, {CY.format("a")} AS ay, {CY.format("b")} AS by_,
  b.x1>=a.x1 AND b.y1>=a.y1 AND b.x2<=a.x2 AND b.y2<=a.y2 AS c, a.x1>=b.x1 AND a.y1>=b.y1 AND a.x2<=b.x2 AND a.y2<=b.y2 AS i
  FROM px a JOIN px b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id),
r AS (SELECT frame_id, source_id, target_id, unnest([CASE WHEN iou > 0.05e0 THEN 'overlaps_with' WHEN inter > 0 THEN 'touches' END, CASE WHEN c THEN 'contains' END, CASE WHEN i THEN 'inside' END, CASE WHEN d < 150 THEN 'near' END,
  CASE WHEN d <= 300 AND ax < bx - 20 THEN 'left_of' WHEN d <= 300 AND ax > bx + 20 THEN 'right_of' END, CASE WHEN d <= 300 AND ay < by_ - 20 THEN 'above' WHEN d <= 300 AND ay > by_ + 20 THEN 'below' END]) AS predicate FROM pairs)
SELECT DISTINCT frame_id, source_id, target_id, predicate FROM r WHERE predicate IS NOT NULL"""
)


def j4_nearest_targets(spark, sf_dir):
    n = relations.nearest_targets(frame(spark, sf_dir, "detections"))
    return n.select("frame_id", "source_id", "target_id", rounded("distance", 4).alias("distance"))


J4 = (
    with_frames("detections")
    + f""" SELECT frame_id, source_id, target_id, round(d, 4) AS distance FROM (
  SELECT a.frame_id, a.detection_id AS source_id, b.detection_id AS target_id, {DIST} AS d, row_number() OVER (PARTITION BY a.detection_id ORDER BY {DIST}, b.detection_id) AS rn
  FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id WHERE a.class_label = 'person') WHERE rn = 1"""
)


def j5_assign_speakers(spark, sf_dir):
    return align.assign_speakers(frame(spark, sf_dir, "transcripts"), frame(spark, sf_dir, "speaker_turns")).select("utterance_id", "speaker")


SPOKEN = """
shared AS (SELECT u.utterance_id, s.speaker, s.turn_id, greatest(0e0, least(u.end_time, s.end_time) - greatest(u.start_time, s.start_time)) AS o
  FROM transcripts u JOIN speaker_turns s ON u.video_id = s.video_id AND least(u.end_time, s.end_time) > greatest(u.start_time, s.start_time)),
best AS (SELECT utterance_id, speaker FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY o DESC, turn_id) AS rn FROM shared) WHERE rn = 1),
spoken AS (SELECT t.*, coalesce(b.speaker, 'UNKNOWN') AS speaker FROM transcripts t LEFT JOIN best b USING (utterance_id))
"""
J5 = with_frames("transcripts", "speaker_turns") + "," + SPOKEN + "SELECT utterance_id, speaker FROM spoken"


def j6_audio_in_frames(spark, sf_dir):
    frames = frame(spark, sf_dir, "detections").select("video_id", "timestamp").distinct()
    return align.audio_in_frames(frames, frame(spark, sf_dir, "transcripts")).select("video_id", "timestamp", F.array_join("utterances", ",").alias("utterances"))


J6 = (
    with_frames("detections", "transcripts")
    + """ SELECT f.video_id, f.timestamp, string_agg(utterance_id::VARCHAR, ',' ORDER BY utterance_id) AS utterances FROM (SELECT DISTINCT video_id, timestamp FROM detections) f
JOIN transcripts u ON u.video_id = f.video_id AND least(f.timestamp + 1, u.end_time) > greatest(f.timestamp, u.start_time) GROUP BY 1, 2"""
)


def j7_points_in_utterances(spark, sf_dir):
    points = frame(spark, sf_dir, "detections").select("detection_id", "video_id", "timestamp")
    return align.points_in_intervals(points, frame(spark, sf_dir, "transcripts").select("utterance_id", "video_id", "start_time", "end_time")).select("detection_id", "utterance_id")


J7 = with_frames("detections", "transcripts") + " SELECT detection_id, utterance_id FROM detections d JOIN transcripts u ON u.video_id = d.video_id AND d.timestamp BETWEEN u.start_time AND u.end_time"


def j8_nearest_frame(spark, sf_dir):
    points = frame(spark, sf_dir, "transcripts").select("video_id", F.col("start_time").alias("time"), F.col("utterance_id").alias("point_id"))
    frames = frame(spark, sf_dir, "detections").groupBy("video_id", F.col("timestamp").alias("time")).agg(F.min("frame_id").alias("frame_id"))
    return align.nearest(points, frames, tolerance=2.0).select("point_id", "frame_id", rounded("gap", 4).alias("gap"))


J8 = (
    with_frames("detections", "transcripts")
    + """, f AS (SELECT video_id, timestamp AS t, min(frame_id) AS frame_id FROM detections GROUP BY 1, 2),
c AS (SELECT u.utterance_id, f.frame_id, abs(f.t - u.start_time) AS gap, row_number() OVER (PARTITION BY u.utterance_id ORDER BY abs(f.t - u.start_time), f.t) AS rn
  FROM transcripts u JOIN f ON f.video_id = u.video_id AND abs(f.t - u.start_time) <= 2)
SELECT t.utterance_id AS point_id, frame_id, round(gap, 4) AS gap FROM transcripts t LEFT JOIN c ON c.utterance_id = t.utterance_id AND rn = 1"""
)


def j20_neighbours(spark, sf_dir):
    return relations.neighbours(frame(spark, sf_dir, "detections"), k=3).select("source_id", "target_id", "rank", rounded("distance", 4).alias("distance"))


J20 = (
    with_frames("detections")
    + f""" SELECT source_id, target_id, rank, round(d, 4) AS distance FROM (SELECT a.detection_id AS source_id, b.detection_id AS target_id, {DIST} AS d,
  row_number() OVER (PARTITION BY a.detection_id ORDER BY {DIST}, b.detection_id) AS rank FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id WHERE {DIST} <= 0.85e0) WHERE rank <= 3"""
)


def j25_graph_edges(spark, sf_dir):
    e = relations.graph_edges(frame(spark, sf_dir, "detections"))
    return e.select("source_id", "target_id", *(rounded(F.element_at("features", i + 1), 4).alias(n) for i, n in enumerate(("dx", "dy", "dist", "iou", "log_area", "sx", "sy", "touching"))))


J25 = (
    with_frames("detections")
    + f""" SELECT a.detection_id AS source_id, b.detection_id AS target_id, round({CX.format("b")}-{CX.format("a")},4) AS dx, round({CY.format("b")}-{CY.format("a")},4) AS dy, round({DIST},4) AS dist, round({IOU},4) AS iou,
  round(ln(greatest({_AREA.format("b")},1e-6)/greatest({_AREA.format("a")},1e-6)),4) AS log_area, sign({CX.format("b")}-{CX.format("a")})::DOUBLE AS sx, sign({CY.format("b")}-{CY.format("a")})::DOUBLE AS sy, CASE WHEN {_INTER}>0 THEN 1e0 ELSE 0e0 END AS touching
FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id
WHERE CASE (a.class_label='person')::INT + (b.class_label='person')::INT WHEN 2 THEN true WHEN 1 THEN {DIST} <= 0.65e0 ELSE {DIST} <= 0.30e0 END"""
)


def j26_threshold_edges(spark, sf_dir):
    return relations.threshold_edges(frame(spark, sf_dir, "detections")).select("source_id", "target_id", rounded("distance", 4).alias("distance"))


J26 = with_frames("detections") + f" SELECT a.detection_id AS source_id, b.detection_id AS target_id, round({DIST},4) AS distance FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id WHERE {DIST} <= 0.45e0"


def d11_geometry_rules(spark, sf_dir):
    return relations.geometry_rules(relations.frame_pairs(frame(spark, sf_dir, "detections"), ordered=True)).select(F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"), "predicate", "score")


D11 = (
    with_frames("detections")
    + f""", r AS (SELECT a.detection_id AS source_id, b.detection_id AS target_id, unnest([CASE WHEN {DIST} <= 0.25e0 THEN 'next_to' END, CASE WHEN {CY.format("a")} < {CY.format("b")} - 0.1e0 THEN 'above' END,
  CASE WHEN {CY.format("a")} > {CY.format("b")} + 0.1e0 THEN 'beneath' END, CASE WHEN a.x1>=b.x1 AND a.y1>=b.y1 AND a.x2<=b.x2 AND a.y2<=b.y2 THEN 'inside' END]) AS predicate
  FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id) SELECT *, 0.9e0 AS score FROM r WHERE predicate IS NOT NULL"""
)


def w1_relation_intervals(spark, sf_dir):
    """Same-class objects of a video share a track here, so that episodes span frames."""
    d = frame(spark, sf_dir, "detections")
    r = relations.spatial_relations(d)
    i = relations.smooth_intervals(r, d.select("detection_id", F.concat_ws("/", "video_id", "class_label").alias("track_id")))
    return i.select("relationship_id", "k1", "k2", "predicate", "start_time", "end_time", rounded("confidence", 4).alias("confidence"), "observation_count", "temporal_smoothed")


W1 = (
    with_frames("detections")
    + ","
    + SPATIAL
    + """, t AS (SELECT detection_id, video_id || '/' || class_label AS track FROM detections),
k AS (SELECT r.*, CASE WHEN predicate IN ('near','overlaps_with','touches') THEN least(s.track, o.track) ELSE s.track END AS k1, CASE WHEN predicate IN ('near','overlaps_with','touches') THEN greatest(s.track, o.track) ELSE o.track END AS k2
  FROM relations r JOIN t s ON s.detection_id = source_id JOIN t o ON o.detection_id = target_id),
f AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 1.5 THEN 1 WHEN lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM k WINDOW w AS (PARTITION BY k1, k2, predicate ORDER BY timestamp, relationship_id)),
e AS (SELECT *, sum(n) OVER (PARTITION BY k1, k2, predicate ORDER BY timestamp, relationship_id ROWS UNBOUNDED PRECEDING) AS ep FROM f),
m AS (SELECT k1, k2, predicate, min(timestamp) AS start_time, max(timestamp + 1) AS end_time, avg(confidence) AS confidence, count(*) AS observation_count FROM e GROUP BY k1, k2, predicate, ep)
SELECT 'rel_' || substr(sha1(k1 || ':' || k2 || ':' || predicate || ':bounding_box_geometry::' || printf('%.3f', start_time) || ':' || printf('%.3f', end_time)), 1, 20) AS relationship_id, k1, k2, predicate, start_time, end_time,
  round(confidence, 4) AS confidence, observation_count, observation_count > 1 AS temporal_smoothed FROM m"""
)


def w3_motion(spark, sf_dir):
    d = frame(spark, sf_dir, "detections").withColumn("track_id", F.col("class_label"))
    return tracks.motion(d).select("detection_id", *(rounded(c, 4).alias(c) for c in ("prev_cx", "next_cx", "prev_cy", "next_cy", "since_first", "duration")))


_M = "coalesce(({0} - {1}({0}) OVER w) * {2} / greatest((timestamp - {1}(timestamp) OVER w) * {2}, 1e-6), 0e0)"
W3 = (
    with_frames("detections")
    + f""", c AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM detections)
SELECT detection_id, round({_M.format("cx", "lag", 1)}, 4) AS prev_cx, round({_M.format("cx", "lead", -1)}, 4) AS next_cx, round({_M.format("cy", "lag", 1)}, 4) AS prev_cy, round({_M.format("cy", "lead", -1)}, 4) AS next_cy,
  round(timestamp - min(timestamp) OVER p, 4) AS since_first, round(max(timestamp) OVER p - min(timestamp) OVER p, 4) AS duration FROM c
WINDOW w AS (PARTITION BY video_id, class_label ORDER BY timestamp, detection_id), p AS (PARTITION BY video_id, class_label)"""
)


def w10_tracking(spark, sf_dir):
    return tracks.track(frame(spark, sf_dir, "detections")).select("detection_id", "video_id", "ordinal", "track_id")


def w12_merge_ocr(spark, sf_dir):
    return tracks.merge_ocr(ocr_lines(spark, sf_dir)).select("ocr_id", "video_id", "text", "start_time", "end_time", rounded("confidence", 4).alias("confidence"), "observations")


def t4_best_observations(spark, sf_dir):
    d = frame(spark, sf_dir, "detections").withColumn("track_id", F.col("class_label"))
    return tracks.best_observations(d).select("detection_id", F.col("place").cast("long").alias("place"))


T4 = (
    with_frames("detections")
    + """ SELECT detection_id, place FROM (SELECT detection_id, row_number() OVER (PARTITION BY video_id, class_label ORDER BY confidence * sqrt(greatest(0e0,x2-x1)*greatest(0e0,y2-y1)) DESC, timestamp, detection_id) AS place FROM detections) WHERE place <= 6"""
)


def _evidence(spark, sf_dir):
    spoken = align.assign_speakers(frame(spark, sf_dir, "transcripts"), frame(spark, sf_dir, "speaker_turns"))
    ocr = frame(spark, sf_dir, "ocr_tokens").select("video_id", F.col("timestamp").alias("start_time"), (F.col("timestamp") + 1).alias("end_time"), "token_id", "raw_text", "raw_confidence")
    return frame(spark, sf_dir, "detections"), spoken, frame(spark, sf_dir, "actions"), ocr


def a1_segments(spark, sf_dir):
    s = align.build_segments(*_evidence(spark, sf_dir))
    return s.select("segment_id", "video_id", "idx", "start_time", "end_time", *(F.array_join(c, ",").alias(c) for c in ("entities", "actions", "speakers")), F.md5("transcript").alias("transcript_md5"), "n_detections", "n_ocr")


SEGMENTS = (
    SPOKEN
    + """, ocr AS (SELECT video_id, timestamp AS start_time, timestamp + 1 AS end_time, token_id, raw_text, raw_confidence FROM ocr_tokens),
ends AS (SELECT video_id, timestamp AS e FROM detections UNION ALL SELECT video_id, end_time FROM transcripts UNION ALL SELECT video_id, timestamp FROM actions UNION ALL SELECT video_id, end_time FROM ocr),
videos AS (SELECT video_id, greatest(5e0, max(e)) AS duration, greatest(1, ceil(greatest(5e0, max(e)) / 5))::BIGINT AS n FROM ends GROUP BY 1),
cut AS (SELECT video_id, n, idx, idx * 5e0 AS start_time, CASE WHEN least(duration, idx * 5e0 + 5) <= idx * 5e0 THEN idx * 5e0 + 5 ELSE least(duration, idx * 5e0 + 5) END AS end_time FROM (SELECT *, unnest(range(n)) AS idx FROM videos)),
segments AS (SELECT *, video_id || ':' || round(start_time * 1000)::BIGINT || ':' || round(end_time * 1000)::BIGINT AS segment_id FROM cut),
on_d AS (SELECT d.*, s.segment_id FROM detections d JOIN videos v USING (video_id) JOIN segments s ON s.video_id = d.video_id AND s.idx = least(v.n - 1, greatest(0, floor(d.timestamp / 5)::BIGINT))),
on_a AS (SELECT a.*, s.segment_id FROM actions a JOIN videos v USING (video_id) JOIN segments s ON s.video_id = a.video_id AND s.idx = least(v.n - 1, greatest(0, floor(a.timestamp / 5)::BIGINT))),
on_t AS (SELECT u.*, s.segment_id FROM spoken u JOIN videos v USING (video_id) JOIN segments s ON s.video_id = u.video_id AND s.idx BETWEEN least(v.n - 1, floor(u.start_time / 5)::BIGINT) AND least(v.n - 1, floor(greatest(u.start_time, u.end_time - 1e-9) / 5)::BIGINT)
  WHERE least(s.idx * 5e0 + 5, u.end_time) - greatest(s.idx * 5e0, u.start_time) > 0),
on_o AS (SELECT o.*, s.segment_id FROM ocr o JOIN videos v USING (video_id) JOIN segments s ON s.video_id = o.video_id AND s.idx BETWEEN least(v.n - 1, floor(o.start_time / 5)::BIGINT) AND least(v.n - 1, floor(greatest(o.start_time, o.end_time - 1e-9) / 5)::BIGINT)),
g_d AS (SELECT segment_id, string_agg(DISTINCT lower(class_label), ',' ORDER BY lower(class_label)) AS entities, count(*) AS n_detections FROM on_d GROUP BY 1),
g_a AS (SELECT segment_id, string_agg(DISTINCT lower(label), ',' ORDER BY lower(label)) AS actions FROM on_a GROUP BY 1),
g_t AS (SELECT segment_id, string_agg(trim(text), ' ' ORDER BY utterance_id) FILTER (trim(text) <> '') AS transcript, string_agg(DISTINCT speaker, ',' ORDER BY speaker) FILTER (speaker <> 'UNKNOWN') AS speakers FROM on_t GROUP BY 1),
g_o AS (SELECT segment_id, count(*) AS n_ocr FROM on_o GROUP BY 1)
"""
)
_ALL = ("detections", "transcripts", "speaker_turns", "actions", "ocr_tokens")
A1 = (
    with_frames(*_ALL)
    + ","
    + SEGMENTS
    + """SELECT segment_id, video_id, idx, start_time, end_time, coalesce(entities, '') AS entities, coalesce(actions, '') AS actions, coalesce(speakers, '') AS speakers, md5(coalesce(transcript, '')) AS transcript_md5,
  coalesce(n_detections, 0) AS n_detections, coalesce(n_ocr, 0) AS n_ocr FROM segments LEFT JOIN g_d USING (segment_id) LEFT JOIN g_a USING (segment_id) LEFT JOIN g_t USING (segment_id) LEFT JOIN g_o USING (segment_id)"""
)


def a2_action_rollup(spark, sf_dir):
    detections, spoken, actions, ocr = _evidence(spark, sf_dir)
    segments = align.spine(actions.select("video_id", F.col("timestamp").alias("end_time")))
    return align.action_rollup(align.place_points(actions, segments)).withColumn("confidence", rounded("confidence", 4))


A2 = (
    with_frames("actions")
    + """, v AS (SELECT video_id, greatest(5e0, max(timestamp)) AS duration, greatest(1, ceil(greatest(5e0, max(timestamp)) / 5))::BIGINT AS n FROM actions GROUP BY 1),
p AS (SELECT a.*, duration, least(n - 1, floor(timestamp / 5)::BIGINT) AS idx FROM actions a JOIN v USING (video_id)),
s AS (SELECT *, video_id || ':' || (idx * 5000) || ':' || round(CASE WHEN least(duration, idx * 5e0 + 5) <= idx * 5e0 THEN idx * 5e0 + 5 ELSE least(duration, idx * 5e0 + 5) END * 1000)::BIGINT AS segment_id FROM p)
SELECT segment_id, lower(label) AS label, round(max(confidence), 4) AS confidence, arg_max(source_method, action_id) AS source_method, count(*) AS n FROM s GROUP BY 1, 2"""
)


def a3_window_index(spark, sf_dir):
    a = frame(spark, sf_dir, "actions").filter("confidence is not null")
    return a.groupBy("video_id", (F.floor(F.col("timestamp") / 5) * 5).alias("window_start"), "label").agg(rounded(F.max("confidence"), 4).alias("confidence"))


A3 = with_frames("actions") + " SELECT video_id, floor(timestamp / 5)::BIGINT * 5 AS window_start, label, round(max(confidence), 4) AS confidence FROM actions WHERE confidence IS NOT NULL GROUP BY 1, 2, 3"


def a4_frame_labels(spark, sf_dir):
    return frame(spark, sf_dir, "detections").groupBy("video_id", "timestamp", F.col("class_label").alias("label")).agg(rounded(F.max("confidence"), 4).alias("confidence"))


A4 = with_frames("detections") + " SELECT video_id, timestamp, class_label AS label, round(max(confidence), 4) AS confidence FROM detections GROUP BY 1, 2, 3"


def j10_containing_segment(spark, sf_dir):
    d = frame(spark, sf_dir, "detections")
    segments = align.spine(d.select("video_id", F.col("timestamp").alias("end_time")))
    return align.place_points(d, segments).select("detection_id", "segment_id")


J10 = (
    with_frames("detections")
    + """, v AS (SELECT video_id, greatest(5e0, max(timestamp)) AS duration, greatest(1, ceil(greatest(5e0, max(timestamp)) / 5))::BIGINT AS n FROM detections GROUP BY 1)
SELECT detection_id, video_id || ':' || (idx * 5000) || ':' || round(CASE WHEN least(duration, idx * 5e0 + 5) <= idx * 5e0 THEN idx * 5e0 + 5 ELSE least(duration, idx * 5e0 + 5) END * 1000)::BIGINT AS segment_id
FROM (SELECT d.*, duration, least(n - 1, floor(timestamp / 5)::BIGINT) AS idx FROM detections d JOIN v USING (video_id))"""
)


def j13_localized_relations(spark, sf_dir):
    d = frame(spark, sf_dir, "detections").withColumn("track_id", F.concat_ws("/", "video_id", "class_label"))
    i = relations.smooth_intervals(relations.spatial_relations(d).filter("predicate = 'near'"), d.select("detection_id", "track_id"))
    i = i.withColumn("video_id", F.split("k1", "/")[0])
    segments = align.spine(d.select("video_id", F.col("timestamp").alias("end_time")))
    placed = align.place_intervals(i, segments)
    r = relations.localized_endpoints(placed, align.place_points(d, segments))
    return r.select("segment_id", "relationship_id", "source_id", "target_id", "timestamp", "start_time", "end_time")


def p1_normalized_boxes(spark, sf_dir):
    d = frame(spark, sf_dir, "detections")
    n = g.normalized(tuple(F.col(c) * 900 for c in ("x1", "y1", "x2", "y2")), F.lit(800), F.lit(600))
    cx, cy = g.centre(n)
    return d.select("detection_id", *(rounded(c, 4).alias(k) for k, c in zip(("x1", "y1", "x2", "y2", "cx", "cy"), (*n, cx, cy))))


_P1 = [f"least(1e0, greatest(0e0, {c}*900/{s}))" for c, s in (("x1", 800), ("y1", 600), ("x2", 800), ("y2", 600))]
P1 = with_frames("detections") + " SELECT detection_id, " + ", ".join(f"round({e}, 4) AS {k}" for k, e in zip(("x1", "y1", "x2", "y2"), _P1)) + f", round(({_P1[0]}+{_P1[2]})/2, 4) AS cx, round(({_P1[1]}+{_P1[3]})/2, 4) AS cy FROM detections"


def p3_canonical_labels(spark, sf_dir):
    raw = "CASE event_type WHEN 'error' THEN 'Computer' WHEN 'purchase' THEN 'desk' WHEN 'view' THEN 'cell-phone' WHEN 'click' THEN 'People' ELSE 'traffic_light' END"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{raw} AS label")
    return t.canonical(e, "label", lexicon.synonyms(spark, lexicon.ENTITY_SYNONYMS))


P3 = "SELECT event_id, CASE event_type WHEN 'error' THEN 'laptop' WHEN 'purchase' THEN 'dining table' WHEN 'view' THEN 'cell phone' WHEN 'click' THEN 'person' ELSE 'traffic light' END AS label FROM events"


def f12_hashed_vectors(spark, sf_dir):
    v = t.hashed_entries(spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), ["id"], "text")
    return v.select("id", "idx", rounded("val", 6).alias("val"))


F12 = """
WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS token FROM conversations),
h AS (SELECT id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 256)::INT AS idx, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::INT % 2 = 0 THEN 1e0 ELSE -1e0 END AS s FROM w),
x AS (SELECT id, idx, sum(s) AS x FROM h GROUP BY 1, 2 HAVING sum(s) <> 0), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1)
SELECT id, idx, round(x / norm, 6) AS val FROM x JOIN n USING (id)
"""

QUERIES = {f.__name__: f for f in (j1_spatial_relations, j2_pixel_relations, j4_nearest_targets, j5_assign_speakers, j6_audio_in_frames, j7_points_in_utterances, j8_nearest_frame, j10_containing_segment, j13_localized_relations, j20_neighbours, j25_graph_edges, j26_threshold_edges, d11_geometry_rules, w1_relation_intervals, w3_motion, w10_tracking, w12_merge_ocr, t4_best_observations, a1_segments, a2_action_rollup, a3_window_index, a4_frame_labels, p1_normalized_boxes, p3_canonical_labels, f12_hashed_vectors)}
ORACLES = {"j1_spatial_relations": J1, "j2_pixel_relations": J2, "j4_nearest_targets": J4, "j5_assign_speakers": J5, "j6_audio_in_frames": J6, "j7_points_in_utterances": J7, "j8_nearest_frame": J8, "j10_containing_segment": J10, "j20_neighbours": J20, "j25_graph_edges": J25, "j26_threshold_edges": J26, "d11_geometry_rules": D11, "w1_relation_intervals": W1, "w3_motion": W3, "t4_best_observations": T4, "a1_segments": A1, "a2_action_rollup": A2, "a3_window_index": A3, "a4_frame_labels": A4, "p1_normalized_boxes": P1, "p3_canonical_labels": P3, "f12_hashed_vectors": F12}
