"""Registered queries: tagging, validity, merging, graph tables and stream forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import align, evaluate, relations, tagging
from sightline.sources import readers, sinks
from sightline.sources.scratch import scratch_path, stored
from sightline.streaming import evidence
from sightline.plans.frames import frame, rounded, with_frames
from sightline.plans.queries_align import SPATIAL
from sightline.plans.queries_retrieve import distinct_plans, for_all_queries


def s10_first_of_each_content(spark, sf_dir):
    m = readers.first_of_each_content(frame(spark, sf_dir, "media"))
    return m.select("video_id", "first_id", "is_first")


def s13_graph_tables(spark, sf_dir):
    d = frame(spark, sf_dir, "detections")
    segments = align.spine(d.select("video_id", F.col("timestamp").alias("end_time")))
    nodes, edges = sinks.graph_tables(segments, align.place_points(d, segments), relations.spatial_relations(d))
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(edges.groupBy("type").agg(F.count(F.lit(1))))


S13 = (
    with_frames("detections")
    + ","
    + SPATIAL
    + """, v AS (SELECT video_id, greatest(1, ceil(greatest(5e0, max(timestamp)) / 5))::BIGINT AS n FROM detections GROUP BY 1)
SELECT 'Video' AS kind, count(*) AS n FROM v UNION ALL SELECT 'Segment', sum(n)::BIGINT FROM v UNION ALL SELECT 'Entity', count(*) FROM detections
UNION ALL SELECT 'HAS_SEGMENT', sum(n)::BIGINT FROM v UNION ALL SELECT 'CONTAINS', count(*) FROM detections UNION ALL SELECT upper(predicate), count(*) FROM relations GROUP BY 1"""
)


def s14_attribute_columns(spark, sf_dir):
    a = frame(spark, sf_dir, "actions").filter("confidence is not null").selectExpr("action_id%500 AS appearance_id", "CASE action_id%3 WHEN 0 THEN 'color' WHEN 1 THEN 'garment' ELSE 'glasses' END AS name", "label AS value", "confidence+action_id*1e-7 AS confidence")
    return sinks.attribute_columns(a, ["color", "garment", "glasses"]).select("appearance_id", "color_value", "garment_value", "glasses_value", rounded("color_confidence").alias("color_confidence"))


S14 = (
    with_frames("actions")
    + """, a AS (SELECT action_id%500 AS appearance_id, action_id%3 AS k, label, confidence+action_id*1e-7 AS c FROM actions WHERE confidence IS NOT NULL)
SELECT appearance_id, arg_max(label, c) FILTER (k = 0) AS color_value, arg_max(label, c) FILTER (k = 1) AS garment_value, arg_max(label, c) FILTER (k = 2) AS glasses_value, round(max(c) FILTER (k = 0), 4) AS color_confidence FROM a GROUP BY 1"""
)


def s16_video_summary(spark, sf_dir):
    d = frame(spark, sf_dir, "detections")
    return sinks.video_summary(d, relations.spatial_relations(d))


S16 = (
    with_frames("detections")
    + ","
    + SPATIAL
    + """, f AS (SELECT video_id, frame_id, count(*) AS nodes FROM detections GROUP BY 1, 2), e AS (SELECT frame_id, count(*) AS edges FROM relations GROUP BY 1)
SELECT video_id, count(*) AS frames, sum(nodes)::BIGINT AS nodes, sum(coalesce(edges, 0))::BIGINT AS edges, count(*) FILTER (edges > 0) AS linked_frames, max(nodes) AS most_nodes FROM f LEFT JOIN e USING (frame_id) GROUP BY 1"""
)


def p6_row_validity(spark, sf_dir):
    _, bad = sinks.checked(frame(spark, sf_dir, "detections"), sinks.box_rules())
    return bad.select("detection_id", F.array_join("reasons", "; ").alias("reasons"))


P6 = with_frames("detections") + " SELECT detection_id, 'outside the frame' AS reasons FROM detections WHERE NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1)"


def p6_broken_rows(spark, sf_dir):
    """Detections of which some have turned corners, a confidence above one or a blank class: those that fail, with all their reasons."""
    d = frame(spark, sf_dir, "detections")
    turned = F.col("detection_id") % 9 == 0
    broken = d.withColumns(
        {
            "x1": F.when(turned, F.col("x2")).otherwise(F.col("x1")),
            "x2": F.when(turned, F.col("x1") - 0.5).otherwise(F.col("x2")),
            "confidence": F.when(F.col("detection_id") % 11 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")),
            "class_label": F.when(F.col("detection_id") % 13 == 0, " ").otherwise(F.col("class_label")),
        }
    )
    _, bad = sinks.checked(broken, sinks.box_rules())
    return bad.select("detection_id", F.array_join("reasons", "; ").alias("reasons"))


P6_BROKEN = (
    with_frames("detections")
    + """, b AS (SELECT detection_id, CASE WHEN detection_id % 9 = 0 THEN x2 ELSE x1 END AS x1, CASE WHEN detection_id % 9 = 0 THEN x1 - 0.5e0 ELSE x2 END AS x2, y1, y2,
  CASE WHEN detection_id % 11 = 0 THEN confidence + 1 ELSE confidence END AS confidence, CASE WHEN detection_id % 13 = 0 THEN ' ' ELSE class_label END AS class_label FROM detections),
r AS (SELECT detection_id, concat_ws('; ', CASE WHEN NOT (x1 <= x2 AND y1 <= y2) THEN 'corners out of order' END, CASE WHEN NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1) THEN 'outside the frame' END,
  CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN NOT length(trim(class_label)) > 0 THEN 'blank class' END) AS reasons FROM b)
SELECT detection_id, reasons FROM r WHERE reasons <> ''"""
)


def u2_override(spark, sf_dir):
    a = frame(spark, sf_dir, "actions").select("action_id", "label", "source_method")
    out = sinks.override(a.filter("source_method <> 'ava_ground_truth'"), a.filter("source_method = 'ava_ground_truth'").withColumn("action_id", F.col("action_id") + 1), ["action_id"])
    return out.groupBy("source_method", "label").agg(F.count(F.lit(1)).alias("n"))


U2 = (
    with_frames("actions")
    + """, t AS (SELECT action_id + 1 AS action_id, label, source_method FROM actions WHERE source_method = 'ava_ground_truth'), f AS (SELECT action_id, label, source_method FROM actions WHERE source_method <> 'ava_ground_truth')
SELECT source_method, label, count(*) AS n FROM (SELECT * FROM f WHERE action_id NOT IN (SELECT action_id FROM t) UNION ALL SELECT * FROM t) GROUP BY 1, 2"""
)


def u3_replace_source(spark, sf_dir):
    a = frame(spark, sf_dir, "actions").select(F.concat_ws(":", "video_id", F.col("timestamp").cast("int")).alias("segment_id"), "label", "source_method")
    new = a.filter("source_method = 'learned_action_model'").select("segment_id", F.lit("talk to").alias("label"), F.lit("gnn_action_model").alias("source_method"))
    return sinks.replace_source(a, new, "gnn_action_model").groupBy("source_method", "label").agg(F.count(F.lit(1)).alias("n"))


U3 = (
    with_frames("actions")
    + """, a AS (SELECT video_id || ':' || timestamp::INT AS segment_id, label, source_method FROM actions), n AS (SELECT segment_id FROM a WHERE source_method = 'learned_action_model')
SELECT source_method, label, count(*) AS n FROM (SELECT * FROM a WHERE source_method <> 'gnn_action_model' UNION ALL SELECT segment_id, 'talk to', 'gnn_action_model' FROM n WHERE segment_id NOT IN (SELECT segment_id FROM a WHERE source_method = 'ava_ground_truth' AND label = 'talk to')) GROUP BY 1, 2"""
)

_TEXT = "concat(CASE c_custkey%4 WHEN 0 THEN 'show someone sitting near a cell phone ' WHEN 1 THEN 'where did speaker 1 say ' WHEN 2 THEN 'slide that reads ' ELSE 'laptop ' END, CASE c_custkey%3 WHEN 0 THEN 'deployment' ELSE 'next to the white board' END)"
_LEXICON = [("cell phone", "entity", "cell phone"), ("phone", "entity", "cell phone"), ("laptop", "entity", "laptop"), ("white board", "entity", "whiteboard"), ("board", "entity", "whiteboard"), ("sitting", "action", "sit"), ("near", "predicate", "near"), ("next to", "predicate", "near")]


def p12_query_plans(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS query_id", f"{_TEXT} AS text")
    p = tagging.plans_of(q, spark.createDataFrame(_LEXICON, "phrase string, kind string, canonical string"))
    return p.select("query_id", *(F.array_join(c, ",").alias(c) for c in ("entities", "actions", "predicates", "spoken_terms", "ocr_terms")), "speaker", "intent")


P12 = """
SELECT c_custkey AS query_id,
  CASE WHEN k = 0 AND d THEN 'cell phone' WHEN k = 0 THEN 'cell phone,whiteboard' WHEN k = 3 AND d THEN 'laptop' WHEN k = 3 THEN 'laptop,whiteboard' WHEN d THEN '' ELSE 'whiteboard' END AS entities,
  CASE WHEN k = 0 THEN 'sit' ELSE '' END AS actions, CASE WHEN k = 0 OR NOT d THEN 'near' ELSE '' END AS predicates,
  CASE WHEN k = 0 AND d THEN 'deployment' WHEN k = 1 AND d THEN 'did,deployment' WHEN k = 1 THEN 'did' WHEN k = 3 AND d THEN 'deployment' ELSE '' END AS spoken_terms,
  CASE WHEN k = 2 AND d THEN 'that,deployment' WHEN k = 2 THEN 'that' ELSE '' END AS ocr_terms, CASE WHEN k = 1 THEN 'SPEAKER_01' END AS speaker,
  CASE WHEN k = 2 THEN 'ocr_search' WHEN k = 1 THEN 'transcript_search' WHEN k = 0 OR NOT d THEN 'relationship_search' ELSE 'visual_search' END AS intent
FROM (SELECT c_custkey, c_custkey%4 AS k, c_custkey%3 = 0 AS d FROM customer)
"""


def d10_decoded_labels(spark, sf_dir):
    s = frame(spark, sf_dir, "annotations").select(F.col("row_id").alias("item"), F.col("action_id").alias("label"), F.expr("((row_id*37)%101)/100e0").alias("p"), F.expr("row_id%4000").alias("item_id"))
    s = s.groupBy("item_id", "label").agg(F.max("p").alias("p"))
    labels = spark.range(1, 81).select(F.col("id").cast("int").alias("label"))
    thresholds = labels.select("label", (F.lit(0.3) + F.col("label") / 200.0).alias("threshold"))
    caps = labels.select("label", F.expr("CASE WHEN label<=14 THEN 0 WHEN label<=63 THEN 1 ELSE 2 END").alias("grp"), F.expr("CASE WHEN label<=14 THEN 1 ELSE 2 END").alias("cap"))
    return evaluate.decoded(s, thresholds, caps).select("item_id", "label", rounded("p").alias("p"), F.col("place").cast("long").alias("place"))


D10 = (
    with_frames("annotations")
    + """, s AS (SELECT row_id%4000 AS item_id, action_id AS label, max(((row_id*37)%101)/100e0) AS p FROM annotations GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, CASE WHEN label<=14 THEN 0 WHEN label<=63 THEN 1 ELSE 2 END ORDER BY p DESC, label) AS place FROM s WHERE p >= 0.3e0 + label / 200e0)
SELECT item_id, label, round(p, 4) AS p, place FROM r WHERE place <= CASE WHEN label <= 14 THEN 1 ELSE 2 END"""
)


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from sightline.plans.frames import FRAMES

    source, condition, columns = FRAMES[name]
    schema = spark.read.parquet(f"{sf_dir}/{source}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{source[:-1]}[{source[-1]}].parquet").where(condition)
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()), "timestamp_seconds(day(ts)-1) AS ts")


def r1_segment_rollup(spark, sf_dir):
    out = evidence.drained(evidence.segment_rollup(_arriving(spark, sf_dir, "detections")), scratch_path(spark, "stream"))
    return out.select("video_id", F.unix_timestamp("window.start").alias("window_start"), "class_label", "n", rounded("confidence").alias("confidence"))


def r7_sliding_counts(spark, sf_dir):
    out = evidence.drained(evidence.sliding_counts(_arriving(spark, sf_dir, "actions"), "10 seconds", "5 seconds"), scratch_path(spark, "stream"))
    return out.select("video_id", F.unix_timestamp("window.start").alias("window_start"), "label", "n", rounded("confidence").alias("confidence"))


def r2_relation_episodes(spark, sf_dir):
    """Episodes of (video, label, source) among arriving actions."""
    arriving = _arriving(spark, sf_dir, "actions").select(F.col("video_id").alias("source_track_id"), F.col("label").alias("target_track_id"), F.col("source_method").alias("predicate"), "ts", F.lit(0.5).alias("confidence"))
    out = evidence.drained(evidence.relation_episodes(arriving), scratch_path(spark, "stream"))
    return out.select("source_track_id", "target_track_id", "predicate", F.unix_timestamp("session_window.start").alias("first_second"), "observation_count")


R2 = (
    with_frames("actions")
    + """, a AS (SELECT *, timestamp - lag(timestamp) OVER w > 1.5e0 AS fresh FROM actions WINDOW w AS (PARTITION BY video_id, label, source_method ORDER BY timestamp, action_id)),
e AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY video_id, label, source_method ORDER BY timestamp, action_id ROWS UNBOUNDED PRECEDING) AS episode FROM a)
SELECT video_id AS source_track_id, label AS target_track_id, source_method AS predicate, min(timestamp)::BIGINT AS first_second, count(*) AS observation_count FROM e GROUP BY video_id, label, source_method, episode"""
)


def r4_first_contents(spark, sf_dir):
    """Content hashes of arriving media, each once."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    media = spark.readStream.schema(schema).parquet(f"{sf_dir}/document[s].parquet").where("text is not null").selectExpr("md5(text) AS sha", "timestamp_seconds(1+doc_id%97) AS ts")
    return evidence.drained(evidence.first_content(media), scratch_path(spark, "stream"), "append").select("sha")


def r5_upserted_videos(spark, sf_dir):
    """The same arriving detections upserted twice; the table holds them once."""
    path = scratch_path(spark, "upserts")
    for run in (1, 2):
        query = evidence.upsert_videos(_arriving(spark, sf_dir, "detections").select("video_id", "detection_id", "class_label"), f"{path}/table", f"{path}/state{run}")
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(f"{path}/table").groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))


def r6_standing_queries(spark, sf_dir):
    """Arriving utterances against the plans' spoken terms, each list of terms once; a segment is an utterance."""
    terms = F.array_distinct(F.filter(F.split("term_list", ","), lambda t: t != ""))
    asked, members = distinct_plans(frame(spark, sf_dir, "plans").select("query_id", terms.alias("t")), ("t",))
    wanted = stored(asked, "terms").select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("token"))
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation[s].parquet").where("text is not null")
    arriving = arriving.select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("token"))
    out = evidence.drained(evidence.standing_queries(arriving, wanted), scratch_path(spark, "stream"))
    return for_all_queries(out.select("query_id", "segment_id", rounded("score").alias("score")), members)


R6 = (
    with_frames("plans")
    + """, w AS (SELECT query_id, unnest(list_distinct(string_split(term_list, ','))) AS token, len(list_distinct(string_split(term_list, ','))) AS n FROM plans WHERE term_list <> ''),
t AS (SELECT DISTINCT conv_id * 1000 + turn AS segment_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations WHERE text IS NOT NULL)
SELECT query_id, segment_id, round(count(*) / any_value(n)::DOUBLE, 4) AS score FROM w JOIN t USING (token) GROUP BY 1, 2"""
)



QUERIES = {f.__name__: f for f in (r2_relation_episodes, r4_first_contents, r5_upserted_videos, r6_standing_queries, s10_first_of_each_content, s13_graph_tables, s14_attribute_columns, s16_video_summary, p6_row_validity, p6_broken_rows, u2_override, u3_replace_source, p12_query_plans, d10_decoded_labels, r1_segment_rollup, r7_sliding_counts)}
ORACLES = {
    "r2_relation_episodes": R2,
    "r4_first_contents": "SELECT DISTINCT md5(text) AS sha FROM documents WHERE text IS NOT NULL",
    "r5_upserted_videos": with_frames("detections") + " SELECT video_id, count(*) AS n FROM detections GROUP BY 1",
    "r6_standing_queries": R6,
    "s10_first_of_each_content": with_frames("media") + " SELECT video_id, first_value(video_id) OVER w AS first_id, first_value(video_id) OVER w = video_id AS is_first FROM media WINDOW w AS (PARTITION BY sha ORDER BY uploaded, video_id)",
    "s13_graph_tables": S13,
    "s14_attribute_columns": S14,
    "s16_video_summary": S16,
    "p6_row_validity": P6,
    "p6_broken_rows": P6_BROKEN,
    "u2_override": U2,
    "u3_replace_source": U3,
    "p12_query_plans": P12,
    "d10_decoded_labels": D10,
    "r1_segment_rollup": with_frames("detections") + " SELECT video_id, floor(timestamp / 5)::BIGINT * 5 AS window_start, class_label, count(*) AS n, round(max(confidence), 4) AS confidence FROM detections GROUP BY 1, 2, 3",
    "r7_sliding_counts": with_frames("actions") + ", w AS (SELECT *, unnest([floor(timestamp / 5)::BIGINT * 5, floor(timestamp / 5)::BIGINT * 5 - 5]) AS window_start FROM actions) SELECT video_id, window_start, label, count(*) AS n, round(max(confidence), 4) AS confidence FROM w GROUP BY 1, 2, 3",
}
