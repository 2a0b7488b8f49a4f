"""Registered queries that write evidence files from the given tables and read them back, and small lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text as texts
from sightline.operators import align, appearance, tagging
from sightline.plans.frames import frame, rounded, with_frames
from sightline.sources import readers, sinks
from sightline.sources.scratch import scratch_path

def _as_json_lines(spark, rows, name: str) -> str:
    """Each row as a JSON document on a line of its own, so that files are split wherever Spark likes."""
    path = scratch_path(spark, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


def s1_fused_documents(spark, sf_dir):
    """One document a video, frames with nodes; read back as detections."""
    d = frame(spark, sf_dir, "detections")
    node = F.struct(F.col("detection_id").cast("string").alias("id"), F.col("class_label").alias("label"), "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    frames = d.groupBy("video_id", "timestamp").agg(F.collect_list(node).alias("nodes"))
    documents = frames.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "nodes"))).alias("frames"))
    back = readers.fused_json(spark, _as_json_lines(spark, documents, "fused"), whole_files=False)["detections"]
    return back.select("video_id", "detection_id", "class_label", "timestamp", rounded("confidence").alias("confidence"), "x1", "y2")


S1 = with_frames("detections") + " SELECT video_id, detection_id::VARCHAR AS detection_id, class_label, timestamp, round(confidence, 4) AS confidence, x1, y2 FROM detections"


def s2_annotation_rows(spark, sf_dir):
    """Headerless rows, every eleventh with a malformed time and every thirteenth with a malformed label."""
    path = scratch_path(spark, "annotations")
    a = frame(spark, sf_dir, "annotations")
    a.selectExpr("video_id", "CASE WHEN row_id%11=0 THEN 'soon' ELSE cast(timestamp AS string) END", "x1", "y1", "x2", "y2", "CASE WHEN row_id%13=0 THEN '' ELSE cast(action_id AS string) END", "entity_id").write.csv(path)
    return readers.annotation_csv(spark, path).groupBy("video_id", "action_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.max("x2")).alias("x2"))


S2 = with_frames("annotations") + " SELECT video_id, action_id, count(*) AS n, round(max(x2), 4) AS x2 FROM annotations WHERE row_id%11<>0 AND row_id%13<>0 GROUP BY 1, 2"


def s4_rttm_turns(spark, sf_dir):
    path = scratch_path(spark, "rttm")
    t = frame(spark, sf_dir, "speaker_turns")
    line = F.concat_ws(" ", F.lit("SPEAKER"), "video_id", F.lit("1"), F.format_string("%.3f", "start_time"), F.format_string("%.3f", F.col("end_time") - F.col("start_time")), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>"))
    t.select(F.when(F.col("turn_id") % 7 == 0, F.concat(F.lit("; "), line)).otherwise(line).alias("value")).write.text(path)
    return readers.rttm_turns(spark, path).groupBy("speaker", "start_time", "end_time").agg(F.count(F.lit(1)).alias("n"))


S4 = with_frames("speaker_turns") + " SELECT speaker, start_time, end_time, count(*) AS n FROM speaker_turns WHERE turn_id%7<>0 GROUP BY 1, 2, 3"


def s5_cues(spark, sf_dir):
    """Turns as numbered cues, and the cues read back."""
    path = scratch_path(spark, "cues")
    readers.srt_text(frame(spark, sf_dir, "speaker_turns")).select("value").write.option("lineSep", "\n\n").text(path)
    return readers.srt_cues(spark, path).groupBy("speaker", "start_time", "end_time").agg(F.count(F.lit(1)).alias("n"))


S5 = with_frames("speaker_turns") + " SELECT speaker, start_time, end_time, count(*) AS n FROM speaker_turns GROUP BY 1, 2, 3"


def s6_speaker_rows(spark, sf_dir):
    path = scratch_path(spark, "speakers")
    sinks.speaker_csv(frame(spark, sf_dir, "speaker_turns"), path)
    back = spark.read.option("header", True).schema("speaker string, start double, end double, duration double").csv(path)
    return back.groupBy("speaker").agg(F.count(F.lit(1)).alias("turns"), rounded(F.sum("duration")).alias("seconds"), F.max("end").alias("last"))


S6 = with_frames("speaker_turns") + " SELECT speaker, count(*) AS turns, round(sum(end_time - start_time), 4) AS seconds, max(end_time) AS last FROM speaker_turns GROUP BY 1"


def s7_transcripts(spark, sf_dir):
    """Recogniser output with log odds; utterances read back with their confidence."""
    t = frame(spark, sf_dir, "transcripts")
    segment = F.struct("utterance_id", (F.col("start_time") - 1).alias("start"), F.col("end_time").alias("end"), F.concat(F.lit(" "), F.col("utterance_id").cast("string")).alias("text"), F.expr("-(utterance_id%10)/10e0").alias("avg_logprob"), F.expr("(utterance_id%5)/10e0").alias("no_speech_prob"))
    documents = t.groupBy("video_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    back = readers.transcript_json(spark, _as_json_lines(spark, documents, "transcripts"), whole_files=False)["utterances"]
    return back.select("video_id", "start_time", "end_time", "text", rounded("confidence").alias("confidence"))


S7 = with_frames("transcripts") + " SELECT video_id, greatest(0e0, start_time - 1) AS start_time, end_time, utterance_id::VARCHAR AS text, round(exp(-(utterance_id%10)/10e0) * (1 - (utterance_id%5)/10e0), 4) AS confidence FROM transcripts"


def s8_relation_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    instance = F.struct(F.expr("cast(l_orderkey%5 as int)").alias("subject_tid"), F.expr("cast(l_partkey%5 as int)").alias("object_tid"), F.expr("CASE l_orderkey%3 WHEN 0 THEN 'above' ELSE 'near' END").alias("predicate"), F.expr("cast(l_linenumber as int)").alias("begin_fid"), F.expr("cast(l_linenumber+l_partkey%4 as int)").alias("end_fid"))
    documents = rows.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("video_id")).agg(F.collect_list(instance).alias("relation_instances"))
    back = readers.relation_json(spark, _as_json_lines(spark, documents, "relations"), whole_files=False)["relations"]
    return back.groupBy("video_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_fid") - F.col("begin_fid")).alias("frames"))


S8 = "SELECT 's' || l_suppkey AS video_id, CASE l_orderkey%3 WHEN 0 THEN 'above' ELSE 'near' END AS predicate, count(*) AS n, sum(l_partkey%4)::BIGINT AS frames FROM lineitem GROUP BY 1, 2"


def s9_relevance_manifest(spark, sf_dir):
    r = frame(spark, sf_dir, "relevant")
    moment = F.array(F.struct("start_time", "end_time", "peak_time"))
    query = F.struct(F.col("query_id").cast("string").alias("id"), F.col("category"), F.expr("query_id%5=0").alias("negative"), F.when(F.col("query_id") % 2 == 0, F.col("tolerance") + 1).alias("tolerance_seconds"), F.col("video_id").alias("source_video_id"), F.when(F.col("query_id") % 5 != 0, moment).alias("relevant"))
    manifests = r.groupBy("video_id").agg(F.collect_list(query).alias("queries"))
    back = readers.relevance_manifest(spark, _as_json_lines(spark, manifests, "manifests"), whole_files=False)
    return back.select("query_id", "category", "negative", "tolerance", "video_id", "start_time", "peak_time")


S9 = (
    with_frames("relevant")
    + " SELECT query_id::VARCHAR AS query_id, category, query_id%5=0 AS negative, CASE WHEN query_id%2=0 THEN tolerance + 1 ELSE 2e0 END AS tolerance, video_id, CASE WHEN query_id%5<>0 THEN start_time END AS start_time, CASE WHEN query_id%5<>0 THEN peak_time END AS peak_time FROM relevant"
)


def s12_listed_videos(spark, sf_dir):
    """Detections of the videos that a list names, and the named ones that have none."""
    wanted = frame(spark, sf_dir, "relevant").select("video_id").unionByName(frame(spark, sf_dir, "plans").select(F.concat(F.lit("v"), F.col("query_id") * 3).alias("video_id")))
    found, missing = readers.listed(frame(spark, sf_dir, "detections"), wanted)
    return found.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).unionByName(missing.withColumn("n", F.lit(0).cast("long")))


S12 = (
    with_frames("detections", "relevant", "plans")
    + """, w AS (SELECT video_id FROM relevant UNION SELECT 'v' || query_id * 3 FROM plans) SELECT w.video_id, count(detection_id) AS n FROM w LEFT JOIN detections d ON d.video_id = w.video_id GROUP BY 1"""
)


def s17_overlay(spark, sf_dir):
    """Manual labels of an earlier run give way to the new ones."""
    old = frame(spark, sf_dir, "actions").select(F.concat_ws(":", "video_id", F.floor(F.col("timestamp") / 5)).alias("segment_id"), "label", F.expr("CASE action_id%4 WHEN 0 THEN 'manual_annotation' ELSE source_method END").alias("source_method")).distinct()
    manual = old.filter("label = 'sit'").select("segment_id", F.lit("wave").alias("label")).distinct()
    return sinks.overlay(old, manual).groupBy("segment_id", "source_method").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


S17 = (
    with_frames("actions")
    + """, o AS (SELECT DISTINCT video_id || ':' || floor(timestamp/5)::BIGINT AS segment_id, label, CASE action_id%4 WHEN 0 THEN 'manual_annotation' ELSE source_method END AS source_method FROM actions),
n AS (SELECT segment_id, label, source_method FROM o WHERE source_method <> 'manual_annotation' UNION ALL SELECT DISTINCT segment_id, 'wave', 'manual_annotation' FROM o WHERE label = 'sit')
SELECT segment_id, source_method, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM n GROUP BY 1, 2"""
)


def j9_thumbnails(spark, sf_dir):
    """Each utterance's start with the nearest frame of its video, however far."""
    points = frame(spark, sf_dir, "transcripts").select("video_id", F.col("utterance_id").alias("point_id"), F.col("start_time").alias("time"))
    frames = frame(spark, sf_dir, "detections").groupBy("video_id", F.col("timestamp").alias("time")).agg(F.min("frame_id").alias("frame_id"))
    return align.nearest(points, frames).select("point_id", "frame_id", rounded("gap").alias("gap"))


J9 = (
    with_frames("detections", "transcripts")
    + """, f AS (SELECT video_id, timestamp AS t, min(frame_id) AS frame_id FROM detections GROUP BY 1, 2),
c AS (SELECT u.utterance_id, f.frame_id, abs(f.t - u.start_time) AS gap, row_number() OVER (PARTITION BY u.utterance_id ORDER BY abs(f.t - u.start_time), f.t) AS rn FROM transcripts u JOIN f ON f.video_id = u.video_id)
SELECT t.utterance_id AS point_id, frame_id, round(gap, 4) AS gap FROM transcripts t LEFT JOIN c ON c.utterance_id = t.utterance_id AND rn = 1"""
)


def _known_tracks(spark, sf_dir):
    return frame(spark, sf_dir, "appearances").select("appearance_id", "video_id", F.col("track").cast("string").alias("track_id"))


def j18_attached_appearances(spark, sf_dir):
    a = _known_tracks(spark, sf_dir)
    d = a.select(F.col("appearance_id").alias("detection_id"), F.when(F.col("appearance_id") % 3 == 0, F.col("appearance_id") + 1).alias("appearance_id"), "video_id", "track_id")
    return appearance.attached(d, a).select("detection_id", "appearance_id")


J18 = (
    with_frames("appearances")
    + """, a AS (SELECT appearance_id, video_id, track::VARCHAR AS track_id FROM appearances), t AS (SELECT video_id, track_id, min(appearance_id) AS of_track FROM a GROUP BY 1, 2),
d AS (SELECT appearance_id AS detection_id, CASE WHEN appearance_id%3=0 THEN appearance_id + 1 END AS own, video_id, track_id FROM a)
SELECT detection_id, coalesce(a.appearance_id, of_track) AS appearance_id FROM d LEFT JOIN a ON a.appearance_id = d.own LEFT JOIN t ON t.video_id = d.video_id AND t.track_id = d.track_id"""
)


def j28_tracks_to_compute(spark, sf_dir):
    tracks = _known_tracks(spark, sf_dir).select("video_id", "track_id").distinct()
    cached = _known_tracks(spark, sf_dir).filter("appearance_id%2=0").select("video_id", "track_id", F.expr("CASE appearance_id%3 WHEN 0 THEN 'old' ELSE 'clip' END").alias("model"), F.lit("1").alias("version"))
    return appearance.to_compute(tracks, cached, "clip", "1")


J28 = with_frames("appearances") + ", a AS (SELECT appearance_id, video_id, track::VARCHAR AS track_id FROM appearances) SELECT video_id, track_id FROM a EXCEPT SELECT video_id, track_id FROM a WHERE appearance_id%2=0 AND appearance_id%3<>0"


def p15_foreign_labels(spark, sf_dir):
    """Labels of outside plans that the vocabulary of the observed actions doesn't allow."""
    p = frame(spark, sf_dir, "plans").select("query_id", F.lit("action").alias("kind"), F.explode(F.split(F.concat_ws(",", "action_list", F.expr("CASE query_id%7 WHEN 0 THEN 'fly' END")), ",")).alias("label")).filter("label <> ''")
    allowed = frame(spark, sf_dir, "actions").select(F.lit("action").alias("kind"), "label").distinct()
    return tagging.foreign_labels(p, allowed).select("query_id", "label")


P15 = with_frames("plans", "actions") + ", p AS (SELECT query_id, unnest(string_split(action_list, ',')) AS label FROM plans UNION ALL SELECT query_id, 'fly' FROM plans WHERE query_id%7=0) SELECT query_id, label FROM p WHERE label <> '' AND label NOT IN (SELECT label FROM actions)"


def f2_screen_texts(spark, sf_dir):
    """Whole texts as normalised screen text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    t = texts.normalized_ocr(F.col("text"))
    return d.select("doc_id", F.length(t).cast("long").alias("length"), F.md5(t).alias("digest"))


def f20_names(spark, sf_dir):
    a = frame(spark, sf_dir, "actions").select("label").distinct()
    path = F.concat(F.lit("/media/"), "label", F.lit(".v1.mp4"))
    return a.select("label", texts.relation_name(F.col("label")).alias("relation"), texts.slug(F.col("label")).alias("slug"), texts.file_stem(path).alias("stem"))


F20 = with_frames("actions") + " SELECT DISTINCT label, trim(regexp_replace(upper(trim(label)), '[^A-Z0-9]+', '_', 'g'), '_') AS relation, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g')) AS slug, regexp_replace(regexp_extract('/media/' || label || '.v1.mp4', '[^/\\\\]*$'), '[.][^.]*$', '') AS stem FROM actions"

QUERIES = {
    f.__name__: f
    for f in (
        s1_fused_documents, s2_annotation_rows, s4_rttm_turns, s5_cues, s6_speaker_rows, s7_transcripts, s8_relation_documents, s9_relevance_manifest, s12_listed_videos, s17_overlay, j9_thumbnails, j18_attached_appearances,
        j28_tracks_to_compute, p15_foreign_labels, f2_screen_texts, f20_names,
    )
}
ORACLES = {
    "s1_fused_documents": S1, "s2_annotation_rows": S2, "s4_rttm_turns": S4, "s5_cues": S5, "s6_speaker_rows": S6, "s7_transcripts": S7, "s8_relation_documents": S8, "s9_relevance_manifest": S9, "s12_listed_videos": S12, "s17_overlay": S17,
    "j9_thumbnails": J9, "j18_attached_appearances": J18, "j28_tracks_to_compute": J28, "p15_foreign_labels": P15, "f20_names": F20,
}
