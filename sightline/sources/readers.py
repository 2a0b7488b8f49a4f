"""Evidence files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fused per-video document: frames with nodes and edges, and audio segments.
FUSED = """
video_id string, frames array<struct<timestamp: double, width: int, height: int,
  nodes: array<struct<id: string, label: string, confidence: double, bbox: array<double>, actions: array<string>>>,
  edges: array<struct<source: string, target: string, predicate: string, confidence: double>>,
  audio_segments: array<struct<start: double, `end`: double, speaker: string, text: string>>>>
"""
ANNOTATION = "video_id string, timestamp_text string, x1 double, y1 double, x2 double, y2 double, action_text string, entity_id string"


#: Documents are files each, read whole, or a line each (``whole_files=False``), so that a large collection is read by ranges.


def fused_json(spark: SparkSession, path: str, whole_files: bool = True) -> dict[str, DataFrame]:
    """detections, relations, actions and transcripts of fused per-video JSON files."""
    frames = spark.read.schema(FUSED).option("multiLine", whole_files).json(path).select("video_id", F.posexplode("frames").alias("frame_index", "f"))
    frames = frames.withColumn("frame_id", F.concat_ws(":", "video_id", F.col("f.timestamp").cast("string")))
    nodes = frames.select("video_id", "frame_id", F.col("f.timestamp").alias("timestamp"), F.explode("f.nodes").alias("n"))
    box = [F.element_at("n.bbox", i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return {
        "detections": nodes.select("video_id", "frame_id", "timestamp", F.col("n.id").alias("detection_id"), F.col("n.label").alias("class_label"), "n.confidence", *box),
        "actions": nodes.select("video_id", "timestamp", F.col("n.id").alias("detection_id"), F.explode("n.actions").alias("label")),
        "relations": frames.select("video_id", "frame_id", F.col("f.timestamp").alias("timestamp"), F.explode("f.edges").alias("e")).select("video_id", "frame_id", "timestamp", F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"), "e.predicate", "e.confidence"),
        "transcripts": frames.select("video_id", F.explode("f.audio_segments").alias("a")).select("video_id", F.col("a.start").alias("start_time"), F.col("a.end").alias("end_time"), "a.speaker", "a.text").distinct(),
    }


def annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless person-action rows; malformed times or labels drop the row."""
    rows = spark.read.schema(ANNOTATION).option("mode", "PERMISSIVE").csv(path)
    typed = rows.withColumns({"timestamp": F.expr("try_cast(timestamp_text AS double)"), "action_id": F.expr("try_cast(action_text AS int)")})
    return typed.drop("timestamp_text", "action_text").dropna(subset=["video_id", "timestamp", "action_id"])


def rttm_turns(spark: SparkSession, path: str) -> DataFrame:
    """Speaker turns of RTTM lines; the video is the file's name."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.rttm)?$", 1).alias("video_id")).filter("c[0] = 'SPEAKER' and size(c) >= 8")
    start, length = F.expr("try_cast(c[3] AS double)"), F.expr("try_cast(c[4] AS double)")
    return lines.select("video_id", start.alias("start_time"), (start + length).alias("end_time"), F.col("c")[7].alias("speaker")).dropna(subset=["start_time", "end_time"])


def _clock(text: Column) -> Column:
    part = lambda i: F.expr("double(0)") + F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)", i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def srt_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT files: start, end and text; a text ``SPEAKER_nn: ...`` also names the speaker."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select("value", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\..*)?$", 1).alias("video_id"))
    cue = F.regexp_extract("value", r"([\d:,.]+)\s*-->\s*([\d:,.]+)", 1), F.regexp_extract("value", r"([\d:,.]+)\s*-->\s*([\d:,.]+)", 2)
    text = F.trim(F.regexp_extract("value", r"(?s)-->[^\n]*\n(.*)$", 1))
    found = blocks.filter(F.col("value").contains("-->")).select("video_id", _clock(cue[0]).alias("start_time"), _clock(cue[1]).alias("end_time"), text.alias("text"))
    return found.withColumn("speaker", F.nullif(F.regexp_extract("text", r"^(SPEAKER_\d+)", 1), F.lit("")))


def srt_text(turns: DataFrame) -> DataFrame:
    """The reverse: one numbered cue per turn in time order, ``value`` ready for a text sink."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    stamp = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms(c) / 3600000), F.floor(ms(c) / 60000) % 60, F.floor(ms(c) / 1000) % 60, ms(c) % 1000)
    order = Window.partitionBy("video_id").orderBy("start_time", "end_time", "speaker")
    numbered = turns.withColumn("n", F.row_number().over(order))
    return numbered.select("video_id", "n", F.concat(F.col("n").cast("string"), F.lit("\n"), stamp("start_time"), F.lit(" --> "), stamp("end_time"), F.lit("\n"), F.col("speaker"), F.lit("\n")).alias("value"))


def transcript_json(spark: SparkSession, path: str, whole_files: bool = True) -> dict[str, DataFrame]:
    """Utterances with confidence exp(min(0, avg_logprob)) * (1 - no_speech_prob), and their words."""
    schema = "video_id string, segments array<struct<start: double, `end`: double, text: string, avg_logprob: double, no_speech_prob: double, words: array<struct<word: string, start: double, `end`: double, probability: double>>>>"
    rows = spark.read.schema(schema).option("multiLine", whole_files).json(path).select("video_id", F.posexplode("segments").alias("ord", "s"))
    surety = F.exp(F.least(F.lit(0.0), "s.avg_logprob")) * (1 - F.coalesce("s.no_speech_prob", F.lit(0.0)))
    start = F.greatest(F.lit(0.0), F.col("s.start"))
    utterances = rows.select("video_id", "ord", start.alias("start_time"), F.greatest(start, F.col("s.end")).alias("end_time"), F.trim("s.text").alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), surety)).alias("confidence"))
    words = rows.select("video_id", "ord", F.posexplode("s.words").alias("word_ord", "w")).select("video_id", "ord", "word_ord", F.trim("w.word").alias("word"), F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "w.probability")
    return {"utterances": utterances, "words": words}


def relation_json(spark: SparkSession, path: str, whole_files: bool = True) -> dict[str, DataFrame]:
    """Trajectories (frame, object, box) and relation instances of relation annotation files."""
    schema = """video_id string, `subject/objects` array<struct<tid: int, category: string>>,
      trajectories array<array<struct<tid: int, bbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>, generated: int>>>,
      relation_instances array<struct<subject_tid: int, object_tid: int, predicate: string, begin_fid: int, end_fid: int>>"""
    rows = spark.read.schema(schema).option("multiLine", whole_files).json(path)
    objects = rows.select("video_id", F.explode("subject/objects").alias("o")).select("video_id", "o.tid", "o.category")
    seen = rows.select("video_id", F.posexplode("trajectories").alias("frame", "t")).select("video_id", "frame", F.explode("t").alias("o"))
    seen = seen.select("video_id", "frame", "o.tid", *(F.col(f"o.bbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))), F.when(F.col("o.generated") == 1, 0.5).otherwise(1.0).alias("weight"))
    return {"objects": objects, "trajectories": seen, "relations": rows.select("video_id", F.explode("relation_instances").alias("r")).select("video_id", "r.*")}


def relevance_manifest(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """query_id, query, category, negative, tolerance and one row per relevant moment (none for a negative query)."""
    schema = "queries array<struct<id: string, query: string, category: string, negative: boolean, tolerance_seconds: double, source_video_id: string, relevant: array<struct<start_time: double, end_time: double, peak_time: double>>>>"
    rows = spark.read.schema(schema).option("multiLine", whole_files).json(path).select(F.explode("queries").alias("q"))
    flat = rows.select(F.col("q.id").alias("query_id"), "q.query", "q.category", F.coalesce("q.negative", F.lit(False)).alias("negative"), F.coalesce("q.tolerance_seconds", F.lit(2.0)).alias("tolerance"), F.col("q.source_video_id").alias("video_id"), F.posexplode_outer("q.relevant").alias("moment", "m"))
    return flat.select("query_id", "query", "category", "negative", "tolerance", "video_id", "moment", "m.*")


def first_of_each_content(media: DataFrame, content: str = "sha", order: tuple[str, ...] = ("uploaded", "video_id")) -> DataFrame:
    """Media with the id of the first upload of the same content, and whether it is that one."""
    first = F.min(F.struct(*order)).over(Window.partitionBy(content))
    return media.withColumn("first_id", first[order[-1]]).withColumn("is_first", F.col("first_id") == F.col(order[-1]))


def listed(rows: DataFrame, wanted: DataFrame | None = None, key: str = "video_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows of the wanted ids (all, if none are named), and the wanted ids that the table doesn't have."""
    if wanted is None:
        return rows, None
    return rows.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(rows.select(key), key, "left_anti")
