"""Alignment in time: interval, point and nearest joins, and evidence in fixed windows.

No join has a bare range predicate: one side is laid on buckets of time (an interval on each bucket it
touches), the join is by bucket, and the exact condition follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import overlap

BUCKET_SECONDS = 5.0


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def on_buckets(df: DataFrame, start: str, end: str, width: float, name: str = "bucket") -> DataFrame:
    """A row for each bucket that [start, end] touches."""
    return df.withColumn(name, F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.greatest(start, end), width))))


def overlapping(left: DataFrame, right: DataFrame, key: str = "video_id", width: float = BUCKET_SECONDS) -> DataFrame:
    """Pairs whose intervals (start_time, end_time) overlap by more than nothing, once each, with ``overlap``.

    Right columns other than the key get the prefix ``r_``.
    """
    r = right.select(key, *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    both = on_buckets(left, "start_time", "end_time", width).join(on_buckets(r, "r_start_time", "r_end_time", width), [key, "bucket"])
    first = _bucket(F.greatest("start_time", "r_start_time"), width)  # each pair only in the first bucket that both touch
    shared = overlap(F.col("start_time"), F.col("end_time"), F.col("r_start_time"), F.col("r_end_time"))
    return both.filter(F.col("bucket") == first).withColumn("overlap", shared).filter("overlap > 0").drop("bucket")


def assign_speakers(transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """Each utterance with the speaker whose turn overlaps it most (the first turn on ties), else UNKNOWN."""
    pairs = overlapping(transcripts.select("utterance_id", "video_id", "start_time", "end_time"), turns)
    best = pairs.groupBy("utterance_id").agg(F.max_by("r_speaker", F.struct("overlap", -F.col("r_turn_id"))).alias("speaker"))
    return transcripts.join(best, "utterance_id", "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def audio_in_frames(frames: DataFrame, audio: DataFrame, seconds: float = 1.0) -> DataFrame:
    """frames: video_id, timestamp. The audio rows that overlap [timestamp, timestamp + seconds), in order."""
    spans = frames.select("video_id", F.col("timestamp").alias("start_time"), (F.col("timestamp") + seconds).alias("end_time"))
    found = overlapping(spans, audio).groupBy("video_id", F.col("start_time").alias("timestamp"))
    return found.agg(F.sort_array(F.collect_list("r_utterance_id")).alias("utterances"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str = "video_id", time: str = "timestamp", width: float = BUCKET_SECONDS) -> DataFrame:
    """Pairs with start_time <= time <= end_time, both ends closed."""
    spread = on_buckets(intervals, "start_time", "end_time", width)
    placed = points.withColumn("bucket", _bucket(F.col(time), width))
    return placed.join(spread, [key, "bucket"]).filter(F.col(time).between(F.col("start_time"), F.col("end_time"))).drop("bucket")


def nearest(points: DataFrame, frames: DataFrame, key: str = "video_id", tolerance: float | None = None) -> DataFrame:
    """points: key, point_id, time; frames: key, frame_id, time. The frame nearest in time (the earlier on ties), or null.

    Both sides are sorted once by key and time; the last frame before and the first after are carried to each point.
    """
    marks = points.select(key, "time", F.col("point_id"), F.lit(None).cast(frames.schema["frame_id"].dataType).alias("frame_id")).withColumn("kind", F.lit(1))
    marks = marks.unionByName(frames.select(key, "time", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), "frame_id").withColumn("kind", F.lit(0)))
    of_frame = F.when(F.col("kind") == 0, F.struct("time", "frame_id"))
    order = Window.partitionBy(key).orderBy("time", "kind", "frame_id")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = marks.withColumns({"b": F.last(of_frame, True).over(back), "a": F.first(of_frame, True).over(ahead)}).filter("kind = 1")
    gap_b, gap_a = F.col("time") - F.col("b.time"), F.col("a.time") - F.col("time")
    chosen = F.when(F.col("b").isNotNull() & (F.col("a").isNull() | (gap_b <= gap_a)), F.struct(gap_b.alias("gap"), F.col("b.frame_id").alias("frame_id"))).when(F.col("a").isNotNull(), F.struct(gap_a.alias("gap"), F.col("a.frame_id").alias("frame_id")))
    if tolerance is not None:
        chosen = F.when(chosen["gap"] <= tolerance, chosen)
    return seen.withColumn("chosen", chosen).select(key, "point_id", "time", F.col("chosen.frame_id").alias("frame_id"), F.col("chosen.gap").alias("gap"))


# ---- fixed windows ----


def spine(ends: DataFrame, seconds: float = 5.0) -> DataFrame:
    """ends: video_id, end_time of any evidence. Segments video_id, idx, n_segments, start_time, end_time, segment_id of each video."""
    last = F.greatest(F.lit(seconds), F.coalesce(F.max("end_time"), F.lit(0.0)))
    videos = ends.groupBy("video_id").agg(last.alias("duration"))
    videos = videos.withColumn("n_segments", F.greatest(F.lit(1), F.ceil(F.col("duration") / seconds)).cast("long"))
    cut = videos.select("video_id", "duration", "n_segments", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_segments") - 1)).alias("idx"))
    start = F.col("idx") * seconds
    cut = cut.withColumns({"start_time": start, "end_time": F.least(F.col("duration"), start + seconds)})
    cut = cut.withColumn("end_time", F.when(F.col("end_time") <= F.col("start_time"), F.col("start_time") + seconds).otherwise(F.col("end_time")))
    return cut.withColumn("segment_id", segment_id()).drop("duration")


def segment_id(start: str = "start_time", end: str = "end_time") -> Column:
    return F.concat_ws(":", "video_id", F.round(F.col(start) * 1000).cast("long"), F.round(F.col(end) * 1000).cast("long"))


def _clamped(t: Column, n: Column, seconds: float) -> Column:
    return F.least(n - 1, F.greatest(F.lit(0).cast("long"), _bucket(t, seconds)))


def _lasting(segments: DataFrame) -> DataFrame:
    """video_id, n_segments and the end of a video's last segment: all that placing a row needs, a row a video."""
    return segments.filter("idx = n_segments - 1").select("video_id", "n_segments", F.col("end_time").alias("last_end"))


def _bounded(placed: DataFrame, seconds: float) -> DataFrame:
    """The segment of each row by its number, as ``spine`` cuts it, so that rows needn't be joined (and dealt out) once more."""
    start = F.col("idx") * seconds
    end = F.least("last_end", start + seconds)
    bounds = placed.withColumn("segment_start", start).withColumn("segment_end", F.when(end <= start, start + seconds).otherwise(end)).drop("n_segments", "last_end")
    return bounds.withColumn("segment_id", segment_id("segment_start", "segment_end"))


def place_points(df: DataFrame, segments: DataFrame, seconds: float = 5.0, time: str = "timestamp") -> DataFrame:
    """Each row with the segment that holds its time; a time at or past the end goes to the last one. Rows are dealt out once, by video_id."""
    return _bounded(df.join(_lasting(segments), "video_id").withColumn("idx", _clamped(F.col(time), F.col("n_segments"), seconds)), seconds)


def place_intervals(df: DataFrame, segments: DataFrame, seconds: float = 5.0, positive: bool = False) -> DataFrame:
    """Each row with every segment its interval touches; with ``positive`` only those it overlaps by more than nothing."""
    first = _clamped(F.col("start_time"), F.col("n_segments"), seconds)
    last = _clamped(F.greatest(F.col("start_time"), F.col("end_time") - 1e-9), F.col("n_segments"), seconds)
    placed = df.join(_lasting(segments), "video_id").withColumn("idx", F.explode(F.sequence(first, last)))
    if positive:
        start = F.col("idx") * seconds
        placed = placed.filter(F.least(start + seconds, F.col("end_time")) - F.greatest(start, F.col("start_time")) > 0)
    return _bounded(placed, seconds)


def action_rollup(placed: DataFrame, *also: str) -> DataFrame:
    """Per segment and label: best known confidence, source of the last observation, observations. also: columns that a segment determines."""
    return placed.groupBy(*also, "segment_id", F.lower("label").alias("label")).agg(F.max("confidence").alias("confidence"), F.max_by("source_method", "action_id").alias("source_method"), F.count(F.lit(1)).alias("n"))


def build_segments(detections: DataFrame, transcripts: DataFrame, actions: DataFrame, ocr: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Evidence in fixed windows: sorted entity, action and speaker sets, the joined transcript, counts of each modality.

    detections and actions have timestamps, transcripts (with speakers) and ocr intervals.
    """
    ends = detections.select("video_id", F.col("timestamp").alias("end_time"))
    for df, column in ((transcripts, "end_time"), (actions, "timestamp"), (ocr, "end_time")):
        ends = ends.union(df.select("video_id", F.col(column).alias("end_time")))
    segments = spine(ends, seconds)
    seen = place_points(detections, segments, seconds).groupBy("segment_id").agg(F.sort_array(F.collect_set(F.lower("class_label"))).alias("entities"), F.count(F.lit(1)).alias("n_detections"))
    done = place_points(actions, segments, seconds).groupBy("segment_id").agg(F.sort_array(F.collect_set(F.lower("label"))).alias("actions"))
    said = place_intervals(transcripts, segments, seconds, positive=True).groupBy("segment_id")
    line = F.transform(F.sort_array(F.collect_list(F.struct("utterance_id", F.trim("text").alias("t")))), lambda x: x["t"])
    said = said.agg(F.array_join(F.filter(line, lambda t: t != ""), " ").alias("transcript"), F.sort_array(F.collect_set(F.when(F.col("speaker") != "UNKNOWN", F.col("speaker")))).alias("speakers"))
    read = place_intervals(ocr, segments, seconds).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_ocr"))
    out = segments
    for part in (seen, done, said, read):
        out = out.join(part, "segment_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "segment_id", "video_id", "idx", "start_time", "end_time", *(F.coalesce(c, none).alias(c) for c in ("entities", "actions", "speakers")), F.coalesce("transcript", F.lit("")).alias("transcript"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_detections", "n_ocr"))
    )


def segment_document(segments: DataFrame) -> DataFrame:
    """One searchable text per segment: transcript, entities and actions."""
    return segments.select("segment_id", "video_id", F.concat_ws(" ", "transcript", F.array_join("entities", " "), F.array_join("actions", " ")).alias("document"))


def whole_document(segments: DataFrame, relations: DataFrame, readings: DataFrame) -> DataFrame:
    """One searchable text per segment: transcript, entities, actions, the predicate of each relation and each on-screen text, in order.

    relations: segment_id, timestamp, relationship_id, predicate; readings: segment_id, token_id, text.
    """
    def joined(rows: DataFrame, order: tuple[str, ...], value: str, name: str) -> DataFrame:
        return rows.groupBy("segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda x: x["v"]), " ").alias(name))

    parts = segments.join(joined(relations, ("timestamp", "relationship_id"), "predicate", "predicates"), "segment_id", "left").join(joined(readings, ("token_id",), "text", "seen"), "segment_id", "left")
    blank = lambda c: F.when(F.length(c) > 0, c)
    return parts.select("segment_id", "video_id", F.concat_ws(" ", blank(F.col("transcript")), blank(F.array_join("entities", " ")), blank(F.array_join("actions", " ")), "predicates", blank(F.col("seen"))).alias("document"))


def matched_windows(labels: DataFrame, segments: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Labelled windows joined to segments whose start and end both lie within the tolerance."""
    spread = labels.withColumn("cell", F.explode(F.sequence(_bucket(F.col("label_start") - tolerance, tolerance), _bucket(F.col("label_start") + tolerance, tolerance))))
    cells = segments.withColumn("cell", _bucket(F.col("start_time"), tolerance))
    near = (F.abs(F.col("label_start") - F.col("start_time")) <= tolerance) & (F.abs(F.col("label_end") - F.col("end_time")) <= tolerance)
    return spread.join(cells, ["video_id", "cell"]).filter(near).drop("cell")
