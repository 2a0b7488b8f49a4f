"""Ordered state: greedy tracking, merging of on-screen text, motion and temporal pooling.

Tracking depends on the order of observations within a class of a video, merging of texts on that within a video. Rows are sorted
by Spark and pass by a state machine that holds only what is still live, so a task's memory doesn't grow with a
video. Nothing outlives a gap above ``max_gap``, so what lies between such gaps is dealt to tasks apart; numbers that run through a
video are made whole afterwards from first rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import area, box, centre
from sightline.functions.text import normalized_ocr, stable_id, three_places
from sightline.operators.following import AnchoredTracks, BoxRules, BoxTracks, Reading, TextTracks, measured, signatures


def with_stretches(df: DataFrame, max_gap: float, key: Sequence[str] = ("video_id",), time: str = "timestamp") -> DataFrame:
    """``stretch`` (long) numbers the runs of a key's rows that no gap above ``max_gap`` interrupts."""
    order = Window.partitionBy(*key).orderBy(time)
    times = df.select(*key, time).distinct().withColumn("new", F.coalesce((F.col(time) - F.lag(time).over(order) > max_gap).cast("long"), F.lit(0)))
    times = times.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")
    return df.join(times, [*key, time])


def _changes(*columns) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _whole_frames(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where the first ``keys`` columns change, so that no frame is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        if rows:
            last = int(np.flatnonzero(_changes(*(_codes(rows[0].column(k)) for k in range(keys))))[-1])
            if last:
                yield rows[0].slice(0, last)
            held = [rows[0].slice(last)]
    if held and len(held[0]):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_NUMBERED = "video_id string, label string, stretch long, detection_id long, number long, first boolean"


def _numbered(rules: BoxRules):
    """Rows in order of (video, label, stretch, time, id): the number of each one's track in its stretch, and whether it begins it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tracks = None, BoxTracks(rules)
        for rows in _whole_frames(batches, 4):
            video, label, stretch = (_codes(rows.column(k)) for k in range(3))
            time = rows.column(3).to_numpy(zero_copy_only=False)
            boxes = measured(np.column_stack([rows.column(k).to_numpy(zero_copy_only=False) for k in range(5, 9)]))
            begins = np.flatnonzero(_changes(video, label, stretch, time))
            numbers, first = np.empty(len(rows), np.int64), np.empty(len(rows), bool)
            for lo, hi in zip(begins, [*begins[1:], len(rows)]):
                here = tuple(rows.column(k)[lo].as_py() for k in range(3)) if lo == 0 or (video[lo], label[lo], stretch[lo]) != (video[lo - 1], label[lo - 1], stretch[lo - 1]) else at
                if here != at:
                    at, tracks = here, BoxTracks(rules)
                made = tracks.made
                numbers[lo:hi] = tracks.frame(time[lo], boxes[lo:hi])
                first[lo:hi] = numbers[lo:hi] >= made
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], rows.column(4), pa.array(numbers), pa.array(first)], ["video_id", "label", "stretch", "detection_id", "number", "first"])

    return run


def track(detections: DataFrame, iou_least: float = 0.3, reach: float = 0.15, max_gap: float = 1.5) -> DataFrame:
    """detections with ``track_id`` (and ``ordinal``, the track's number in its video).

    A class is followed apart from the others. A track's ordinal counts the video's tracks by their first rows; its id hashes video, class and ordinal.
    """
    rules = BoxRules(iou_least, reach, max_gap).checked()
    key = ["video_id", "label", "stretch"]
    rows = with_stretches(detections.withColumn("label", F.lower(F.trim("class_label"))), max_gap, ("video_id", "label"))
    rows = rows.select(*key, "timestamp", "detection_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    numbered = rows.repartition(*key).sortWithinPartitions(*key, "timestamp", "detection_id").mapInArrow(_numbered(rules), _NUMBERED)
    begun = numbered.filter("first").join(detections.select("detection_id", "timestamp"), "detection_id")
    order = Window.partitionBy("video_id").orderBy("timestamp", "detection_id")
    ordinals = begun.select(*key, "number", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))
    named = detections.join(numbered.join(ordinals, [*key, "number"]).select("detection_id", "ordinal"), "detection_id")
    return named.withColumn("track_id", stable_id("trk", F.col("video_id"), F.lower(F.trim("class_label")), F.col("ordinal").cast("string")))


def _anchored(overlap: float, gap: float):
    """Rows in order of (video, time, id): each one's track."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tracks = None, AnchoredTracks(overlap, gap)
        for rows in _whole_frames(batches, 2):
            video, names = rows.column(0).to_pylist(), rows.column(3).to_pylist()
            time = rows.column(1).to_numpy(zero_copy_only=False)
            boxes = measured(np.column_stack([rows.column(k).to_numpy(zero_copy_only=False) for k in range(4, 8)]))
            begins, found = np.flatnonzero(_changes(_codes(rows.column(0)), time)), []
            for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
                if video[lo] != at:
                    at, tracks = video[lo], AnchoredTracks(overlap, gap)
                found += [f"{at}:{t}" if isinstance(t, str) else f"{at}:local:{t}" for t in tracks.frame(time[lo], names[lo:hi], boxes[lo:hi])]
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(found, pa.string())], ["detection_id", "track_id"])

    return run


def local_tracks(persons: DataFrame, overlap: float = 0.3, gap: float = 2.1) -> DataFrame:
    """persons: video_id, timestamp, detection_id (long), annotated (null: no annotation), box. detection_id, track_id.

    Annotated persons keep their id; others join the track that they overlap most, seen at most ``gap`` seconds before, in order of their ids.
    """
    rows = persons.select("video_id", F.col("timestamp").cast("double").alias("timestamp"), "detection_id", "annotated", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return rows.repartition("video_id").sortWithinPartitions("video_id", "timestamp", "detection_id").mapInArrow(_anchored(overlap, gap), "detection_id long, track_id string")


MERGED = "video_id string, text string, start_time double, end_time double, confidence double, observations long"
_MERGED = pa.schema([("video_id", pa.string()), ("text", pa.string()), ("start_time", pa.float64()), ("end_time", pa.float64()), ("confidence", pa.float64()), ("observations", pa.int64())])


def as_merged(video: str, gone: Sequence[Reading], interval: float) -> list[dict]:
    return [{"video_id": video, "text": r.text, "start_time": r.start, "end_time": r.last + interval, "confidence": r.total / r.count, "observations": r.count} for r in gone]


def _merged(interval: float, similarity: float):
    """Rows (video, stretch, time, id, text, confidence) in order: the texts that were on the screen, each when it is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts = None, TextTracks(interval * 1.5, similarity)
        for batch in batches:
            out: list[dict] = []
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
            for (video, stretch, time, text, confidence), signature in zip(zip(*columns), signatures(columns[3])):
                if (video, stretch) != at:
                    out += as_merged(at[0], texts.live, interval) if at else []
                    at, texts = (video, stretch), TextTracks(interval * 1.5, similarity)
                out += as_merged(video, texts.expired(time), interval)
                texts.read(time, text, signature, confidence)
            yield pa.RecordBatch.from_pylist(out, _MERGED)
        if at:
            yield pa.RecordBatch.from_pylist(as_merged(at[0], texts.live, interval), _MERGED)

    return run


def ocr_readings(tokens: DataFrame, least_confidence: float = 0.35) -> DataFrame:
    """The readings that are merged: token_id, video_id, timestamp, text (normalised), confidence."""
    read = tokens.select("token_id", "video_id", "timestamp", normalized_ocr(F.col("raw_text")).alias("text"), F.col("raw_confidence").alias("confidence"), *(["ts"] if "ts" in tokens.columns else []))
    return read.filter((F.length("text") >= 2) & (F.col("confidence") >= least_confidence))


def merge_ocr(tokens: DataFrame, sample_rate: float = 1.0, least_confidence: float = 0.35, similarity: float = 0.9) -> DataFrame:
    """Readings of one on-screen text merged over time: a reading joins the latest text seen within 1.5 sample intervals that is similar enough."""
    interval = 1.0 / max(sample_rate, 0.001)
    key = ["video_id", "stretch"]
    read = with_stretches(ocr_readings(tokens, least_confidence), interval * 1.5).select(*key, "timestamp", "token_id", "text", F.col("confidence").cast("double").alias("confidence"))
    merged = read.repartition(*key).sortWithinPartitions(*key, "timestamp", "token_id").mapInArrow(_merged(interval, similarity), MERGED)
    return with_ocr_id(merged)


def with_ocr_id(merged: DataFrame) -> DataFrame:
    return merged.withColumn("ocr_id", stable_id("ocr", F.col("text"), three_places(F.col("start_time"))))


def motion(detections: DataFrame, key: str = "track_id") -> DataFrame:
    """Centre velocity and log-area change to the track's previous and next observation; time since its first; its duration."""
    order = Window.partitionBy("video_id", key).orderBy("timestamp", "detection_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, y = centre(box())
    size = F.log(F.greatest(area(box()), F.lit(1e-6)))
    placed = detections.select("video_id", key, "detection_id", "timestamp", x.alias("cx"), y.alias("cy"), size.alias("la"))

    def change(column: str, near, sign: int):
        other = near(column).over(order)
        span = (F.col("timestamp") - near("timestamp").over(order)) * sign
        return F.coalesce((F.col(column) - other) * sign / F.greatest(span, F.lit(1e-6)), F.lit(0.0))

    out = {f"{name}_{c}": change(c, near, sign) for name, near, sign in (("prev", F.lag, 1), ("next", F.lead, -1)) for c in ("cx", "cy", "la")}
    return placed.withColumns(out | {"since_first": F.col("timestamp") - F.min("timestamp").over(whole), "duration": F.max("timestamp").over(whole) - F.min("timestamp").over(whole)})


def pooled(vectors: DataFrame, max_gap: float = 2.1) -> DataFrame:
    """vectors: video_id, time, vector. .25 previous + .5 own + .25 next + .25 (next - previous), neighbours within the gap else own; L2-normalised."""
    order = Window.partitionBy("video_id").orderBy("time")
    near = lambda f: F.when(F.abs(f("time").over(order) - F.col("time")) <= max_gap, f("vector").over(order))
    sides = vectors.withColumns({"p": F.coalesce(near(F.lag), F.col("vector")), "n": F.coalesce(near(F.lead), F.col("vector"))})
    around = F.zip_with("p", "n", lambda p, n: 0.25 * p.cast("double") + 0.25 * n.cast("double") + 0.25 * (n.cast("double") - p.cast("double")))
    mixed = F.zip_with(around, "vector", lambda s, v: s + 0.5 * v.cast("double"))
    norm = F.sqrt(F.aggregate("mixed", F.lit(0.0), lambda s, v: s + v * v))
    return sides.withColumn("mixed", mixed).withColumn("norm", norm).select("video_id", "time", F.transform("mixed", lambda v: v / F.greatest(F.col("norm"), F.lit(1e-12))).alias("vector"))


def three_steps(vectors: DataFrame) -> DataFrame:
    """[previous, own, next] vectors of a track; at its ends the own vector stands in."""
    order = Window.partitionBy("video_id").orderBy("time")
    return vectors.select("video_id", "time", F.array(F.coalesce(F.lag("vector").over(order), "vector"), F.col("vector"), F.coalesce(F.lead("vector").over(order), "vector")).alias("steps"))


def best_observations(detections: DataFrame, k: int = 6) -> DataFrame:
    """Per track the k best observations by confidence times the root of the box's area, then time and id."""
    order = Window.partitionBy("video_id", "track_id").orderBy(F.desc(F.col("confidence") * F.sqrt(area(box()))), "timestamp", "detection_id")
    return detections.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
