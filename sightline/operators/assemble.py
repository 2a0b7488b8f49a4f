"""Merging, filtering, ranking and reporting over evidence tables, and node features for graph data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mapped_labels(rows: DataFrame, mapping: DataFrame, column: str = "class_label") -> DataFrame:
    """mapping: words, canonical (a fixed vocabulary). Rows with the label's counterpart in another vocabulary; unmapped rows go."""
    return rows.join(F.broadcast(mapping.select(F.col("words").alias(column), F.col("canonical").alias("mapped_label"))), column)


def fit_for_crops(detections: DataFrame, least_confidence: float, least_side: float, classes: Sequence[str]) -> DataFrame:
    """Detections of supported classes that are sure and large enough to be looked at in detail."""
    wide, high = F.col("x2") - F.col("x1") >= least_side, F.col("y2") - F.col("y1") >= least_side
    return detections.filter((F.col("confidence") >= least_confidence) & wide & high & F.col("class_label").isin(*classes))


def scoped(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the chosen ones; a null key is never chosen."""
    return rows.join(ids.select(key), key, "left_semi")


def keyed_merge(fresh: DataFrame, preserved: DataFrame, key: str = "video_id", time: str = "start_time") -> DataFrame:
    """Fresh rows with the columns of the preserved row of the same key and millisecond; of several that of the least time."""
    at = F.floor(F.col(time) * 1000 + 0.5).cast("long")
    others = [c for c in preserved.columns if c not in (key, time)]
    kept = preserved.groupBy(key, at.alias("at")).agg(F.min_by(F.struct(*others), time).alias("kept"))
    return fresh.withColumn("at", at).join(kept, [key, "at"], "left").select(*fresh.columns, *(F.col(f"kept.{c}").alias(c) for c in others))


def labelled_pairs(pairs: DataFrame, instances: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """pairs: video_id, frame, subject, object; instances: video_id, subject, object, predicate, begin, end. Each pair's multi-hot
    vector of the predicates that hold on its frame (begin <= frame < end)."""
    on = ["video_id", "subject", "object"]
    held = pairs.join(instances, on).filter((F.col("begin") <= F.col("frame")) & (F.col("frame") < F.col("end")))
    found = held.groupBy(*on, "frame").agg(F.collect_set("predicate").alias("found"))
    labels = F.transform(F.array(*map(F.lit, predicates)), lambda p: F.coalesce(F.array_contains("found", p), F.lit(False)).cast("int"))
    return pairs.join(found, [*on, "frame"], "left").select(*on, "frame", labels.alias("labels"))


def top_labels(scores: DataFrame, thresholds: DataFrame, k: int = 3) -> DataFrame:
    """scores: pair_id, label, p; thresholds: label, threshold (a fixed table). The k best labels of each pair that reach theirs."""
    order = Window.partitionBy("pair_id").orderBy(F.desc("p"), "label")
    reached = scores.join(F.broadcast(thresholds), "label").filter(F.col("p") >= F.col("threshold"))
    return reached.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("pair_id", "label", "p", "rank")


def selected_frames(instances: DataFrame, k: int = 6) -> DataFrame:
    """instances: video_id, predicate, begin, end. Each instance scores its first, middle and last frame by 1/sqrt(support of its
    predicate); the k frames of a video with the highest sums."""
    support = instances.groupBy("predicate").agg(F.count(F.lit(1)).alias("support"))
    last = F.greatest("begin", F.col("end") - 1)
    marks = F.array_distinct(F.array("begin", last, F.floor((F.col("begin") + last) / 2).cast(instances.schema["begin"].dataType)))
    scored = instances.join(support, "predicate").select("video_id", F.explode(marks).alias("frame"), "predicate", "support")
    # counts of equal terms first: the sum doesn't depend on the order of rows
    terms = scored.groupBy("video_id", "frame", "predicate").agg((F.count(F.lit(1)) / F.sqrt(F.max("support"))).alias("term"))
    sums = terms.groupBy("video_id", "frame").agg(F.sum(F.floor(F.col("term") * 1e6 + 0.5).cast("long")).alias("score"))
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "frame")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def latest_first(library: DataFrame, time: str = "uploaded", key: str = "video_id") -> DataFrame:
    return library.orderBy(F.desc_nulls_last(time), key)


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For each key the distinct values in the order in which they first come (by value where they come together)."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("at"))
    lists = firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", value))).alias("l"))
    return lists.select(key, F.transform("l", lambda x: x[value]).alias(f"{value}s"))


def softmax(similarities: Column, scale: float = 100.0) -> Column:
    """Probabilities of an array of similarities."""
    raised = F.transform(similarities, lambda s: F.exp((s.cast("double") - F.array_max(similarities).cast("double")) * scale))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda total, x: total + x))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared part of two label sets; two empty sets share nothing."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def progress(done: DataFrame, targets: DataFrame, key: str = "category") -> DataFrame:
    """Items done in each category against the targets: key, done, target, missing. Categories without a target count too."""
    counts = done.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    both = counts.join(targets.select(key, "target"), key, "full")
    done_, target = F.coalesce("done", F.lit(0)).cast("long"), F.coalesce("target", F.lit(0)).cast("long")
    return both.select(key, done_.alias("done"), target.alias("target"), F.greatest(target - done_, F.lit(0)).cast("long").alias("missing"))


def compared_outputs(detections: DataFrame, producer: str = "producer") -> DataFrame:
    """Objects by producer and class, with each producer's total (class null)."""
    return detections.groupingSets([[producer, "class_label"], [producer]], producer, "class_label").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("frame_id").alias("frames"))


def calibration_observations(judged: DataFrame, contributions: DataFrame, k: int = 5) -> DataFrame:
    """judged: query_id, rank_id, place, correct; contributions: rank_id, source, raw. One row for each contribution above 0 to the
    first k results of a query, labelled right or wrong."""
    return judged.filter(F.col("place") <= k).join(contributions.filter("raw > 0"), "rank_id").select("query_id", "rank_id", "source", "raw", "correct")


def one_hot(label: Column | str, classes: Sequence[str]) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.transform(F.array(*map(F.lit, classes)), lambda c: (c == label).cast("double"))


def multi_hot(ids: Column | str, size: int = 80) -> Column:
    """Vector of the ids 1 to size; an array that holds any other id gives null."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    vector = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.array_contains(ids, i).cast("double"))
    return F.when(F.forall(ids, lambda i: i.between(1, size)), vector)


def node_features(detections: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One-hot class, then centre, size, area, aspect ratio (at most 4) and confidence of every detection."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    geometry = F.array((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, w, h, w * h, F.least(F.lit(4.0), w / F.greatest(h, F.lit(1e-6))), F.col("confidence"))
    return detections.withColumn("features", F.concat(one_hot("class_label", classes), geometry))


def training_samples(annotations: DataFrame, size: int = 80) -> DataFrame:
    """annotations: video_id, timestamp, entity_id, box, action_id. A row per person: geometry features and the multi-hot vector of its actions."""
    box = ("x1", "y1", "x2", "y2")
    people = annotations.groupBy("video_id", "timestamp", "entity_id").agg(F.min_by(F.struct(*box), "row_id").alias("b"), F.array_sort(F.collect_set("action_id")).alias("ids"))
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    features = F.array((F.col("b.x1") + F.col("b.x2")) / 2, (F.col("b.y1") + F.col("b.y2")) / 2, w, h, w * h, F.least(F.lit(4.0), w / F.greatest(h, F.lit(1e-6))))
    return people.select("video_id", "timestamp", "entity_id", features.alias("features"), "ids", multi_hot("ids", size).alias("labels"))


def scene_graph(detections: DataFrame, actions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Edges (source, relation, target) of a frame-level graph: frames contain detections, videos show concepts, and hold utterances
    that are one node wherever their normalised text is the same."""
    from sightline.functions.text import relation_name

    holds = detections.select(F.concat(F.lit("frame:"), "frame_id").alias("source"), F.lit("CONTAINS").alias("relation"), F.concat(F.lit("object:"), F.col("detection_id").cast("string")).alias("target"))
    shows = actions.select(F.concat(F.lit("video:"), "video_id"), relation_name(F.col("label")), F.lit("concept"))
    key = F.substring(F.sha1(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))), 1, 16)
    says = transcripts.select(F.concat(F.lit("video:"), "video_id"), F.lit("HAS_AUDIO"), F.concat(F.lit("audio:"), key))
    return holds.union(shows).union(says).dropDuplicates()


def encoded(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The other columns, and these as one JSON payload."""
    return rows.select(*(c for c in rows.columns if c not in columns), F.to_json(F.struct(*columns)).alias("payload"))


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != "payload"), F.from_json("payload", schema).alias("p")).select("*", "p.*").drop("p")


def compared_methods(methods: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """methods: name -> (query_id, segment_id, score) of any ranker. The first k of every method and query in one table."""
    runs = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("method"), "query_id", "segment_id", "score") for name, df in methods.items()])
    order = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "segment_id")
    return runs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evidence_faults(relevant: DataFrame, evidence: DataFrame) -> DataFrame:
    """relevant: query_id, video_id, start_time, end_time, expected (a label), negative; evidence: video_id, timestamp, label.

    A labelled window must hold its expected evidence, and that of a negative query must not. The queries that fail, with the reason.
    """
    from sightline.operators.align import points_in_intervals

    marks = relevant.select("query_id", "video_id", "start_time", "end_time", "expected")
    hits = points_in_intervals(evidence, marks).filter(F.col("label") == F.col("expected")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    judged = relevant.join(hits, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fault = F.when(F.col("negative") & (F.col("n") > 0), "a negative query has evidence").when(~F.col("negative") & (F.col("n") == 0), "a window lacks its evidence")
    return judged.select("query_id", fault.alias("fault")).filter("fault is not null")


def previous_frame_motion(boxes: DataFrame, step: float = 1.0) -> DataFrame:
    """boxes: video_id, track_id, timestamp, box. Movement since the track's box one step earlier: dx, dy, log area ratio, and whether there is one (zeros if not)."""
    order = Window.partitionBy("video_id", "track_id").orderBy("timestamp")
    there = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(order) == step, F.lit(False))
    before = {c: F.lag(c).over(order) for c in ("x1", "y1", "x2", "y2")}
    area = lambda x1, y1, x2, y2: F.greatest((x2 - x1) * (y2 - y1), F.lit(1e-6))
    now = {c: F.col(c) for c in before}
    moved = {
        "dx": (now["x1"] + now["x2"] - before["x1"] - before["x2"]) / 2,
        "dy": (now["y1"] + now["y2"] - before["y1"] - before["y2"]) / 2,
        "log_area": F.log(area(**now) / area(**before)),
    }
    return boxes.withColumns({k: F.when(there, v).otherwise(0.0) for k, v in moved.items()} | {"present": there.cast("int")})
