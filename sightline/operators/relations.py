"""Relations between objects: geometry in a frame, intervals over time, endpoints and exact matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import box, centre, distance, intersection, iou, log_area_ratio
from sightline.functions.text import stable_id, three_places
from sightline.plans.lexicon import SYMMETRIC_IN_MATCHING, SYMMETRIC_IN_SMOOTHING

SIDE = ("detection_id", "class_label", "confidence", "x1", "y1", "x2", "y2")


def frame_pairs(detections: DataFrame, ordered: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of detections of one frame with prefixes a_ and b_: each once (a before b by id), or both ways if ``ordered``."""
    side = [*SIDE, *extra]
    a = detections.select("video_id", "frame_id", "timestamp", *(F.col(c).alias(f"a_{c}") for c in side))
    b = detections.select("frame_id", *(F.col(c).alias(f"b_{c}") for c in side))
    pairs = a.join(b, "frame_id")
    return pairs.filter("a_detection_id <> b_detection_id" if ordered else "a_detection_id < b_detection_id")


def _cells(x: Column, y: Column, size: Column | float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def near_pairs(detections: DataFrame, reach: Column | float) -> DataFrame:
    """Ordered pairs of ``frame_pairs`` whose centres are at most ``reach`` apart, and their distance.

    The frame is laid out in cells a little wider than the reach; each object meets the nine cells around it, so what is
    joined grows with the pairs that are near, not with the square of a crowd. reach: a number, or a column of the first object's.
    """
    x, y = centre(box())
    rows = detections.withColumn("reach", reach if isinstance(reach, Column) else F.lit(float(reach))).withColumn("wide", F.col("reach") * (1 + 1e-9))
    own = _cells(x, y, F.col("wide"))
    around = F.array(*(F.struct((own[0] + i).alias("i"), (own[1] + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = rows.select("video_id", "frame_id", "timestamp", "reach", "wide", F.explode(around).alias("cell"), *(F.col(c).alias(f"a_{c}") for c in SIDE))
    b = rows.select("frame_id", "wide", F.struct(own[0].alias("i"), own[1].alias("j")).alias("cell"), *(F.col(c).alias(f"b_{c}") for c in SIDE))
    met = a.join(b, ["frame_id", "wide", "cell"]).filter("a_detection_id <> b_detection_id").withColumn("distance", distance(box("a_"), box("b_")))
    return met.filter("distance <= reach").drop("reach", "wide", "cell")


def touching_pairs(detections: DataFrame) -> DataFrame:
    """Ordered pairs of ``frame_pairs`` whose boxes share an area.

    A box lies on all cells it covers, cells being as large as the frame's mean box; a pair counts in the cell that holds
    the lower corner of what it shares, so once.
    """
    width, height = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    sizes = detections.groupBy("frame_id").agg(F.greatest(F.avg(width), F.lit(1e-6)).alias("w"), F.greatest(F.avg(height), F.lit(1e-6)).alias("h"))
    span = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / F.col(size)).cast("long"), F.floor(F.col(hi) / F.col(size)).cast("long"))
    laid = detections.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).join(sizes, "frame_id")
    laid = laid.withColumn("i", F.explode(span("x1", "x2", "w"))).withColumn("j", F.explode(span("y1", "y2", "h")))
    a = laid.select("video_id", "frame_id", "timestamp", "i", "j", "w", "h", *(F.col(c).alias(f"a_{c}") for c in SIDE))
    b = laid.select("frame_id", "i", "j", *(F.col(c).alias(f"b_{c}") for c in SIDE))
    here = lambda c, size, cell: F.floor(F.greatest(f"a_{c}", f"b_{c}") / F.col(size)) == F.col(cell)
    met = a.join(b, ["frame_id", "i", "j"]).filter("a_detection_id <> b_detection_id")
    return met.filter((intersection(box("a_"), box("b_")) > 0) & here("x1", "w", "i") & here("y1", "h", "j")).drop("i", "j", "w", "h")


def _edge(source: str, target: str, predicate: str, confidence: Column) -> Column:
    ends = [F.col(f"{x}_detection_id").alias(f"{end}_id") for x, end in ((source, "source"), (target, "target"))] + [F.lower(f"{x}_class_label").alias(f"{end}_class") for x, end in ((source, "source"), (target, "target"))]
    return F.struct(*ends, F.lit(predicate).alias("predicate"), confidence.alias("confidence"))


def placed_pairs(placed: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The pairs of ``frame_pairs`` whose ends are in one segment, with its id, for detections placed on segments (video_id, segment_id).

    An object meets those behind it in its sorted frame by a window, which goes by video as placing does: rows that were dealt out for placing
    aren't dealt out again, and a crowd's pairs are made row by row.
    """
    side = [*SIDE, *extra]
    behind = Window.partitionBy("video_id", "segment_id", "frame_id").orderBy("detection_id").rowsBetween(1, Window.unboundedFollowing)
    rows = placed.filter("frame_id is not null").select("video_id", "segment_id", "frame_id", "timestamp", *(F.col(c).alias(f"a_{c}") for c in side), F.collect_list(F.struct(*side)).over(behind).alias("behind"))
    pairs = rows.withColumn("b", F.explode("behind")).select("video_id", "segment_id", "frame_id", "timestamp", *(f"a_{c}" for c in side), *(F.col(f"b.{c}").alias(f"b_{c}") for c in side))
    return pairs.filter("a_detection_id < b_detection_id")


def spatial_edges(pairs: DataFrame, near: float, gap: float, *also: str) -> DataFrame:
    """overlaps_with, near, left_of and above of each pair, from normalised boxes, with the ends' lower-case classes but without ids."""
    if near <= 0:
        raise ValueError("near must be positive")
    a, b = box("a_"), box("b_")
    (ax, ay), (bx, by) = centre(a), centre(b)
    d, shared = distance(a, b), iou(a, b)
    one = F.lit(1.0)
    dx, dy = F.abs(ax - bx), F.abs(ay - by)
    edges = F.array(
        F.when(shared > 0, _edge("a", "b", "overlaps_with", F.least(one, shared))),
        F.when(d <= near, _edge("a", "b", "near", F.greatest(F.lit(0.0), 1 - d / near))),
        F.when((dx >= gap) & (ax < bx), _edge("a", "b", "left_of", F.least(one, dx))).when(dx >= gap, _edge("b", "a", "left_of", F.least(one, dx))),
        F.when((dy >= gap) & (ay < by), _edge("a", "b", "above", F.least(one, dy))).when(dy >= gap, _edge("b", "a", "above", F.least(one, dy))),
    )
    found = pairs.select("video_id", *also, "frame_id", "timestamp", F.explode(F.array_compact(edges)).alias("e")).select("video_id", *also, "frame_id", "timestamp", "e.*")
    return found.withColumn("source_method", F.lit("bounding_box_geometry"))


def placed_relations(placed: DataFrame, near: float = 0.22, gap: float = 0.05) -> DataFrame:
    """``spatial_relations`` whose two ends are in the same segment, with it and the ends' classes, but without ids: see ``with_relation_id``."""
    return spatial_edges(placed_pairs(placed), near, gap, "segment_id")


def spatial_relations(detections: DataFrame, near: float = 0.22, gap: float = 0.05) -> DataFrame:
    """overlaps_with, near, left_of and above between the objects of a frame, from normalised boxes."""
    return with_relation_id(spatial_edges(frame_pairs(detections), near, gap).drop("source_class", "target_class"))


def with_relation_id(relations: DataFrame) -> DataFrame:
    return relations.withColumn("relationship_id", stable_id("rel", F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("predicate"), three_places(F.col("timestamp")), F.col("source_method")))


def pixel_relations(detections: DataFrame, touch: float = 0.05, close: float = 150.0, reach: float = 300.0, offset: float = 20.0) -> DataFrame:
    """Ordered pair relations in pixel space: overlaps_with or touches, contains, inside, near and directions, each once."""
    a, b = box("a_"), box("b_")
    (ax, ay), (bx, by) = centre(a), centre(b)
    d, shared, both = distance(a, b), iou(a, b), intersection(a, b)
    within = (b[0] >= a[0]) & (b[1] >= a[1]) & (b[2] <= a[2]) & (b[3] <= a[3])
    holds = (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])
    near_enough = d <= reach
    names = F.array(
        F.when(shared > touch, F.lit("overlaps_with")).when(both > 0, F.lit("touches")),
        F.when(within, F.lit("contains")),
        F.when(holds, F.lit("inside")),
        F.when(d < close, F.lit("near")),
        F.when(near_enough & (ax < bx - offset), F.lit("left_of")).when(near_enough & (ax > bx + offset), F.lit("right_of")),
        F.when(near_enough & (ay < by - offset), F.lit("above")).when(near_enough & (ay > by + offset), F.lit("below")),
    )
    # what isn't within reach has a relation only if the boxes share an area
    pairs = near_pairs(detections, max(reach, close)).drop("distance").unionByName(touching_pairs(detections))
    return pairs.select("video_id", "frame_id", F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"), F.explode(F.array_compact(names)).alias("predicate")).dropDuplicates(["source_id", "target_id", "predicate"])


def semantic_relations(detections: DataFrame, talking: Sequence[str], target: str = "person") -> DataFrame:
    """talks_to between persons of a frame of whom the first has an action of ``talking``; interacts_with towards other objects."""
    marked = frame_pairs(detections, ordered=True, extra=["actions"]).filter((F.col("a_class_label") == target) & F.arrays_overlap("a_actions", F.array(*map(F.lit, talking))))
    return marked.select("frame_id", F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"), F.when(F.col("b_class_label") == target, "talks_to").otherwise("interacts_with").alias("predicate"))


def nearest_targets(detections: DataFrame, actor: str = "person", kind: str | None = None) -> DataFrame:
    """Each actor with the nearest other object of its frame (of one kind, if given), by distance then id."""
    pairs = frame_pairs(detections, ordered=True).filter(F.col("a_class_label") == actor)
    if kind:
        pairs = pairs.filter(F.col("b_class_label") == kind)
    best = pairs.groupBy("frame_id", F.col("a_detection_id").alias("source_id")).agg(F.min(F.struct(distance(box("a_"), box("b_")).alias("distance"), F.col("b_detection_id").alias("target_id"))).alias("best"))
    return best.select("frame_id", "source_id", "best.target_id", "best.distance")


def action_targets(detections: DataFrame, predictions: DataFrame, rules: DataFrame) -> DataFrame:
    """The object that an action is done to: the nearest other of the frame that is a person, or isn't, as the action needs.

    predictions: detection_id, label, confidence; rules: label, kind (person or object), predicate, a fixed table. Ties go by id as text. Each
    actor and kind is searched once, whatever the number of its actions.
    """
    asked = predictions.join(F.broadcast(rules), "label")
    kinds = asked.select(F.col("detection_id").alias("a_detection_id"), "kind").distinct()
    pairs = frame_pairs(detections, ordered=True).withColumn("kind", F.when(F.lower("b_class_label") == "person", "person").otherwise("object"))
    best = pairs.join(kinds, ["a_detection_id", "kind"]).groupBy("frame_id", F.col("a_detection_id").alias("detection_id"), "kind").agg(F.min(F.struct(distance(box("a_"), box("b_")).alias("distance"), F.col("b_detection_id").cast("string").alias("target_id"))).alias("b"))
    return asked.join(best, ["detection_id", "kind"]).select("frame_id", F.col("detection_id").alias("source_id"), "label", "predicate", "b.target_id", "b.distance", "confidence")


def materialized_endpoints(relations: DataFrame, placed: DataFrame) -> DataFrame:
    """Relations whose both ends are seen in their segment: an end by its detection, else by its track's first detection there.

    relations: segment_id, relationship_id, source_id, target_id, source_track_id, target_track_id, and others; placed: segment_id, detection_id, track_id, class_label, timestamp.
    """
    for end in ("source", "target"):
        by_id = placed.select("segment_id", F.col("detection_id").alias(f"{end}_id"), F.struct("detection_id", "class_label").alias("own"))
        first = placed.filter("track_id is not null").groupBy("segment_id", F.col("track_id").alias(f"{end}_track_id")).agg(F.min(F.struct("timestamp", "detection_id", "class_label")).alias("f"))
        first = first.select("segment_id", f"{end}_track_id", F.struct("f.detection_id", "f.class_label").alias("of_track"))
        joined = relations.join(by_id, ["segment_id", f"{end}_id"], "left").join(first, ["segment_id", f"{end}_track_id"], "left")
        found = joined.withColumn("end", F.coalesce("own", "of_track")).filter("end is not null").drop("own", "of_track")
        relations = found.withColumns({f"{end}_id": F.col("end.detection_id"), f"{end}_class": F.lower("end.class_label")}).drop("end")
    return relations


def neighbours(detections: DataFrame, k: int = 8, reach: float = 0.85, levels: int = 6) -> DataFrame:
    """For each object its k nearest others of the frame within reach: candidate pairs for a relation model.

    A ring search: in a crowded frame an object first meets what lies within reach / 2**level, the level growing with the crowd. If k are found
    there, no other can be nearer; else it goes on with twice the distance, at last with the reach itself.
    """
    crowd = detections.groupBy("frame_id").agg(F.count(F.lit(1)).alias("crowd"))
    level = F.least(F.lit(levels), F.greatest(F.lit(0), F.floor(F.log2(F.sqrt(F.col("crowd") / (4.0 * k))))).cast("int"))
    seeking = detections.join(crowd, "frame_id").withColumn("level", level).drop("crowd")
    most = seeking.agg(F.max("level")).first()[0] or 0
    order = Window.partitionBy("frame_id", "a_detection_id").orderBy("distance", "b_detection_id")
    found, waiting = None, seeking.select("frame_id", F.col("detection_id").alias("a_detection_id"), "level").filter("level = -1")
    for now in range(most, -1, -1):
        # an object meets others by its own distance; those that only stand by are laid out with it
        frames = seeking.filter(F.col("level") >= now).drop("level")
        asking = seeking.filter(F.col("level") == now).select("frame_id", F.col("detection_id").alias("a_detection_id")).unionByName(waiting.select("frame_id", "a_detection_id"))
        pairs = near_pairs(frames, reach / 2**now)
        if most:
            pairs = pairs.join(asking, ["frame_id", "a_detection_id"], "left_semi")
        best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if now:
            full = best.filter(F.col("rank") == k).select("frame_id", "a_detection_id")
            waiting = asking.join(full, ["frame_id", "a_detection_id"], "left_anti")
            best = best.join(full, ["frame_id", "a_detection_id"], "left_semi")
        found = best if found is None else found.unionByName(best)
    return found.select("frame_id", F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"), "rank", "distance")


def graph_edges(detections: DataFrame, person: str = "person", mixed: float = 0.65, objects: float = 0.30) -> DataFrame:
    """Edges of a frame's graph, both ways: between persons always, else within a distance; with eight geometric features."""
    a, b = box("a_"), box("b_")
    d = distance(a, b)
    persons = (F.col("a_class_label") == person).cast("int") + (F.col("b_class_label") == person).cast("int")
    (ax, ay), (bx, by) = centre(a), centre(b)
    numbers = [bx - ax, by - ay, d, iou(a, b), log_area_ratio(b, a), F.signum(bx - ax), F.signum(by - ay), (intersection(a, b) > 0).cast("double")]
    pairs = frame_pairs(detections, ordered=True).filter((persons == 2) | ((persons == 1) & (d <= mixed)) | ((persons == 0) & (d <= objects)))
    return pairs.select("frame_id", F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"), F.array(*numbers).alias("features"))


def threshold_edges(detections: DataFrame, reach: float = 0.45) -> DataFrame:
    return near_pairs(detections, reach).select("frame_id", F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"), "distance")


def smooth_intervals(relations: DataFrame, tracks: DataFrame, sample_interval: float = 1.0, max_gap: float = 1.5, symmetric: Sequence[str] = SYMMETRIC_IN_SMOOTHING) -> DataFrame:
    """Observations of one tracked relation merged into episodes; a gap above ``max_gap`` starts a new one.

    relations: source_id, target_id, predicate, source_method, timestamp, confidence, relationship_id; tracks: detection_id, track_id.
    An end without a track stands for itself.
    """
    s = tracks.select(F.col("detection_id").alias("source_id"), F.col("track_id").alias("st"))
    t = tracks.select(F.col("detection_id").alias("target_id"), F.col("track_id").alias("tt"))
    known = relations.join(s, "source_id", "left").join(t, "target_id", "left")
    source, target = F.coalesce("st", F.col("source_id").cast("string")), F.coalesce("tt", F.col("target_id").cast("string"))
    known = known.withColumns({"source_track_id": source, "target_track_id": target})
    swapped = F.lower(F.trim("predicate")).isin(*symmetric)
    key = {
        "k1": F.when(swapped, F.least("source_track_id", "target_track_id")).otherwise(F.col("source_track_id")),
        "k2": F.when(swapped, F.greatest("source_track_id", "target_track_id")).otherwise(F.col("target_track_id")),
        "predicate": F.lower(F.trim("predicate")),
    }
    keys = ["k1", "k2", "predicate", "source_method"]
    order = Window.partitionBy(*keys).orderBy("timestamp", "relationship_id")
    known = known.withColumns(key)
    known = known.withColumn("new", F.coalesce((F.col("timestamp") - F.lag("timestamp").over(order) > max_gap).cast("int"), F.lit(1)))
    known = known.withColumn("episode", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.max_by(F.struct("source_id", "target_id", "source_track_id", "target_track_id"), F.struct("confidence", -F.col("timestamp"), "relationship_id"))
    merged = known.groupBy(*keys, "episode").agg(
        F.min("timestamp").alias("start_time"), F.max(F.col("timestamp") + sample_interval).alias("end_time"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("observation_count"), best.alias("best")
    )
    merged = merged.withColumn("relationship_id", stable_id("rel", *(F.col(k) for k in keys), F.lit(""), three_places(F.col("start_time")), three_places(F.col("end_time"))))
    return merged.select("relationship_id", "k1", "k2", "predicate", "source_method", "start_time", "end_time", "confidence", "observation_count", (F.col("observation_count") > 1).alias("temporal_smoothed"), "best.*")


def localized_endpoints(placed: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracked relations, placed on segments (with segment_start, segment_end), bound to concrete detections of each segment.

    Of all pairs of the two tracks in a segment: the least time gap, then nearest the overlap's middle, then ids. Where the
    overlap has no length, or a track has no detection in the segment, the relation isn't in that segment.
    """
    lo, hi = F.greatest("segment_start", "start_time"), F.least("segment_end", "end_time")
    spans = placed.withColumns({"from_time": lo, "to_time": hi}).filter("to_time > from_time")
    s = detections.select("segment_id", F.col("track_id").alias("source_track_id"), F.col("detection_id").alias("s_id"), F.col("timestamp").alias("s_time"))
    t = detections.select("segment_id", F.col("track_id").alias("target_track_id"), F.col("detection_id").alias("t_id"), F.col("timestamp").alias("t_time"))
    focus = (F.col("from_time") + F.col("to_time")) / 2
    pairs = spans.join(s, ["segment_id", "source_track_id"]).join(t, ["segment_id", "target_track_id"])
    choice = F.struct(F.abs(F.col("s_time") - F.col("t_time")).alias("gap"), F.abs((F.col("s_time") + F.col("t_time")) / 2 - focus).alias("off"), "s_id", "t_id", F.col("s_time").alias("at"))
    best = pairs.groupBy("segment_id", "relationship_id", "predicate", "source_method", "confidence", "from_time", "to_time").agg(F.min(choice).alias("c"))
    return best.select("segment_id", "relationship_id", F.col("c.s_id").alias("source_id"), F.col("c.t_id").alias("target_id"), "predicate", "source_method", "confidence", F.col("c.at").alias("timestamp"), F.col("from_time").alias("start_time"), F.col("to_time").alias("end_time"))


def with_classes(relations: DataFrame, detections: DataFrame) -> DataFrame:
    """Relations whose two ends are detections of the same segment, with their classes."""
    s = detections.select("segment_id", F.col("detection_id").alias("source_id"), F.lower("class_label").alias("source_class"))
    t = detections.select("segment_id", F.col("detection_id").alias("target_id"), F.lower("class_label").alias("target_class"))
    return relations.join(s, ["segment_id", "source_id"]).join(t, ["segment_id", "target_id"])


def tuple_key(subject: Column, predicate: Column, obj: Column) -> Column:
    """One key for a relation and, where the predicate is symmetric, its reverse, so that matching needs no OR."""
    both_ways = predicate.isin(*SYMMETRIC_IN_MATCHING)
    return F.concat_ws("|", predicate, F.when(both_ways, F.least(subject, obj)).otherwise(subject), F.when(both_ways, F.greatest(subject, obj)).otherwise(obj))


def matched_tuples(relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: query_id, need_id, subject, predicate, object. The best relation of each segment for each need, by (confidence, id).

    Relations without relationship_id get it here, when they match. With video_id, rows that are dealt out by video stay where they are.
    """
    have = relations.withColumn("key", tuple_key(F.col("source_class"), F.col("predicate"), F.col("target_class")))
    need = wanted.select("query_id", "need_id", tuple_key(F.col("subject"), F.col("predicate"), F.col("object")).alias("key"))
    met = have.join(need, "key")
    if "relationship_id" not in relations.columns:
        met = with_relation_id(met)
    order = Window.partitionBy("query_id", "need_id", *(c for c in ("video_id", "segment_id") if c in relations.columns)).orderBy(F.desc("confidence"), "relationship_id")
    return met.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "key")


def geometry_rules(pairs: DataFrame) -> DataFrame:
    """The rule baseline over ordered pairs with a_ and b_ boxes: next_to, above, beneath, inside, each with score 0.9."""
    a, b = box("a_"), box("b_")
    (ax, ay), (bx, by) = centre(a), centre(b)
    inside = (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])
    names = F.array(F.when(distance(a, b) <= 0.25, F.lit("next_to")), F.when(ay < by - 0.1, F.lit("above")), F.when(ay > by + 0.1, F.lit("beneath")), F.when(inside, F.lit("inside")))
    return pairs.select("frame_id", "a_detection_id", "b_detection_id", F.explode(F.array_compact(names)).alias("predicate")).withColumn("score", F.lit(0.9))
