"""Labelled datasets: grouping, coverage selection, leakage-free splits, pair sampling and features.

Selection loops run on the driver over rounds alone, one aggregate a round; the rows stay in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import box, distance, iou, log_area_ratio, overlap
from sightline.functions.text import tokens
from sightline.sources.scratch import stored


def grouped_annotations(annotations: DataFrame) -> DataFrame:
    """One row per person: video, time, entity (the box as text where it is missing), box, sorted distinct action ids."""
    entity = F.coalesce("entity_id", F.concat_ws(",", "x1", "y1", "x2", "y2"))
    return annotations.withColumn("entity_id", entity).groupBy("video_id", "timestamp", "entity_id", "x1", "y1", "x2", "y2").agg(F.sort_array(F.collect_set("action_id")).alias("action_ids"))


def action_coverage(annotations: DataFrame, rare: int = 5, labels: int = 80) -> DataFrame:
    """For every label its rows and videos; missing and rare flags."""
    seen = annotations.groupBy("action_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("videos"))
    every = annotations.sparkSession.range(1, labels + 1).select(F.col("id").cast("int").alias("action_id"))
    return every.join(seen, "action_id", "left").fillna({"n": 0, "videos": 0}).withColumns({"missing": F.col("n") == 0, "rare": (F.col("n") > 0) & (F.col("n") <= rare)})


def co_occurrence(annotations: DataFrame, top: int = 100) -> DataFrame:
    """The pairs of labels that share most videos. The label set is fixed, so a video has few pairs."""
    have = annotations.select("video_id", "action_id").distinct()
    pairs = have.alias("a").join(have.alias("b"), "video_id").filter("a.action_id < b.action_id")
    return pairs.groupBy(F.col("a.action_id").alias("a"), F.col("b.action_id").alias("b")).agg(F.count(F.lit(1)).alias("videos")).orderBy(F.desc("videos"), "a", "b").limit(top)


def hash_split(videos: DataFrame, seed: int = 2026, share: float = 0.1, key: str = "video_id") -> DataFrame:
    """Videos in the order of SHA-256 of ``seed:id``; the last share is the test split, the one before it validation.

    Ranks come from counts per leading hex digits, so no task sorts all videos.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    keyed = videos.select(key).distinct().withColumn("digest", digest).withColumn("cell", F.substring("digest", 1, 3))
    cells = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # at most 4096
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy())})
    rank = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("digest", key))
    held = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    split = F.when(F.col("rank") > F.col("total") - held, "test").when(F.col("rank") > F.col("total") - 2 * held, "validation").otherwise("train")
    return keyed.join(F.broadcast(cells.drop("n")), "cell").withColumn("rank", rank).select(key, "rank", split.alias("split"))


def leaks_between_splits(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """Keys that are in more than one split; a sound split has none."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def label_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("video_id", "action_id").agg(F.count(F.lit(1)).alias("n"))


def coverage_selection(counts: DataFrame, targets: DataFrame, most: int) -> list[str]:
    """Videos picked greedily until every label reaches its target: most fractional gain, labels helped, raw gain, then id.

    counts: video_id, action_id, n; targets: action_id, target. A round joins the counts to the labels' deficits (one row a
    label) and keeps one maximum.
    """
    picked: list[str] = []
    spark = counts.sparkSession
    goal = {r.action_id: r.target for r in targets.collect()}  # one row a label
    have = dict.fromkeys(goal, 0)
    while len(picked) < most:
        lacking = [(a, goal[a] - have[a], goal[a]) for a in goal if have[a] < goal[a]]
        if not lacking:
            break
        deficit = F.broadcast(spark.createDataFrame(lacking, "action_id int, lack long, target long"))
        useful = counts.filter(~F.col("video_id").isin(picked)) if picked else counts
        gain = F.least("n", "lack")
        own = F.collect_list(F.struct("action_id", "n"))  # one a label
        sums = useful.join(deficit, "action_id", "left").groupBy("video_id").agg(F.sum(gain / F.col("target")).alias("part"), F.count("lack").alias("helped"), F.sum(gain).alias("raw"), own.alias("own"))
        best = sums.filter("helped > 0").orderBy(F.desc("part"), F.desc("helped"), F.desc("raw"), "video_id").first()
        if best is None:
            break
        picked.append(best.video_id)
        for r in best.own:
            if r.action_id in have:
                have[r.action_id] += r.n
    return picked


def without_redundant(counts: DataFrame, targets: DataFrame, picked: Sequence[str]) -> list[str]:
    """Drops picks, last first, that the others' counts make needless."""
    goal = {r.action_id: r.target for r in targets.collect()}
    by_video: dict[str, dict[int, int]] = {v: {} for v in picked}
    for r in counts.filter(F.col("video_id").isin(list(picked))).collect():  # picks times labels
        by_video[r.video_id][r.action_id] = r.n
    kept = list(picked)
    for v in reversed(picked):
        rest = [by_video[o] for o in kept if o != v]
        if all(min(goal[a], sum(o.get(a, 0) for o in [*rest, by_video[v]])) <= sum(o.get(a, 0) for o in rest) for a in goal):
            kept.remove(v)
    return kept


def selected_by_rarity(counts: DataFrame, top: int) -> DataFrame:
    """Videos by rare coverage: sum of min(count, 25) / sqrt(support of the label) plus .02 per label."""
    support = counts.groupBy("action_id").agg(F.sum("n").alias("support"))
    scored = counts.join(support, "action_id").groupBy("video_id").agg((F.sum(F.least("n", F.lit(25)) / F.sqrt("support")) + 0.02 * F.count(F.lit(1))).alias("score"))
    return scored.orderBy(F.desc("score"), "video_id").limit(top)


def growing_splits(videos: DataFrame, base: int, sizes: Sequence[int]) -> DataFrame:
    """videos: video_id, split, rank. For each size the held-out videos and the first training videos up to it."""
    extra = videos.filter("split = 'train'").withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("rank")))
    each = F.explode(F.array(*map(F.lit, sizes)))
    grown = extra.withColumn("size", each).filter(F.col("place") <= F.col("size") - base).select("size", "video_id", "split")
    return grown.union(videos.filter("split <> 'train'").select(each.alias("size"), "video_id", "split"))


def split_statistics(rows: DataFrame) -> DataFrame:
    """rows: split, video_id, timestamp, action_id. Videos, frames, rows and labels covered per split."""
    return rows.groupBy("split").agg(F.count_distinct("video_id").alias("videos"), F.count_distinct("video_id", "timestamp").alias("frames"), F.count(F.lit(1)).alias("rows"), F.count_distinct("action_id").alias("labels"))


def sampled_pairs(pairs: DataFrame, positives: DataFrame, hard: int = 2, random: int = 1, seed: int = 2026) -> DataFrame:
    """pairs: frame_id, a_detection_id, b_detection_id with boxes; positives: the two ids. All positives, the nearest others
    (``hard`` per positive of the frame) and as many seeded random ones."""
    ids = ["a_detection_id", "b_detection_id"]
    known = positives.select(*ids).distinct()
    marked = pairs.withColumn("distance", distance(box("a_"), box("b_"))).select("frame_id", *ids, "distance")
    good = marked.join(known, ids, "left_semi").withColumn("kind", F.lit("positive"))
    size = good.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    rest = marked.join(known, ids, "left_anti").join(size, "frame_id")
    near = F.row_number().over(Window.partitionBy("frame_id").orderBy("distance", *ids))
    placed = rest.withColumn("near", near)
    others = placed.filter(F.col("near") > hard * F.col("n"))
    draw = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.xxhash64(F.lit(seed), *ids), *ids))
    chosen = others.withColumn("draw", draw).filter(F.col("draw") <= random * F.col("n"))
    columns = ["frame_id", *ids, "distance"]
    return good.select(*columns, "kind").union(placed.filter(F.col("near") <= hard * F.col("n")).select(*columns, F.lit("hard"))).union(chosen.select(*columns, F.lit("random")))


def candidate_recall(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Share of positive pairs among the candidates."""
    found = positives.join(candidates.select("source_id", "target_id").distinct().withColumn("hit", F.lit(1.0)), ["source_id", "target_id"], "left")
    return found.agg(F.count(F.lit(1)).alias("positives"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def class_pair_prior(pairs: DataFrame) -> DataFrame:
    """pairs: class_a, class_b, predicate, positive. Smoothed (positives + 1) / (pairs + 2)."""
    return pairs.groupBy("class_a", "class_b", "predicate").agg(((F.sum(F.col("positive").cast("int")) + 1) / (F.count(F.lit(1)) + 2)).alias("prior"))


def sampling_weights(rows: DataFrame) -> DataFrame:
    """rows: item_id, label. Weight 1 / sqrt(support of its rarest label), scaled to mean one, held in .25 to 8, scaled again."""
    support = rows.groupBy("label").agg(F.count(F.lit(1)).alias("support"))
    raw = rows.join(support, "label").groupBy("item_id").agg(F.max(1 / F.sqrt("support")).alias("w"))
    mean = raw.agg(F.avg("w").alias("m")).first().m
    held = raw.select("item_id", F.greatest(F.lit(0.25), F.least(F.lit(8.0), F.col("w") / F.lit(mean))).alias("w"))
    again = held.agg(F.avg("w").alias("m")).first().m
    return held.select("item_id", (F.col("w") / F.lit(again)).alias("weight"))


def multi_hot(ids: Column, labels: int = 80) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.array_contains(ids, i).cast("double"))


def pair_features(prefix_a: str = "a_", prefix_b: str = "b_") -> Column:
    a, b = box(prefix_a), box(prefix_b)
    ax, ay, bx, by = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    shared = overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])
    return F.array(bx - ax, by - ay, distance(a, b), iou(a, b), log_area_ratio(b, a), F.signum(bx - ax), F.signum(by - ay), (shared > 0).cast("double"))


def hashed_words(rows: DataFrame, key: str, text: str, buckets: int = 16) -> DataFrame:
    """key, vector: word counts of a text by SHA-1 bucket, divided by their norm (at least one). A key is a row."""
    words = rows.select(key, F.explode_outer(tokens(F.col(text))).alias("token"))
    words = words.withColumn("cell", F.conv(F.substring(F.sha1("token"), 1, 8), 16, 10).cast("long") % buckets)
    counts = words.groupBy(key).agg(F.array(*(F.count_if(F.col("cell") == i).cast("double") for i in range(buckets))).alias("counts"))
    norm = F.greatest(F.lit(1.0), F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, v: s + v * v)))
    normed = counts.withColumn("norm", norm)
    return normed.select(key, F.transform("counts", lambda v: v / F.col("norm")).alias("vector"))


def feature_moments(vectors: DataFrame) -> DataFrame:
    """vectors: vector. Mean and deviation of each place (a deviation below 1e-6 counts as one)."""
    flat = vectors.select(F.posexplode("vector").alias("place", "v"))
    spread = F.stddev_pop("v")
    return flat.groupBy("place").agg(F.avg("v").alias("mean"), F.when(spread < 1e-6, 1.0).otherwise(spread).alias("deviation"))


def positive_weights(scores: DataFrame) -> DataFrame:
    """Per label: positives, negatives and min(30, negatives / max(positives, 1))."""
    pos, n = F.sum("y"), F.count(F.lit(1))
    return scores.groupBy("label").agg(pos.alias("positives"), (n - pos).alias("negatives"), F.least(F.lit(30.0), (n - pos) / F.greatest(pos, F.lit(1))).alias("weight"))


def vector_faults(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rows whose vectors have the wrong length or hold NaN or infinity, with the reasons."""
    reasons = []
    for column, n in sizes.items():
        bad = F.exists(column, lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull())
        reasons += [F.when(F.coalesce(F.size(column), F.lit(-1)) != n, F.lit(f"{column}: length")), F.when(bad, F.lit(f"{column}: not finite"))]
    return rows.withColumn("faults", F.array_compact(F.array(*reasons))).filter(F.size("faults") > 0)


def newer_wins(master: DataFrame, fresh: DataFrame, key: str = "video_id") -> DataFrame:
    """The master table with every key that ``fresh`` has replaced by its rows."""
    return master.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int = 10, tables: int = 8, bits: int = 8, seed: int = 11) -> DataFrame:
    """Approximate k nearest by cosine: candidates share a random-hyperplane bucket in some table, then are scored exactly.

    What shares no bucket is missed: how much depends on tables and bits. ``all_nearest_vectors`` misses none. queries: query_id, vector; vectors: vec_id, vector (unit length).
    """
    import numpy as np

    one = vectors.first()
    width = len(one["vector"]) if one else 0  # no vectors, no pairs
    planes = np.random.default_rng(seed).standard_normal((tables, bits, width))

    def buckets(df: DataFrame, key: str) -> DataFrame:
        sides = []
        for t in range(tables):
            code = F.lit(0)
            for b in range(bits):
                weights = F.array(*(F.lit(float(x)) for x in planes[t, b]))
                dot = F.aggregate(F.zip_with("vector", weights, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda s, x: s + x)
                code = code + F.when(dot > 0, 1 << b).otherwise(0)
            sides.append(F.struct(F.lit(t).alias("t"), code.alias("code")))
        return df.select(key, "vector", F.explode(F.array(*sides)).alias("b")).select(key, "vector", "b.*")

    left = buckets(queries, "query_id").withColumnRenamed("vector", "q")
    pairs = left.join(buckets(vectors, "vec_id"), ["t", "code"]).dropDuplicates(["query_id", "vec_id"])
    dot = F.aggregate(F.zip_with("q", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return pairs.select("query_id", "vec_id", dot.alias("cosine")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _packed(ids: str, block: int):
    """Rows of (id, vector) as rows of a block each: the ids and the matrix as bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def row(keys, vectors):
            return pa.RecordBatch.from_pydict({ids: pa.array([keys.tobytes()], pa.binary()), f"{ids}_matrix": pa.array([vectors.tobytes()], pa.binary())})

        keys, vectors = None, None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(k), -1)
            keys, vectors = (k, v) if keys is None else (np.concatenate([keys, k]), np.concatenate([vectors, v]))
            while len(keys) >= block:
                yield row(keys[:block], vectors[:block])
                keys, vectors = keys[block:], vectors[block:]
        if keys is not None and len(keys):
            yield row(keys, vectors)

    return run


def _best_of_blocks(k: int):
    """The k nearest of each query among the blocks that a task reads. The product of two blocks only rules out; what is left is summed place by place."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best: dict[bytes, tuple] = {}  # query block -> place of query, cosine, vector id; by query, best first
        for b in batches:
            for r in b.to_pylist():
                qid, vid = np.frombuffer(r["query_id"], np.int64), np.frombuffer(r["vec_id"], np.int64)
                q = np.frombuffer(r["query_id_matrix"], np.float32).reshape(len(qid), -1).astype(np.float64)
                v = np.frombuffer(r["vec_id_matrix"], np.float32).reshape(len(vid), -1).astype(np.float64)
                at, cosine, ids = best.get(r["query_id"], (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)))
                found = [(at, cosine, ids)]
                for i in range(0, len(qid), 512):
                    near = q[i : i + 512] @ v.T
                    least = np.partition(near, max(0, len(vid) - k), axis=1)[:, max(0, len(vid) - k)] - 1e-9
                    x, y = np.nonzero(near >= least[:, None])
                    exact = np.zeros(len(x))
                    for d in range(q.shape[1]):
                        exact += q[i + x, d] * v[y, d]
                    found.append((i + x, exact, vid[y]))
                at, cosine, ids = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((ids, -cosine, at))
                at, cosine, ids = at[order], cosine[order], ids[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                best[r["query_id"]] = at[kept], cosine[kept], ids[kept]
        for block, (at, cosine, ids) in best.items():
            yield pa.RecordBatch.from_pydict({"query_id": np.frombuffer(block, np.int64)[at], "vec_id": ids, "cosine": cosine})

    return run


def all_nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int = 10, query_block: int = 4096, vector_block: int = 8192) -> DataFrame:
    """The k nearest by cosine among all vectors, ties by id: every block of queries against every block of vectors.

    queries: query_id (one row each), vector; vectors: vec_id, vector (unit length, all of one width; null ones are left out). Work
    is the product of the two tables; rows are blocks, so only k results a query and task are shuffled.
    """
    q = queries.filter("vector is not null").select("query_id", "vector").mapInArrow(_packed("query_id", query_block), "query_id binary, query_id_matrix binary")
    v = vectors.filter("vector is not null").select("vec_id", "vector").mapInArrow(_packed("vec_id", vector_block), "vec_id binary, vec_id_matrix binary")
    near = v.crossJoin(q).mapInArrow(_best_of_blocks(k), "query_id long, vec_id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def ordered_split(videos: DataFrame, share: float = 0.1, key: str = "video_id") -> DataFrame:
    """The last share of videos by id is the test split. Ids are dealt by range, ranked inside a range, and ranges are summed."""
    keyed = stored(videos.select(key).distinct().repartitionByRange(key).withColumn("cell", F.spark_partition_id()), "ranges")
    cells = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"after": F.coalesce(F.sum("n").over(after), F.lit(0)), "total": F.sum("n").over(Window.partitionBy())})
    rank = F.col("after") + F.row_number().over(Window.partitionBy("cell").orderBy(F.desc(key)))
    held = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    return keyed.join(cells.drop("n"), "cell").select(key, F.when(rank <= held, "test").otherwise("train").alias("split"))
