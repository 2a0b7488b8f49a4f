"""Greedy choices of videos by what labels they show: held-out splits and additions.

A choice made now lowers what every other video is still worth, never raises it, so a worth computed earlier is an upper bound.
The table of videos is scored by Spark in one pass, and its best ``AHEAD`` rows go to the driver; there picks are made as long as the best of
them, scored anew, is worth at least the bound of the last row fetched. Then the table is scored again. The driver holds ``AHEAD`` rows, sums of
one number a label, and the ids picked since the last pass.

counts: video_id, action_id (int), n (long), one row a video and label. Labels are a fixed vocabulary, videos may be many.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import sqrt
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.scratch import stored

#: Rows of the table that are looked at on the driver.
AHEAD = 256


def by_video(counts: DataFrame) -> DataFrame:
    """video_id, own: map of label to count."""
    rows = counts.groupBy("video_id", F.col("action_id").cast("int").alias("action_id")).agg(F.sum("n").cast("long").alias("n"))
    return rows.groupBy("video_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action_id", "n")))).alias("own"))


def _without(videos: DataFrame, ids: list[str]) -> DataFrame:
    return videos.join(videos.sparkSession.createDataFrame([(v,) for v in ids], "video_id string"), "video_id", "left_anti").select(videos.columns) if ids else videos


def _known(values: dict[int, float]) -> Column:
    """A map of labels as a literal."""
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)) if values else F.create_map().cast("map<int,double>")


def _total(keys: Column, worth: Callable[[Column], Column]) -> Column:
    # in order of labels, so that every engine adds alike
    return F.aggregate(F.array_sort(keys), F.lit(0.0), lambda total, a: total + worth(a))


class HeldOut:
    """What is left for training while videos are held out, a label at a time."""

    def __init__(self, support: dict[int, int], least: int = 3) -> None:
        self.support, self.left = support, dict(support)
        self.eligible = {a for a, n in support.items() if n >= least}

    def allows(self, own: dict[int, int]) -> bool:
        return all(self.left[a] > n for a, n in own.items() if a in self.eligible)

    def allowed(self) -> Column:
        """``allows`` of a row's ``own``. It never becomes true again once it is false."""
        left = _known({a: float(self.left[a]) for a in self.eligible})
        return F.forall(F.map_entries("own"), lambda e: F.coalesce(F.try_element_at(left, e["key"]) > e["value"], F.lit(True)))

    def take(self, own: dict[int, int]) -> None:
        for a, n in own.items():
            self.left[a] -= n


def _picked_for_coverage(videos: DataFrame, pool: HeldOut, size: int, ahead: int) -> list[tuple[str, dict]]:
    """Picks by (square-root weighted labels not covered yet, labels with support, tie), none that would leave training without a label
    that has support; when there is no such left, by the tie alone."""
    covered: set[int] = set()
    picks: list[tuple[str, dict]] = []
    weight = {a: 1 / sqrt(max(1, n)) for a, n in pool.support.items()}

    def reward(own: dict[int, int]) -> float:
        total = 0.0
        for a in sorted(own):
            total += weight[a] if a not in covered else 0.0
        return total

    while len(picks) < size:
        fresh = _known({a: w for a, w in weight.items() if a not in covered})
        gain = _total(F.map_keys("own"), lambda a: F.coalesce(F.try_element_at(fresh, a), F.lit(0.0)))
        rest = _without(videos, [v for v, _ in picks])
        scored = rest.filter(pool.allowed()).withColumn("gain", gain).orderBy(F.desc("gain"), F.desc("breadth"), F.desc("tie"))
        rows = scored.limit(ahead).collect()
        if not rows:
            rows = rest.orderBy(F.desc("tie")).limit(size - len(picks)).collect()
            picks += [(r.video_id, r.own) for r in rows]
            for r in rows:
                pool.take(r.own)
            break
        floor = (rows[-1].gain, rows[-1].breadth, rows[-1].tie) if len(rows) == ahead else (-1.0, -1, 0)
        heap = [(-r.gain, -r.breadth, -r.tie, i) for i, r in enumerate(rows)]
        heapq.heapify(heap)
        while heap and len(picks) < size:
            bound, breadth, tie, i = heapq.heappop(heap)
            if not pool.allows(rows[i].own):
                continue
            now = -reward(rows[i].own)
            if now != bound:
                heapq.heappush(heap, (now, breadth, tie, i))
                continue
            if (-now, -breadth, -tie) < floor:
                break
            picks.append((rows[i].video_id, rows[i].own))
            pool.take(rows[i].own)
            covered |= set(rows[i].own)
    return picks


def balanced_split(counts: DataFrame, seed: int = 2026, validation: float = 0.18, test: float = 0.18, least: int = 2, ahead: int = AHEAD) -> DataFrame:
    """video_id, split: held-out videos that show as many labels as they can and leave every label of some support to training.

    Test videos are picked first, validation videos of the rest; ties go by a hash of seed and video.
    """
    own = by_video(counts)
    support = {r.action_id: r.n for r in counts.groupBy(F.col("action_id").cast("int").alias("action_id")).agg(F.sum("n").alias("n")).collect()}  # one row a label
    pool = HeldOut(support)
    breadth = F.size(F.filter(F.map_keys("own"), lambda a: a.isin(sorted(pool.eligible))))
    videos = stored(own.withColumns({"breadth": breadth, "tie": F.xxhash64(F.lit(seed), "video_id")}), "videos")
    total = videos.count()
    if total < 10:
        raise ValueError("a balanced split needs at least ten videos")
    held: list[tuple[str, str]] = []
    rest = videos
    for name, share in (("test", test), ("validation", validation)):
        picks = [v for v, _ in _picked_for_coverage(rest, pool, max(least, round(total * share)), ahead)]
        held += [(v, name) for v in picks]
        rest = _without(rest, picks)
    named = videos.sparkSession.createDataFrame(held, "video_id string, split string")
    return videos.select("video_id").join(named, "video_id", "left").fillna("train", ["split"])


# -- additions ---------------------------------------------------------------------------------------------------------------


def _overlap(known: list[frozenset[int]]):
    """``most`` becomes the largest Jaccard overlap of a row's labels with one more of ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("most")
            most = []
            for own, before in zip(batch.column(batch.schema.get_field_index("own")).to_pylist(), batch.column(at).to_pylist()):
                labels = frozenset(a for a, _ in own)
                most.append(max([before, *(jaccard(labels, other) for other in known)]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(most, pa.float64()))

    return run


def jaccard(a: frozenset[int], b: frozenset[int]) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def _value(own: dict[int, int], most: float, split: str, have: dict[int, int], target: int, wanted: str) -> tuple[float, float, float, float]:
    """(support still lacking that a video brings, weighted by rarity; breadth; how unlike it is; whether its split is wanted)."""
    gain = breadth = 0.0
    for a in sorted(own):
        scale = 1 / sqrt(have.get(a, 0) + 1.0)
        gain += min(max(0, target - have.get(a, 0)), own[a]) * scale
        breadth += scale
    return gain, breadth, 1.0 - most, float(split == wanted)


def incremental_selection(counts: DataFrame, splits: DataFrame, current: DataFrame, size: int, target: int = 25, ahead: int = AHEAD) -> DataFrame:
    """splits: video_id, split (train or validation); current: video_id, those already chosen. video_id, place, gain, breadth, diversity of up to ``size`` more.

    Each pick is the best by (rare support gained, inverse-frequency breadth, unlikeness to all chosen, split that has fewer, id), and
    counts as chosen for the next. The largest overlap with what is chosen is a column that each pass brings up to date with the picks since.
    """
    spark = counts.sparkSession
    videos = by_video(counts).join(splits, "video_id").select("video_id", F.map_entries("own").alias("own"), "split")
    chosen = videos.join(current.select("video_id").distinct(), "video_id", "left_semi")
    have: dict[int, int] = {r.a: r.n for r in chosen.select(F.explode("own").alias("e")).groupBy(F.col("e.key").alias("a")).agg(F.sum("e.value").alias("n")).collect()}
    of_split = {"train": 0, "validation": 0} | {r.split: r.n for r in chosen.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    # distinct sets of labels, each as its labels' bits
    news = [frozenset(r.labels) for r in chosen.select(F.transform("own", lambda e: e["key"]).alias("labels")).distinct().collect()]
    rest = videos.join(current.select("video_id"), "video_id", "left_anti").withColumn("most", F.lit(0.0))
    picks: list[dict[str, Any]] = []
    while len(picks) < size:
        rest = stored(_without(rest, [p["video_id"] for p in picks]).mapInArrow(_overlap(news), rest.schema), "candidates")
        news = []
        scale = F.transform("own", lambda e: 1 / F.sqrt(F.coalesce(F.try_element_at(_known({a: float(n) for a, n in have.items()}), e["key"]), F.lit(0.0)) + 1.0))
        lack = F.transform("own", lambda e: F.least(F.greatest(F.lit(0.0), target - F.coalesce(F.try_element_at(_known({a: float(n) for a, n in have.items()}), e["key"]), F.lit(0.0))), e["value"].cast("double")))
        add = lambda column: F.aggregate(column, F.lit(0.0), lambda total, x: total + x)
        scored = rest.withColumns({"gain": add(F.zip_with(lack, scale, lambda x, y: x * y)), "breadth": add(scale)})
        wanted = min(("train", "validation"), key=of_split.__getitem__)
        rows = scored.orderBy(F.desc("gain"), F.desc("breadth"), "most", F.desc(F.col("split") == wanted), F.desc("video_id")).limit(ahead).collect()
        if not rows:
            break
        # with one video that isn't fetched, no pick may be worth less than the last fetched could be in the wanted split
        floor = (rows[-1].gain, rows[-1].breadth, 1 - rows[-1].most, 1.0, rows[-1].video_id) if len(rows) == ahead else None
        most = [r.most for r in rows]
        left, began = set(range(len(rows))), len(picks)
        heap = [((-r.gain, -r.breadth, r.most - 1, -1.0), i) for i, r in enumerate(rows)]
        heapq.heapify(heap)
        while left and len(picks) < size:
            wanted = min(("train", "validation"), key=of_split.__getitem__)
            best, again = None, []
            while heap and (best is None or tuple(-x for x in heap[0][0]) >= best[0][:4]):
                _, i = heapq.heappop(heap)
                score = (*_value({e.key: e.value for e in rows[i].own}, most[i], rows[i].split, have, target, wanted), rows[i].video_id)
                again.append((score, i))
                best = max(best, (score, i)) if best else (score, i)
            for score, i in again:  # their bounds are what they are worth now, in either split
                if i != best[1]:
                    heapq.heappush(heap, ((-score[0], -score[1], -score[2], -1.0), i))
            if floor and best[0] < floor and len(picks) > began:
                break
            score, i = best
            left.remove(i)
            labels = frozenset(e.key for e in rows[i].own)
            picks.append({"video_id": rows[i].video_id, "place": len(picks), "gain": score[0], "breadth": score[1], "diversity": score[2]})
            for e in rows[i].own:
                have[e.key] = have.get(e.key, 0) + e.value
            of_split[rows[i].split] += 1
            news.append(labels)
            most = [max(m, jaccard(frozenset(e.key for e in r.own), labels)) for m, r in zip(most, rows)]
    return spark.createDataFrame([tuple(p.values()) for p in picks], "video_id string, place int, gain double, breadth double, diversity double")
