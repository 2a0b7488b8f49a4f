"""Greedy choices against plain loops over all videos."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import selection


def _table(seed, videos, labels):
    rng = random.Random(seed)
    own = {f"v{i:02}": {a: rng.randint(1, 6) for a in rng.sample(range(1, labels + 1), rng.randint(1, min(5, labels)))} for i in range(videos)}
    own["v00"][99] = 3  # only here, and with support
    own["v01"][98] = 2  # only here, without
    return own


def _counts(spark, own):
    return spark.createDataFrame([(v, a, n) for v, c in own.items() for a, n in c.items()], "video_id string, action_id int, n long")


def _plain_split(own, ties, validation=0.18, test=0.18):
    support = {}
    for c in own.values():
        for a, n in c.items():
            support[a] = support.get(a, 0) + n
    eligible = {a for a, n in support.items() if n >= 3}

    def pick(count, candidates, out):
        chosen, covered = [], set()
        for _ in range(count):
            best = None
            for v in candidates - set(chosen):
                gone = out | set(chosen) | {v}
                if any(all(a not in own[x] for x in own if x not in gone) for a in eligible):
                    continue
                reward = 0.0
                for a in sorted(own[v]):
                    reward += 1 / math.sqrt(support[a]) if a not in covered else 0.0
                best = max(best or ((-1.0,), ""), ((reward, len(eligible & own[v].keys()), ties[v]), v))
            v = best[1] if best else max(candidates - set(chosen), key=ties.get)
            chosen.append(v)
            covered |= own[v].keys()
        return set(chosen)

    tested = pick(max(2, round(len(own) * test)), set(own), set())
    checked = pick(max(2, round(len(own) * validation)), set(own) - tested, tested)
    return {v: "test" if v in tested else "validation" if v in checked else "train" for v in own}


@pytest.mark.parametrize("seed, ahead, labels", [(1, 3, 12), (2, 256, 12), (3, 4, 5)])
def test_balanced_split_is_the_greedy_one(spark, seed, ahead, labels):
    own = _table(seed, 30, labels)
    df = _counts(spark, own)
    ties = {r.video_id: r.tie for r in df.select("video_id").distinct().select("video_id", F.xxhash64(F.lit(7), "video_id").alias("tie")).collect()}
    got = {r.video_id: r.split for r in selection.balanced_split(df, 7, ahead=ahead).collect()}
    assert got == _plain_split(own, ties)
    assert got["v00"] == "train"


def test_balanced_split_needs_ten_videos(spark):
    with pytest.raises(ValueError, match="ten videos"):
        selection.balanced_split(_counts(spark, _table(1, 5, 5)))


def _plain_additions(own, splits, current, size, target):
    have, of_split = {}, {"train": 0, "validation": 0}
    known, picks = [], []

    def take(v):
        known.append(set(own[v]))
        of_split[splits[v]] += 1
        for a, n in own[v].items():
            have[a] = have.get(a, 0) + n

    for v in current:
        take(v)
    while len(picks) < size and set(own) - set(current) - set(picks):
        wanted = min(("train", "validation"), key=of_split.__getitem__)
        scores = []
        for v in set(own) - set(current) - set(picks):
            gain = breadth = 0.0
            for a in sorted(own[v]):
                scale = 1 / math.sqrt(have.get(a, 0) + 1.0)
                gain += min(max(0, target - have.get(a, 0)), own[v][a]) * scale
                breadth += scale
            most = max((len(k & own[v].keys()) / len(k | own[v].keys()) for k in known), default=0.0)
            scores.append((gain, breadth, 1.0 - most, float(splits[v] == wanted), v))
        picks.append(max(scores)[-1])
        take(picks[-1])
    return picks


@pytest.mark.parametrize("seed, ahead, target", [(1, 2, 25), (2, 5, 4), (3, 256, 2)])
def test_additions_are_the_greedy_ones(spark, seed, ahead, target):
    own = _table(seed, 26, 8)
    own["v20"], own["v21"] = dict(own["v10"]), dict(own["v10"])  # ties
    splits = {v: random.Random(v).choice(["train", "validation"]) for v in own}
    current = ["v03", "v04"]
    got = selection.incremental_selection(
        _counts(spark, own), spark.createDataFrame(list(splits.items()), "video_id string, split string"), spark.createDataFrame([(v,) for v in current], "video_id string"), 9, target, ahead
    )
    assert [r.video_id for r in got.orderBy("place").collect()] == _plain_additions(own, splits, current, 9, target)
