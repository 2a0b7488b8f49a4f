from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import following, tracks
from sightline.plans.queries import QUERIES

COLUMNS = "detection_id long, video_id string, timestamp double, class_label string, x1 double, y1 double, x2 double, y2 double, confidence double"


def _boxes(spark, rows):
    return spark.createDataFrame([(i, v, t, c, x, 0.1, x + 0.2, 0.5, 0.9) for i, v, t, c, x in rows], COLUMNS)


def test_tracks_follow_class_and_gap(spark):
    rows = [(1, "a", 0.0, "person", 0.1), (2, "a", 1.0, "person", 0.12), (3, "a", 1.0, "cup", 0.12), (4, "a", 4.0, "person", 0.12), (5, "b", 0.0, "person", 0.1)]
    got = {r.detection_id: (r.ordinal, r.track_id) for r in tracks.track(_boxes(spark, rows)).collect()}
    assert got[1] == got[2]
    assert got[3][0] == 1 and got[4][0] == 2 and got[5][0] == 0
    assert got[5][1] != got[1][1]


def test_splitting_at_gaps_changes_nothing(spark):
    """Ordinals run on over the stretches of a video as if it had been walked whole."""
    rows = [(i, "a", float(t), "person", 0.1 + 0.2 * k) for i, (t, k) in enumerate((t, k) for t in (0, 1, 5, 6, 20) for k in range(2))]
    got = [r.ordinal for r in tracks.track(_boxes(spark, rows)).orderBy("detection_id").collect()]
    assert got == [0, 1, 0, 1, 2, 3, 2, 3, 4, 5]


@given(st.integers(0, 5), st.integers(0, 5), st.integers(1, 4), st.randoms())
@settings(max_examples=200, deadline=None)
def test_dominant_pairs_are_the_greedy_choice(n, m, levels, rng):
    scores = np.array([[rng.randint(0, levels) / levels for _ in range(m)] for _ in range(n)]).reshape(n, m)
    allowed = np.array([[rng.random() < 0.7 for _ in range(m)] for _ in range(n)], bool).reshape(n, m)
    want, left = set(), {(i, j) for i in range(n) for j in range(m) if allowed[i, j]}
    while left:
        i, j = min(left, key=lambda p: (-scores[p], *p))
        want.add((i, j))
        left = {p for p in left if p[0] != i and p[1] != j}
    got = following.dominant_pairs(scores, allowed)
    assert set(zip(got[0].tolist(), got[1].tolist())) == want and len(got[0]) == len(want)


def test_tracks_equal_a_plain_walk_over_a_crowd(spark):
    """Crowded frames, equal scores, two videos; a plain walk over each video's rows is the judge."""
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(rng.integers(0, 12)), ["person", "cup"][int(rng.integers(2))], float(rng.integers(0, 8)) / 10) for i in range(400)]
    df = _boxes(spark, rows)
    got = {r.detection_id: r.ordinal for r in tracks.track(df).collect()}
    want = {}
    for video in "ab":
        live, made = {}, 0
        mine = sorted((t, i, c, x) for i, v, t, c, x in rows if v == video)
        for t in sorted({r[0] for r in mine}):
            live = {k: v for k, v in live.items() if t - v[0] <= 1.5}
            frame = [r for r in mine if r[0] == t]
            options = []
            for n, (_, c, x) in live.items():
                for _, i, d, y in frame:
                    shared = max(0.0, min(x + 0.2, y + 0.2) - max(x, y)) * (0.5 - 0.1)
                    overlap = shared / ((y + 0.2 - y) * (0.5 - 0.1) + (x + 0.2 - x) * (0.5 - 0.1) - shared)
                    apart = abs((y + (y + 0.2)) / 2 - (x + (x + 0.2)) / 2)
                    if c == d and (overlap >= 0.3 or apart <= 0.15):
                        options.append((-(overlap + 0.25 * max(0.0, 1.0 - apart / 0.15)), n, i))
            of = {}
            for _, n, i in sorted(options):
                if n not in of.values() and i not in of:
                    of[i] = n
            for _, i, c, x in frame:
                if i not in of:
                    of[i], made = made, made + 1
                live[of[i]] = (t, c, x)
            want |= of
    assert got == want


def test_local_tracks_equal_a_plain_walk(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], float(rng.integers(0, 30)), [None, None, None, "p1", "p2"][int(rng.integers(5))], float(rng.integers(0, 16)) / 16, float(rng.integers(0, 4)) / 16) for i in range(300)]
    df = spark.createDataFrame([(i, v, t, n, x, y, x + 0.25, y + 0.25) for i, v, t, n, x, y in rows], "detection_id long, video_id string, timestamp double, annotated string, x1 double, y1 double, x2 double, y2 double").repartition(3)
    want = {}
    for video in "ab":
        previous, made = {}, 0
        mine = sorted((t, i, n, x, y) for i, v, t, n, x, y in rows if v == video)
        for now in sorted({r[0] for r in mine}):
            used = set()
            for _, i, name, x, y in (r for r in mine if r[0] == now):
                if name is None:
                    best, most = None, 0.0
                    for track, (when, px, py) in previous.items():
                        shared = max(0.0, 0.25 - abs(x - px)) * max(0.0, 0.25 - abs(y - py))
                        iou = shared / (0.125 - shared)
                        if now - when <= 2.1 and track not in used and iou > most:
                            best, most = track, iou
                    if most >= 0.3:
                        name = best
                    else:
                        name, made = f"local:{made}", made + 1
                used.add(name)
                previous[name] = (now, x, y)
                want[i] = f"{video}:{name}"
    got = {r.detection_id: r.track_id for r in tracks.local_tracks(df).collect()}
    assert got == want and len(set(want.values())) > 10


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] if x == y else row[j - 1] + 2))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_indel_similarity(a, b):
    total = len(a) + len(b)
    expected = 1.0 if not total else 1 - _distance(a, b) / total
    assert abs(following.indel_similarity(a, b) - expected) < 1e-12


def test_ocr_readings_merge_when_close_in_time_and_text(spark):
    rows = [(1, "a", 0.0, "Project Budget 2024", 0.8), (2, "a", 1.0, "Project Budget 2O24", 0.6), (3, "a", 5.0, "Project Budget 2024", 0.9), (4, "a", 1.0, "x", 0.9), (5, "a", 1.0, "something else", 0.1)]
    df = spark.createDataFrame(rows, "token_id long, video_id string, timestamp double, raw_text string, raw_confidence double")
    got = sorted((r.start_time, r.end_time, r.observations, round(r.confidence, 3)) for r in tracks.merge_ocr(df).collect())
    assert got == [(0.0, 2.0, 2, 0.7), (5.0, 6.0, 1, 0.9)]


@given(st.lists(st.tuples(st.integers(0, 6), st.text("abc", min_size=2, max_size=9)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_bounds_leave_text_merging_as_it_is(readings):
    rows = [{"token_id": i, "timestamp": float(t), "text": x, "confidence": 0.5} for i, (t, x) in enumerate(sorted(readings))]
    seen = []
    for r in rows:
        found = next((s for s in reversed(seen) if r["timestamp"] - s[2] <= 1.5 and following.indel_similarity(r["text"], s[0]) >= 0.7), None)
        if found:
            found[2:] = [r["timestamp"], found[3] + 1]
        else:
            seen.append([r["text"], r["timestamp"], r["timestamp"], 1])
    if rows:
        columns = ("video_id", "stretch", "timestamp", "token_id", "text", "confidence")
        batches = pa.Table.from_pylist([{c: (r | {"video_id": "a", "stretch": 0})[c] for c in columns} for r in rows]).to_batches(max_chunksize=3)
        got = [r for b in tracks._merged(1.0, 0.7)(iter(batches)) for r in b.to_pylist()]
        assert sorted([r["text"], r["start_time"], r["end_time"] - 1.0, r["observations"]] for r in got) == sorted(seen)


@given(st.text("ab", max_size=120), st.text("ab", max_size=120), st.floats(0.3, 1.0))
@settings(max_examples=300, deadline=None)
def test_early_end_never_loses_a_likeness(a, b, similarity):
    if a or b:
        texts = following.TextTracks(1.5, similarity)
        assert texts._alike(a, following.signatures([a])[0], b, following.signatures(["x", b])[1]) == (following.indel_similarity(a, b) >= similarity)


def test_merging_query_reads_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    lines = [(r.doc_id, x) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and doc_id%10<>0").collect() for x in r.text.split("\n")]
    read = [x for _, t in lines if len(x := " ".join(re.sub(r"[^\w\-./]+", " ", t.strip().lower()).split())) >= 2]
    got = QUERIES["w12_merge_ocr"](spark, sf).collect()
    assert sum(r.observations for r in got) == len(read)
    assert {r.text for r in got} <= set(read) and max(len(r.text) for r in got) == max(map(len, read))


def test_stretches(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 9, 10)], "video_id string, timestamp double")
    got = [r.stretch for r in tracks.with_stretches(df, 1.5).orderBy("timestamp").collect()]
    assert got == [0, 0, 0, 1, 1]
    assert all(b >= a for a, b in pairwise(got))


def test_pooling_uses_near_neighbours_only(spark):
    df = spark.createDataFrame([("a", 0.0, [1.0, 0.0]), ("a", 1.0, [0.0, 1.0]), ("a", 9.0, [1.0, 0.0])], "video_id string, time double, vector array<double>")
    got = {r.time: r.vector for r in tracks.pooled(df).collect()}
    assert got[9.0] == [1.0, 0.0]
    # .25 p + .5 own + .25 n + .25 (n - p) with p = own for the first row
    x = [0.25 + 0.5 + 0.0 - 0.25, 0.25 + 0.25]
    norm = sum(v * v for v in x) ** 0.5
    assert all(abs(a - b / norm) < 1e-9 for a, b in zip(got[0.0], x))
    assert tracks.three_steps(df).filter(F.size("steps") == 3).count() == 3
