"""Parts of the search against brute force: looks, best vectors, moments, pairs of crowded frames."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import appearance, relations, retrieve
from sightline.plans import queries_retrieve

BOXES = "video_id string, frame_id string, timestamp double, detection_id long, class_label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def _crowd(spark, seed, sizes):
    rng, rows = random.Random(seed), []
    for f, n in enumerate(sizes):
        for _ in range(n):
            x, y, w, h = rng.random() * 0.9, rng.random() * 0.9, rng.choice([0.02, 0.05, 0.3]), rng.choice([0.0, 0.04, 0.2])
            rows.append(("v", f"f{f}", float(f), len(rows), "person", 0.9, x, y, x + w, y + h))
    return rows, spark.createDataFrame(rows, BOXES)


def _pairs(rows):
    return [(a, b) for a in rows for b in rows if a[1] == b[1] and a[3] != b[3]]


def _distance(a, b):
    return math.hypot((a[6] + a[8]) / 2 - (b[6] + b[8]) / 2, (a[7] + a[9]) / 2 - (b[7] + b[9]) / 2)


@pytest.mark.parametrize("reach", [0.03, 0.2, 0.9])
def test_near_pairs_of_crowded_frames(spark, reach):
    rows, df = _crowd(spark, 1, [60, 1, 25])
    got = [(r.a_detection_id, r.b_detection_id) for r in relations.near_pairs(df, reach).collect()]
    want = {(a[3], b[3]) for a, b in _pairs(rows) if _distance(a, b) <= reach}
    assert len(got) == len(set(got)) and set(got) == want


def test_touching_pairs_of_crowded_frames(spark):
    rows, df = _crowd(spark, 2, [70, 30])
    got = [(r.a_detection_id, r.b_detection_id) for r in relations.touching_pairs(df).collect()]
    want = {(a[3], b[3]) for a, b in _pairs(rows) if min(a[8], b[8]) > max(a[6], b[6]) and min(a[9], b[9]) > max(a[7], b[7])}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_ring_search_finds_the_nearest(spark):
    rows, df = _crowd(spark, 3, [400, 3, 40])
    got = {(r.source_id, r["rank"]): r.target_id for r in relations.neighbours(df, k=2, reach=0.5).collect()}
    want = {}
    for a in rows:
        near = sorted((_distance(a, b), b[3]) for x, b in _pairs([r for r in rows if r[1] == a[1]]) if x == a and _distance(a, b) <= 0.5)
        want |= {(a[3], i + 1): b for i, (_, b) in enumerate(near[:2])}
    assert got == want


def test_crowds_make_few_rows(spark):
    _, df = _crowd(spark, 4, [500])
    assert relations.near_pairs(df, 0.02).count() < 3_000


@pytest.mark.parametrize("gap", [0.5, 3.0])
def test_moments_are_walked_by_rank(spark, gap):
    rng = random.Random(7)
    rows = [(q, rank + 1, rng.choice("ab"), f"s{rank}", rng.randrange(0, 160) / 4) for q in range(3) for rank in range(60)]
    got = {(r.query_id, r["rank"]) for r in retrieve.collapse_moments(spark.createDataFrame(rows, "query_id long, rank int, video_id string, segment_id string, peak_time double"), gap).collect()}
    want, kept = set(), {}
    for q, rank, v, _, t in sorted(rows):
        if all(abs(t - x) > gap for x in kept.get((q, v), [])):
            kept.setdefault((q, v), []).append(t)
            want.add((q, rank))
    assert got == want


@pytest.mark.parametrize("block", [2, 16])
def test_best_vectors_without_scoring_all(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "BLOCK_SEGMENTS", block)
    rng = random.Random(block)
    vectors = {f"s{i}": {rng.randrange(40): rng.choice([-1, 1]) * rng.random() for _ in range(rng.randint(1, 6))} for i in range(300)}
    queries = {q: {rng.randrange(40): rng.uniform(-1, 1) for _ in range(3)} for q in range(12)}
    entries = spark.createDataFrame([(s, i, x) for s, v in vectors.items() for i, x in v.items()], "segment_id string, idx int, val double")
    wanted = spark.createDataFrame([(q, i, x) for q, v in queries.items() for i, x in v.items()], "query_id long, idx int, val double")
    rows = retrieve.top_vectors(wanted, *retrieve.block_max_index(entries), 5).collect()
    for q, v in queries.items():
        scores = sorted((-round(min(1.0, sum(x * vectors[s].get(i, 0) for i, x in v.items())), 6), s) for s in vectors)
        want = [s for x, s in scores if x < 0][:5]
        assert [r.segment_id for r in sorted(rows, key=lambda r: r.place) if r.query_id == q] == want
    assert sum(r.blocks_scored for r in rows) < 0.8 * sum(r.blocks_met for r in rows)


def _looks(spark, looks, records, traits, placed, descriptions=()):
    frames = {
        "looks": spark.createDataFrame([(1, n, kind, d, wishes) for n, kind, d, wishes in looks], "query_id long, constraint_id int, entity_class string, description_id long, wishes array<struct<name:string,value:string>>"),
        "scope": spark.createDataFrame([(1, s) for s in {s for s, _ in placed} | {"empty"}], "query_id long, segment_id string"),
        "placed": spark.createDataFrame(placed, "segment_id string, appearance_id long"),
        "records": spark.createDataFrame([(i, c, v, m, n) for i, c, v, m, n in records], "appearance_id long, class_label string, vector array<double>, model string, observations int"),
        "known": spark.createDataFrame(traits, "appearance_id long, name string, value string, confidence double"),
        "descriptions": spark.createDataFrame(list(descriptions), "description_id long, vector array<double>"),
    }
    return {(r.segment_id, r.constraint_id): (round(r.value, 4), r.source_method, r.appearance_id) for r in appearance.appearance_matches(**frames, model="m").collect()}


def test_attributes_agree_contradict_or_are_unknown(spark):
    records = [(i, "person", [1.0, 0.0], "m", i) for i in range(1, 6)]
    traits = [(1, "color", "red", 0.8), (2, "color", "blue", 0.9), (3, "color", "red", 0.3), (4, "color", "red", 0.8), (4, "bag", "no", 0.9), (5, "color", "red", 0.8)]
    placed = [("red", 1), ("red", 5), ("blue", 2), ("both", 1), ("both", 2), ("unsure", 3), ("bagless", 4)]
    got = _looks(spark, [(0, "person", None, [("color", "red"), ("bag", "yes")])], records, traits, placed)
    attribute = "visual_attribute_model"
    # of equal matches the record of more observations counts; a contradiction in all records drops the segment
    assert got == {("red", 0): (0.8, attribute, 5), ("both", 0): (0.8, attribute, 1), ("unsure", 0): (0.15, attribute, None), ("empty", 0): (0.15, attribute, None)}


def test_descriptions_have_a_floor(spark):
    records = [(1, "cup", [1.0, 0.0], "m", 1), (2, "cup", [0.0, 1.0], "m", 1), (3, "cup", [1.0, 0.1], "other", 1), (4, "cup", [1.0, 1.0], "m", 1)]
    placed = [("like", 1), ("like", 4), ("unlike", 2), ("other model", 3)]
    got = _looks(spark, [(0, "cup", 9, [])], records, [(1, "color", "red", 0.9)], placed, [(9, [2.0, 0.0])])
    assert got == {("like", 0): (1.0, "openclip_appearance", 1), ("other model", 0): (0.15, "visual_attribute_model", None), ("empty", 0): (0.15, "visual_attribute_model", None)}


def test_one_constraint_eliminates(spark):
    records = [(1, "cup", [1.0], "m", 1), (2, "person", [1.0], "m", 1)]
    traits = [(1, "color", "red", 0.9), (2, "color", "blue", 0.9)]
    got = _looks(spark, [(0, "cup", None, [("color", "red")]), (1, "person", None, [("color", "red")])], records, traits, [("s", 1), ("s", 2), ("t", 1)])
    assert got == {("t", 0): (0.9, "visual_attribute_model", 1), ("t", 1): (0.15, "visual_attribute_model", None), ("empty", 0): (0.15, "visual_attribute_model", None), ("empty", 1): (0.15, "visual_attribute_model", None)}


def test_whole_pattern_returns_all_relations_of_a_segment_if_the_query_names_none(spark):
    p, sf = queries_retrieve.evidence_plans(spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001"
    names_none = p.filter("size(tuples) = 0 AND size(predicates) = 0").select("query_id")
    rows = queries_retrieve.j23_whole_pattern(spark, sf).join(names_none, "query_id")
    found = rows.groupBy("query_id", "segment_id").agg(F.count_distinct("relationship_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("n_relations").alias("n_relations")).collect()
    assert any(r.n_relations > 1 for r in found)
    assert all(r.n == r.n_relations and r.rows == max(1, r.n) for r in found)
