"""Queries that ask for the same are worked out once, and their results are dealt out without a hot key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sightline.operators import appearance, relations, retrieve
from sightline.plans import queries_retrieve
from sightline.plans.queries import QUERIES
from sightline.streaming import evidence

SF = "/root/testdata/sf0.001"
#: query -> (module, operator, the argument that has a row or more a query)
ONCE = {
    "j17_matched_tuples": (relations, "matched_tuples", 1),
    "j23_pattern_filter": (retrieve, "matches_pattern", 0),
    "q16_hypotheses": (retrieve, "fuse_hypotheses", 0),
    "q4_ocr_scores": (retrieve, "lexical_scores", 0),
    "q2_baselines": (retrieve, "entity_scores", 0),
    "q13_localized": (queries_retrieve.localize, "combine", 0),
    "q18_without_actions": (retrieve, "fuse", 1),
    "q19_method_comparison": (retrieve, "fuse", 1),
    "q5_entity_scores": (retrieve, "entity_scores", 0),
    "q6_action_scores": (retrieve, "action_scores", 0),
    "t9_grounding_context": (retrieve, "ranked", 0),
    "t3_collapsed_moments": (retrieve, "collapse_moments", 0),
    "q15_interpretations": (retrieve, "interpretations", 0),
}


@pytest.mark.parametrize("name", ONCE)
def test_operators_see_each_distinct_plan_once(spark, monkeypatch, name):
    module, operator, place = ONCE[name]
    plain, seen = getattr(module, operator), []

    def watched(*args, **kwargs):
        seen.append(args[place].select("query_id").distinct().count())
        return plain(*args, **kwargs)

    monkeypatch.setattr(module, operator, watched)
    rows = QUERIES[name](spark, SF)
    asked = queries_retrieve.plans(spark, SF).count()
    assert seen and max(seen) < asked
    assert 0 < rows.select("query_id").distinct().count() <= asked


def test_a_plan_of_many_queries_is_dealt_out(spark):
    found = spark.range(300).select(F.lit(0).cast("long").alias("query_id"), F.concat(F.lit("s"), "id").alias("segment_id"), F.col("id").alias("score"))
    members = spark.range(40).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("plan_id"))
    out = queries_retrieve.for_all_queries(found, members)
    rows = {(r.query_id, r.segment_id, r.score) for r in out.collect()}
    assert out.columns == found.columns and rows == {(q, f"s{i}", i) for q in range(40) for i in range(300)} and out.count() == 12_000
    largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 3_000


@pytest.mark.parametrize("name", ["q14_reliability", "q10_fused_scores", "q18_without_tuples", "q9_appearance_scores", "q7_relation_scores", "q12_evidence_candidates"])
def test_results_of_queries_are_not_shuffled(spark, monkeypatch, name):
    plain, results = queries_retrieve.for_all_queries, []
    monkeypatch.setattr(queries_retrieve, "for_all_queries", lambda found, members: results.append(found.count()) or plain(found, members))
    assert QUERIES[name](spark, SF).count() >= results[0] > 0


def test_blending_meets_only_windows_that_are_results(spark):
    plans = spark.createDataFrame([(q, "action_search", ["sit", "stand"] if q else ["sit"]) for q in range(3)], "query_id long, intent string, actions array<string>")
    index = spark.createDataFrame([("a", "sit", 0.5), ("a", "stand", 0.7), ("b", "sit", 0.9)], "segment_id string, label string, confidence double")
    results = spark.createDataFrame([(0, "b", 0.5), (1, "a", 0.5), (1, "b", 0.5), (2, "c", 0.5)], "query_id long, segment_id string, score double")
    out = retrieve.blend_with_index(results, index, plans)
    assert {(r.query_id, r.segment_id): round(r.score, 6) for r in out.collect()} == {(0, "b"): 0.58, (1, "a"): 0.52, (1, "b"): 0.5, (2, "c"): 0.5}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "need" in x]
    assert joins and all("segment_id" in x for x in joins)


def test_best_relations_are_those_of_all_relations(spark):
    index = queries_retrieve.Index(spark, SF)
    p = queries_retrieve.distinct_plans(queries_retrieve.evidence_plans(spark, SF), queries_retrieve.EVIDENCE_NEEDS)[0]
    got = {(r.segment_id, r.kind, r.need): round(r.confidence, 9) for r in queries_retrieve._best_relations(p, index).collect()}
    placed = {r.detection_id: (r.segment_id, r.class_label) for r in index.detections.collect()}
    tuples = {r.need for r in queries_retrieve.keyed_tuples(p).collect()}
    predicates = {x for r in p.collect() for x in r.predicates}
    want: dict = {}
    for r in relations.spatial_relations(index._detections).collect():
        (s, a), (_, b) = placed[r.source_id], placed[r.target_id]
        a, b = sorted((a, b)) if r.predicate in ("near", "overlaps_with") else (a, b)
        for kind, need, named in (("tuple", f"{r.predicate}|{a}|{b}", tuples), ("predicate", r.predicate, predicates)):
            if need in named:
                want[s, kind, need] = max(want.get((s, kind, need), 0.0), round(r.confidence, 9))
    assert got == want and want


def test_detections_without_an_id_have_no_common_key(spark):
    d = spark.range(2_000).select((F.col("id") % 50).cast("string").alias("video_id"), (F.col("id") % 7).cast("string").alias("track_id"), F.lit(None).cast("long").alias("appearance_id"), "id")
    d = d.union(spark.createDataFrame([("0", "0", 5, 9_999)], "video_id string, track_id string, appearance_id long, id long"))
    records = spark.createDataFrame([(3, "1", "1"), (5, "9", "9")], "appearance_id long, video_id string, track_id string")
    out = appearance.attached(d, records)
    assert {r.id: r.appearance_id for r in out.filter("appearance_id is not null").collect()} == {i: 3 for i in range(2_000) if i % 50 == 1 and i % 7 == 1} | {9_999: 5}
    assert out.count() == 2_001
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "LeftOuter" in x and "appearance_id" in x]
    assert joins and all("spread" in x for x in joins)


@pytest.mark.parametrize("few", [0, 64])
def test_few_terms_are_tested_where_texts_pass_by(spark, monkeypatch, few):
    monkeypatch.setattr(retrieve, "FEW_TERMS", few)
    plans = spark.createDataFrame([(1, ["the", "a.b"]), (2, ["zz"]), (3, ["the"])], "query_id long, terms array<string>")
    texts = spark.createDataFrame([("s", "OTHER things"), ("s", "the end"), ("t", "xa.bx"), ("u", None)], "segment_id string, text string")
    rows = retrieve.segments_containing(plans, texts, "terms")
    assert sorted((r.query_id, r.need, r.segment_id) for r in rows.collect()) == [(1, "a.b", "t"), (1, "the", "s"), (3, "the", "s")]
    assert ("token" in rows._jdf.queryExecution().analyzed().toString()) == (few == 0)


def test_diagnostics_make_relations_once(spark, monkeypatch):
    plain, made = relations.placed_relations, []
    monkeypatch.setattr(relations, "placed_relations", lambda *a, **k: made.append(1) or plain(*a, **k))
    assert QUERIES["q20_diagnostics"](spark, SF).count() == queries_retrieve.plans(spark, SF).count()
    assert made == [1]


def test_a_list_of_terms_stands_once(spark, monkeypatch):
    plain, seen = evidence.standing_queries, []
    monkeypatch.setattr(evidence, "standing_queries", lambda tokens, queries: seen.append(queries.select("query_id").distinct().count()) or plain(tokens, queries))
    answered = QUERIES["r6_standing_queries"](spark, SF).select("query_id").distinct().count()
    assert 0 < seen[0] < answered
