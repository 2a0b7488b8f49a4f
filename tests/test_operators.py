from __future__ import annotations

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import align, datasets, evaluate, localize, retrieve, tagging, tracks
from sightline.plans.queries import QUERIES
from sightline.sources import readers, sinks
from sightline.streaming import evidence


def test_windows_clamp_and_zero_lengths(spark):
    segments = align.spine(spark.createDataFrame([("a", 12.0)], "video_id string, end_time double"))
    assert [(r.start_time, r.end_time) for r in segments.orderBy("idx").collect()] == [(0.0, 5.0), (5.0, 10.0), (10.0, 12.0)]
    points = spark.createDataFrame([("a", 15.0), ("a", 10.0), ("a", 0.0)], "video_id string, timestamp double")
    assert sorted(r.idx for r in align.place_points(points, segments).collect()) == [0, 2, 2]
    spans = spark.createDataFrame([("a", 4.0, 5.0), ("a", 4.0, 6.0), ("a", 7.0, 7.0)], "video_id string, start_time double, end_time double")
    assert align.place_intervals(spans, segments, positive=True).count() == 3  # the empty one drops out
    assert align.place_intervals(spans, segments).count() == 4


def test_metrics_claim_each_moment_once(spark):
    results = spark.createDataFrame([("m", 1, k, "v", 0.0, 5.0) for k in (1, 2, 3)], "method string, query_id long, rank long, video_id string, start_time double, end_time double")
    relevant = spark.createDataFrame([(1, 0, "v", 1.0, 2.0, 1.5, 2.0, "c"), (1, 1, "v", 3.0, 4.0, 3.5, 2.0, "c"), (1, 2, "v", 90.0, 91.0, 90.5, 2.0, "c")], "query_id long, moment long, video_id string, start_time double, end_time double, peak_time double, tolerance double, category string")
    m = evaluate.query_metrics(results, relevant).first()
    assert (m.p_at_1, m.p_at_5, round(m.r_at_5, 6), m.mrr) == (1.0, 0.6, round(2 / 3, 6), 1.0)


def test_collapse_only_kept_results_suppress(spark):
    rows = [(1, 1, "v", "a", 1.0), (1, 2, "v", "b", 1.4), (1, 3, "v", "c", 1.8), (1, 4, "w", "d", 1.0)]
    df = spark.createDataFrame(rows, "query_id long, rank int, video_id string, segment_id string, peak_time double")
    assert sorted(r.segment_id for r in retrieve.collapse_moments(df).collect()) == ["a", "c", "d"]


def test_combining_agreement_and_disagreement(spark):
    pairs = spark.createDataFrame([(1, "s", 0.0, 5.0), (2, "s", 0.0, 5.0), (3, "s", 0.0, 5.0)], "query_id long, segment_id string, start_time double, end_time double")
    rows = [(1, "s", 2.0, 1.5, 2.5, 1, 0.8, "x"), (1, "s", 2.1, 2.0, 4.0, 4, 0.4, "y"), (2, "s", 1.0, 1.0, 1.2, 1, 0.8, "x"), (2, "s", 4.0, 4.0, 5.0, 4, 0.4, "y")]
    c = spark.createDataFrame(rows, "query_id long, segment_id string, peak double, start double, end double, rank int, confidence double, source string")
    got = {r.query_id: r for r in localize.combine(pairs, c).collect()}
    assert got[1].source == "x+agreement" and got[1].peak_time == 2.0 and abs(got[1].localization_confidence - 0.66) < 1e-9
    assert got[2].source == "x+disagreement" and abs(got[2].localization_confidence - 0.42) < 1e-9
    assert got[3].source == "segment_window" and got[3].precision == "segment"


def test_query_texts(spark):
    lexicon = spark.createDataFrame([("cell phone", "entity", "cell phone"), ("phone", "entity", "telephone"), ("drive", "action", "drive"), ("laptop", "entity", "laptop")], "phrase string, kind string, canonical string")
    texts = [(1, "find drive"), (2, "where did they say drive?"), (3, "the laptop scene"), (4, "deployment"), (5, "a cell phone"), (6, None)]
    plans = tagging.plans_of(spark.createDataFrame(texts, "query_id long, text string"), lexicon)
    got = {r.query_id: r for r in plans.collect()}
    assert got[1].intent == "action_search" and got[2].intent == "transcript_search" and got[5].entities == ["cell phone"]
    readings = {}
    for r in tagging.readings(plans).collect():
        readings.setdefault(r.query_id, {})[r.hypothesis_id] = round(r.prior, 2)
    assert readings[1] == {"visible_action": 0.5, "spoken_mention": 0.5}
    assert readings[3] == {"visible_object": 0.6, "spoken_mention": 0.4}
    assert readings[4] == {"spoken_mention": 0.6, "visible_text": 0.4}
    assert 2 not in readings and 6 not in readings


def test_auroc_gives_half_credit_for_ties(spark):
    rows = [("m", True, 0.9), ("m", True, 0.5), ("m", False, 0.5), ("m", False, 0.1)]
    df = spark.createDataFrame(rows, "method string, positive boolean, confidence double")
    assert evaluate.auroc(df).first().auroc == (1 + 1 + 0.5 + 1) / 4


def test_word_errors(spark):
    df = spark.createDataFrame([("a", "we drive the plan", "we drove the plan now"), ("a", "yes", "yes")], "system string, reference string, hypothesis string")
    assert abs(evaluate.word_error_rates(df).first().wer - 0.25) < 1e-9


def test_nearest_vectors_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.vec_id) for r in datasets.nearest_vectors(q, v, k=5, tables=24, bits=4).collect()}
    rows = {r.vec_id: r.vector for r in v.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, j) for i in rows if i % 50 == 0 for j in sorted(rows, key=lambda j: (-dot(rows[i], rows[j]), j))[:5]}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nearest_vectors_query_misses_none(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, m = np.array([r.vec_id for r in v]), np.array([r.embedding for r in v], np.float64)
    got = {}
    for r in QUERIES["q3_nearest_vectors"](spark, f"/root/testdata/{sf}").orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    asked = ids % 50 == 0
    want = np.argsort(-np.round(m[asked] @ m.T, 12), axis=1, kind="stable")[:, :10]
    assert got == {q: ids[w].tolist() for q, w in zip(ids[asked].tolist(), want)}


def test_nearest_vectors_over_many_blocks(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 != 0)]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<float>").repartition(3)
    got = datasets.all_nearest_vectors(v.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), v, k=4, query_block=2, vector_block=3)
    assert {(r.query_id, r.place, r.vec_id) for r in got.collect()} == {(q, p + 1, i) for q in range(5) for p, i in enumerate([i for i in range(40) if (i % 3 == 0) == (q % 3 == 0)][:4])}


def test_relations_are_hard_needs_with_one_contribution_each(spark):
    matched = spark.createDataFrame([(1, 0, "s", 0.4, "g"), (1, 1, "s", 0.8, "g"), (1, 0, "t", 0.9, "g")], "query_id long, need_id int, segment_id string, confidence double, source_method string")
    got = sorted((r.segment_id, r.weight, round(r.value, 6), r.raw_score) for r in retrieve.relation_scores(matched, matched.select("query_id", "need_id").distinct()).collect())
    assert got == [("s", 0.0, 0.6, 0.8), ("s", 1.0, 0.6, 0.4)]


def test_search_asks_for_relations_and_screen_text(spark):
    sf = "/root/testdata/sf0.001"
    assert {r.modality for r in QUERIES["q4_ocr_scores"](spark, sf).select("modality").distinct().collect()} == {"ocr", "semantic"}
    assert QUERIES["q7_relation_scores"](spark, sf).count() > 0


def test_pattern_takes_first_segments_by_time(spark):
    met = spark.createDataFrame([(1, "entity", "cup", f"v:{t}:x") for t in (5000, 10000, 20000)] + [(1, "ocr", "plan", "v:5000:x"), (1, "ocr", "plan", "v:10000:x")], "query_id long, kind string, need string, segment_id string")
    segments = spark.createDataFrame([(f"v:{t}:x", t / 1000) for t in (5000, 10000, 20000)], "segment_id string, start_time double")
    sizes = spark.createDataFrame([(1, 2)], "query_id long, n long")
    assert [r.segment_id for r in retrieve.matches_whole_pattern(met, sizes, segments, 1).collect()] == ["v:5000:x"]
    plans = spark.createDataFrame([(1, ["udget 20", "an"])], "query_id long, terms array<string>")
    texts = spark.createDataFrame([("a", "Budget 2024"), ("b", "a plan"), ("c", "budge 20")], "segment_id string, text string")
    assert {(r.need, r.segment_id) for r in retrieve.segments_containing(plans, texts, "terms").collect()} == {("udget 20", "a"), ("an", "b")}


def test_queries_use_the_whole_bounds(spark, monkeypatch):
    asked = {}
    whole, cover = evaluate.bootstrap_interval, datasets.coverage_selection
    monkeypatch.setattr(evaluate, "bootstrap_interval", lambda values, **given: asked.update(samples=given.get("samples", inspect.signature(whole).parameters["samples"].default)))
    monkeypatch.setattr(datasets, "coverage_selection", lambda counts, targets, most: asked.update(most=most) or cover(counts, targets, 1))
    QUERIES["a18_bootstrap"](spark, "/root/testdata/sf0.001")
    QUERIES["d4_coverage_selection"](spark, "/root/testdata/sf0.001")
    assert asked == {"samples": 2000, "most": 30}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "v1.rttm").write_text("SPEAKER waveform 1 29.174 2.582 <NA> <NA> SPEAKER_00 <NA> <NA>\nbad line\n")
    turn = readers.rttm_turns(spark, f"file://{tmp_path}/v1.rttm").first()
    assert (turn.video_id, turn.start_time, round(turn.end_time, 3), turn.speaker) == ("v1", 29.174, 31.756, "SPEAKER_00")
    cue = readers.srt_text(spark.createDataFrame([("v1", 61.5, 62.25, "SPEAKER_01")], "video_id string, start_time double, end_time double, speaker string")).first().value
    assert cue.startswith("1\n00:01:01,500 --> 00:01:02,250\n")
    (tmp_path / "v2.srt").write_text(cue + "\n2\n00:00:01,000 --> 00:00:02,000\nSPEAKER_00: hello\n")
    back = sorted((r.start_time, r.speaker) for r in readers.srt_cues(spark, f"file://{tmp_path}/v2.srt").collect())
    assert back == [(1.0, "SPEAKER_00"), (61.5, "SPEAKER_01")]
    (tmp_path / "a.csv").write_text("v,1.0,0,0,1,1,12,e\nv,bad,0,0,1,1,12,e\nv,2.0,0,0\n")
    assert readers.annotation_csv(spark, f"file://{tmp_path}/a.csv").count() == 1


def test_replacing_videos_twice_is_replacing_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_videos(spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, n int"), path)
    fresh = spark.createDataFrame([("a", 5)], "video_id string, n int")
    for _ in range(2):
        sinks.replace_videos(fresh, path)
    assert sorted((r.video_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]


def _streamed(spark, df, form, folder, files):
    """Runs a stream over ``df`` in several batches; a last row an hour later lets the watermark pass all others."""
    for i, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
    stream = form(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
    return evidence.drained(stream, f"{folder}/out", "append")


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_tracks_equal_the_batch_form(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for t in range(8, 32):
        for _ in range(rng.choice([0, 1, 3, 5])):
            x, y = rng.random() * 0.5, rng.random() * 0.5
            rows.append((len(rows), rng.choice(["a", "b"]), float(t), rng.choice(["person", "Person ", "cup"]), x, y, x + 0.25, y + 0.3))
    rows += [(10_000 + i, v, 9000.0, c, 0.0, 0.0, 0.1, 0.1) for i, (v, c) in enumerate((v, c) for v in "abz" for c in ("person", "cup"))]
    df = spark.createDataFrame(rows, "detection_id long, video_id string, timestamp double, class_label string, x1 double, y1 double, x2 double, y2 double")
    timed = df.withColumn("ts", F.timestamp_seconds("timestamp"))
    # rows come up to four seconds late, within a file in any order
    files = [timed.filter(F.expr(f"floor((timestamp + pmod(hash(detection_id), 4)) / 8) = {k}")).orderBy(F.rand(seed)) for k in range(1, 5)] + [timed.filter("timestamp = 9000")]
    got = _streamed(spark, timed, lambda s: evidence.track_stream(s, "12 seconds"), str(tmp_path), files)
    groups = {}
    for r in tracks.track(df).filter("timestamp < 9000").collect():
        groups.setdefault(r.track_id, []).append(r.detection_id)
    first = {r.detection_id: r.timestamp for r in df.collect()}
    want = {d: min(g, key=lambda i: (first[i], i)) for g in groups.values() for d in g}
    assert {r.detection_id: r.first_id for r in got.collect() if r.detection_id < 10_000} == want


def test_streamed_texts_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    lines = ["Project Budget 2024", "Project Budget 2O24", "quarterly results of the north", "quarterly results of the south", "Welcome", "welcome!"]
    rows = [(i, rng.choice("ab"), float(rng.randint(6, 26)), rng.choice(lines), rng.choice([0.2, 0.5, 0.9])) for i in range(120)]
    rows += [(1000 + i, v, 9000.0, "the end", 0.9) for i, v in enumerate("ab")]
    df = spark.createDataFrame(rows, "token_id long, video_id string, timestamp double, raw_text string, raw_confidence double")
    timed = df.withColumn("ts", F.timestamp_seconds("timestamp"))
    files = [timed.filter(f"floor(timestamp / 6) = {k}") for k in range(1, 5)] + [timed.filter("timestamp = 9000")]
    got = _streamed(spark, timed, evidence.ocr_stream, str(tmp_path), files).filter("start_time < 9000")
    want = tracks.merge_ocr(df).filter("start_time < 9000")
    shape = lambda rows: sorted((r.video_id, r.ocr_id, r.text, r.start_time, r.end_time, round(r.confidence, 9), r.observations) for r in rows)
    assert shape(got.collect()) == shape(want.collect())
