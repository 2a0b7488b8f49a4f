"""Registered queries: merges, filters, reports, graph features and method comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import align, assemble, datasets, relations, retrieve, tagging
from sightline.plans import lexicon
from sightline.plans.frames import FRAMES, frame, rounded, with_frames
from sightline.plans.queries_align import SEGMENTS, _evidence
from sightline.plans.queries_retrieve import _ALL, COMPONENTS, Index, components, distinct_plans, for_all_queries, of_queries, plans
from sightline.sources.scratch import stored

#: Another vocabulary's names of the classes it knows.
OTHER_VOCABULARY = {"laptop": "computer", "cup": "vessel", "person": "human"}


def p5_mapped_classes(spark, sf_dir):
    mapped = assemble.mapped_labels(frame(spark, sf_dir, "detections"), lexicon.synonyms(spark, OTHER_VOCABULARY))
    return mapped.groupBy("video_id", "mapped_label").agg(F.count(F.lit(1)).alias("n"))


P5 = with_frames("detections") + " SELECT video_id, CASE class_label WHEN 'laptop' THEN 'computer' WHEN 'cup' THEN 'vessel' ELSE 'human' END AS mapped_label, count(*) AS n FROM detections WHERE class_label IN ('laptop', 'cup', 'person') GROUP BY 1, 2"


def p10_crop_candidates(spark, sf_dir):
    return assemble.fit_for_crops(frame(spark, sf_dir, "detections"), 0.5, 0.155, ("person", "laptop")).select("detection_id", "class_label")


P10 = with_frames("detections") + " SELECT detection_id, class_label FROM detections WHERE confidence >= 0.5e0 AND x2 - x1 >= 0.155e0 AND y2 - y1 >= 0.155e0 AND class_label IN ('person', 'laptop')"


def p11_scoped_runs(spark, sf_dir):
    chosen = frame(spark, sf_dir, "relevant").filter("category = 'BUILDING'")
    return assemble.scoped(frame(spark, sf_dir, "runs"), chosen, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


P11 = with_frames("runs", "relevant") + " SELECT query_id, count(*) AS n, max(score) AS best FROM runs WHERE query_id IN (SELECT query_id FROM relevant WHERE category = 'BUILDING') GROUP BY 1"


def j3_semantic_relations(spark, sf_dir):
    done = frame(spark, sf_dir, "actions").select(F.col("action_id").alias("detection_id"), F.array("label").alias("actions"))
    return relations.semantic_relations(frame(spark, sf_dir, "detections").join(done, "detection_id"), ["talk to"])


J3 = (
    with_frames("detections", "actions")
    + """ SELECT a.frame_id, a.detection_id AS source_id, b.detection_id AS target_id, CASE b.class_label WHEN 'person' THEN 'talks_to' ELSE 'interacts_with' END AS predicate
FROM detections a JOIN actions t ON t.action_id = a.detection_id AND t.label = 'talk to' JOIN detections b ON b.frame_id = a.frame_id AND b.detection_id <> a.detection_id WHERE a.class_label = 'person'"""
)


def j15_preserved_evidence(spark, sf_dir):
    start = F.expr("floor(timestamp/5)*5e0")
    fresh = frame(spark, sf_dir, "detections").groupBy("video_id", (start + 0.0002).alias("start_time")).agg(F.count(F.lit(1)).alias("detections"))
    kept = frame(spark, sf_dir, "actions").filter("source_method = 'ava_ground_truth'").groupBy("video_id", start.alias("start_time")).agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    return assemble.keyed_merge(fresh, kept).withColumn("start_time", rounded("start_time"))


J15 = (
    with_frames("detections", "actions")
    + """, f AS (SELECT video_id, floor(timestamp/5)*5e0 + 0.0002e0 AS start_time, count(*) AS detections FROM detections GROUP BY 1, 2),
k AS (SELECT video_id, floor(timestamp/5)*5e0 AS start_time, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM actions WHERE source_method = 'ava_ground_truth' GROUP BY 1, 2)
SELECT f.video_id, round(f.start_time, 4) AS start_time, detections, labels FROM f LEFT JOIN k ON k.video_id = f.video_id AND floor(k.start_time * 1000 + 0.5e0) = floor(f.start_time * 1000 + 0.5e0)"""
)

_PAIRS = "concat('s',l_suppkey) AS video_id, l_orderkey%5 AS subject, l_partkey%5 AS object"
PREDICATES = ("above", "holds", "near")


def j21_labelled_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = rows.selectExpr(*_PAIRS.split(", "), "l_linenumber AS frame").distinct()
    held = rows.selectExpr(*_PAIRS.split(", "), "CASE l_orderkey%3 WHEN 0 THEN 'above' WHEN 1 THEN 'holds' ELSE 'near' END AS predicate", "l_linenumber-1 AS begin", "l_linenumber-1+l_partkey%4 AS end")
    return assemble.labelled_pairs(pairs, held, PREDICATES).select("video_id", "subject", "object", "frame", F.concat_ws("", "labels").alias("labels"))


J21 = f"""WITH p AS (SELECT DISTINCT {_PAIRS}, l_linenumber AS frame FROM lineitem),
i AS (SELECT {_PAIRS}, CASE l_orderkey%3 WHEN 0 THEN 'above' WHEN 1 THEN 'holds' ELSE 'near' END AS predicate, l_linenumber-1 AS b, l_linenumber-1+l_partkey%4 AS e FROM lineitem),
h AS (SELECT p.*, predicate FROM p LEFT JOIN i ON i.video_id = p.video_id AND i.subject = p.subject AND i.object = p.object AND b <= frame AND frame < e)
SELECT video_id, subject, object, frame, max((coalesce(predicate, '') = 'above')::INT)::VARCHAR || max((coalesce(predicate, '') = 'holds')::INT)::VARCHAR || max((coalesce(predicate, '') = 'near')::INT)::VARCHAR AS labels FROM h GROUP BY 1, 2, 3, 4"""


def j22_prefiltered_runs(spark, sf_dir):
    r = frame(spark, sf_dir, "runs").withColumn("segment", F.struct("video_id", F.floor(F.col("start_time") / 20)))
    return assemble.scoped(r.filter("method = 'lexical'"), r.filter("method = 'hybrid' AND score > 0.5"), "segment").select("query_id", "rank_id", "score")


J22 = with_frames("runs") + " SELECT query_id, rank_id, score FROM runs r WHERE method = 'lexical' AND EXISTS (SELECT 1 FROM runs h WHERE h.method = 'hybrid' AND h.score > 0.5e0 AND h.video_id = r.video_id AND floor(h.start_time / 20) = floor(r.start_time / 20))"


def a24_calibration_observations(spark, sf_dir):
    r, relevant = frame(spark, sf_dir, "runs"), frame(spark, sf_dir, "relevant")
    moments = relevant.select("query_id", "video_id", F.col("start_time").alias("from_time"), F.col("end_time").alias("to_time"))
    right = r.join(moments, ["query_id", "video_id"]).filter("start_time < to_time AND from_time < end_time").select("rank_id").distinct().withColumn("hit", F.lit(True))
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_id)")
    judged = r.withColumn("place", place).join(right, "rank_id", "left").select("query_id", "rank_id", "place", F.coalesce("hit", F.lit(False)).alias("correct"))
    raws = r.select("rank_id", F.explode(F.map_from_arrays(F.array(F.lit("semantic"), F.lit("entity")), F.array("score", F.col("confidence") - 0.2))).alias("source", "raw"))
    return assemble.calibration_observations(judged, raws).withColumn("raw", rounded("raw"))


A24 = (
    with_frames("runs", "relevant")
    + """, j AS (SELECT query_id, rank_id, score, confidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_id) AS place,
  EXISTS (SELECT 1 FROM relevant m WHERE m.query_id = r.query_id AND m.video_id = r.video_id AND r.start_time < m.end_time AND m.start_time < r.end_time) AS correct FROM runs r),
c AS (SELECT query_id, rank_id, 'semantic' AS source, score AS raw, correct FROM j WHERE place <= 5 UNION ALL SELECT query_id, rank_id, 'entity', confidence - 0.2e0, correct FROM j WHERE place <= 5)
SELECT query_id, rank_id, source, round(raw, 4) AS raw, correct FROM c WHERE raw > 0"""
)


def a25_progress(spark, sf_dir):
    targets = spark.createDataFrame([("AUTOMOBILE", 100), ("BUILDING", 300), ("UNLABELLED", 10)], "category string, target long")
    return assemble.progress(frame(spark, sf_dir, "relevant"), targets)


A25 = (
    with_frames("relevant")
    + """, t(category, target) AS (VALUES ('AUTOMOBILE', 100), ('BUILDING', 300), ('UNLABELLED', 10)), d AS (SELECT category, count(*) AS done FROM relevant GROUP BY 1)
SELECT coalesce(d.category, t.category) AS category, coalesce(done, 0)::BIGINT AS done, coalesce(target, 0)::BIGINT AS target, greatest(coalesce(target, 0) - coalesce(done, 0), 0)::BIGINT AS missing FROM d FULL JOIN t ON t.category = d.category"""
)


def a28_compared_outputs(spark, sf_dir):
    d = frame(spark, sf_dir, "detections").withColumn("producer", F.expr("CASE detection_id%2 WHEN 0 THEN 'small' ELSE 'large' END"))
    return assemble.compared_outputs(d)


A28 = with_frames("detections") + " SELECT CASE detection_id%2 WHEN 0 THEN 'small' ELSE 'large' END AS producer, class_label, count(*) AS objects, count(DISTINCT frame_id) AS frames FROM detections GROUP BY GROUPING SETS ((1, 2), (1))"


def t5_top_labels(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS pair_id", "concat('L',l_linenumber) AS label", "((l_partkey*37)%101)/100e0 AS p")
    thresholds = spark.createDataFrame([(f"L{i}", 0.2 + 0.1 * (i % 4)) for i in range(1, 8)], "label string, threshold double")
    return assemble.top_labels(scores, thresholds).withColumn("rank", F.col("rank").cast("long"))


T5 = """WITH s AS (SELECT l_orderkey AS pair_id, 'L' || l_linenumber AS label, ((l_partkey*37)%101)/100e0 AS p, 0.2e0 + 0.1e0 * (l_linenumber % 4) AS threshold FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY p DESC, label) AS rank FROM s WHERE p >= threshold) SELECT pair_id, label, p, rank FROM r WHERE rank <= 3"""

_INSTANCES = "concat('s',l_suppkey) AS video_id, concat('p',l_partkey%7*(l_partkey%3)) AS predicate, cast(l_linenumber*10 as bigint) AS begin_frame, cast(l_linenumber*10+l_orderkey%20 as bigint) AS end_frame"


def t6_selected_frames(spark, sf_dir):
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_INSTANCES.split(", ")).withColumnsRenamed({"begin_frame": "begin", "end_frame": "end"})
    return assemble.selected_frames(i).withColumn("rank", F.col("rank").cast("long"))


T6 = f"""WITH i AS (SELECT {_INSTANCES} FROM lineitem), n AS (SELECT predicate, count(*) AS support FROM i GROUP BY 1), l AS (SELECT *, greatest(begin_frame, end_frame - 1) AS last FROM i),
m AS (SELECT video_id, predicate, unnest(list_distinct([begin_frame, last, floor((begin_frame + last) / 2)::BIGINT])) AS frame FROM l),
t AS (SELECT video_id, frame, floor(count(*) / sqrt(any_value(support)) * 1e6 + 0.5e0)::BIGINT AS term FROM m JOIN n USING (predicate) GROUP BY video_id, frame, predicate),
s AS (SELECT video_id, frame, sum(term)::BIGINT AS score FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame) AS rank FROM s)
SELECT video_id, frame, score, rank FROM r WHERE rank <= 6"""


def t8_latest_first(spark, sf_dir):
    return assemble.latest_first(frame(spark, sf_dir, "media").select("video_id", "uploaded"))


def u5_first_seen(spark, sf_dir):
    return assemble.first_seen(frame(spark, sf_dir, "actions"), "video_id", "label", "timestamp").select("video_id", F.array_join("labels", ",").alias("labels"))


U5 = with_frames("actions") + ", f AS (SELECT video_id, label, min(timestamp) AS came FROM actions GROUP BY 1, 2) SELECT video_id, string_agg(label, ',' ORDER BY came, label) AS labels FROM f GROUP BY 1"


def f9_node_features(spark, sf_dir):
    n = assemble.node_features(frame(spark, sf_dir, "detections"), ("chair", "cup", "laptop", "person"))
    at = lambda i: F.element_at("features", i)
    return n.select("detection_id", F.size("features").cast("long").alias("size"), at(4).alias("is_person"), rounded(at(5)).alias("cx"), rounded(at(9)).alias("area"), rounded(at(10)).alias("aspect"))


F9 = (
    with_frames("detections")
    + " SELECT detection_id, 11::BIGINT AS size, (class_label = 'person')::INT::DOUBLE AS is_person, round((x1 + x2) / 2, 4) AS cx, round((x2 - x1) * (y2 - y1), 4) AS area, round(least(4e0, (x2 - x1) / greatest(y2 - y1, 1e-6)), 4) AS aspect FROM detections"
)


def f14_softmax_choice(spark, sf_dir):
    p = assemble.softmax(F.slice("embedding", 1, 4))
    v = frame(spark, sf_dir, "appearances").withColumn("p", p)
    return v.select("appearance_id", F.array_position("p", F.array_max("p")).cast("long").alias("choice"), rounded(F.array_max("p")).alias("probability"))


F14 = (
    with_frames("appearances")
    + """, s AS (SELECT appearance_id, embedding[1:4]::DOUBLE[] AS s FROM appearances), x AS (SELECT appearance_id, list_position(s, list_max(s))::BIGINT AS choice, list_max(s) AS top, unnest(s) AS v FROM s)
SELECT appearance_id, choice, round(1 / sum(exp((v - top) * 100)), 4) AS probability FROM x GROUP BY 1, 2"""
)


def f18_label_overlap(spark, sf_dir):
    sets = frame(spark, sf_dir, "annotations").groupBy(F.expr("cast(substr(video_id,2) as bigint)").alias("k")).agg(F.collect_set("action_id").alias("own"))
    other = sets.select((F.col("k") - 1).alias("k"), F.col("own").alias("next"))
    return sets.join(other, "k").select("k", rounded(assemble.jaccard("own", "next")).alias("overlap"))


F18 = (
    with_frames("annotations")
    + """, a AS (SELECT DISTINCT substr(video_id, 2)::BIGINT AS k, action_id FROM annotations), n AS (SELECT k, count(*) AS n FROM a GROUP BY 1),
b AS (SELECT a.k, count(*) AS both_n FROM a JOIN a o ON o.k = a.k + 1 AND o.action_id = a.action_id GROUP BY 1)
SELECT n.k, round(coalesce(both_n, 0) / (n.n + m.n - coalesce(both_n, 0))::DOUBLE, 4) AS overlap FROM n JOIN n m ON m.k = n.k + 1 LEFT JOIN b ON b.k = n.k"""
)


def f22_payloads(spark, sf_dir):
    d = frame(spark, sf_dir, "detections").select("detection_id", "class_label", "confidence", "x1")
    back = assemble.decoded(assemble.encoded(d, ["class_label", "confidence", "x1"]), "class_label string, confidence double, x1 double")
    return back.select("detection_id", "class_label", rounded("confidence").alias("confidence"), "x1")


def d13_training_samples(spark, sf_dir):
    s = assemble.training_samples(frame(spark, sf_dir, "annotations"))
    at = lambda i: F.element_at("features", i)
    total = F.aggregate("labels", F.lit(0.0), lambda t, x: t + x).cast("long")
    return s.select("video_id", "timestamp", "entity_id", total.alias("n_labels"), F.element_at("ids", 1).alias("first_label"), F.element_at("labels", F.element_at("ids", 1)).alias("is_set"), rounded(at(1)).alias("cx"), rounded(at(6)).alias("aspect"))


D13 = (
    with_frames("annotations")
    + """, p AS (SELECT video_id, timestamp, entity_id, count(DISTINCT action_id) AS n_labels, min(action_id) AS first_label, arg_min(x1, row_id) AS x1, arg_min(y1, row_id) AS y1, arg_min(x2, row_id) AS x2, arg_min(y2, row_id) AS y2 FROM annotations GROUP BY 1, 2, 3)
SELECT video_id, timestamp, entity_id, n_labels, first_label, 1e0 AS is_set, round((x1 + x2) / 2, 4) AS cx, round(least(4e0, (x2 - x1) / greatest(y2 - y1, 1e-6)), 4) AS aspect FROM p"""
)


def s15_scene_edges(spark, sf_dir):
    edges = assemble.scene_graph(frame(spark, sf_dir, "detections"), frame(spark, sf_dir, "actions"), frame(spark, sf_dir, "transcripts"))
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


S15 = (
    with_frames("detections", "actions", "transcripts")
    + """, e AS (SELECT frame_id AS source, 'CONTAINS' AS relation, detection_id::VARCHAR AS target FROM detections
UNION SELECT video_id, trim(regexp_replace(upper(trim(label)), '[^A-Z0-9]+', '_', 'g'), '_'), 'concept' FROM actions
UNION SELECT video_id, 'HAS_AUDIO', trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) FROM transcripts)
SELECT relation, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM e GROUP BY 1"""
)


def _ranked(df, score: str = "score"):
    return df.select("query_id", "segment_id", rounded(score, 6).alias("score"))


def q2_baselines(spark, sf_dir):
    """The rankers that look at one kind of evidence alone."""
    index, (p, members) = Index(spark, sf_dir), distinct_plans(plans(spark, sf_dir))
    p = stored(p, "plans")
    spoken = retrieve.lexical_scores(p, index.texts, "spoken_terms", "transcript", "whisper_transcript")
    found = assemble.compared_methods({"transcript": _ranked(spoken, "value"), "entity": _ranked(retrieve.entity_scores(p, index.detections), "raw_score")})
    return of_queries(found, members).select("method", "query_id", "segment_id", "score", F.col("rank").cast("long").alias("rank"))


_TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, segment_id) AS rank FROM m) SELECT method, query_id, segment_id, score, rank FROM r WHERE rank <= 5"
Q2 = (
    with_frames(*_ALL)
    + ","
    + COMPONENTS
    + f", m AS (SELECT 'transcript' AS method, query_id, segment_id, round(value, 6) AS score FROM lex UNION ALL SELECT 'entity', query_id, segment_id, round(raw, 6) FROM ent), {_TOP}"
)


def _without_actions(p):
    return p.withColumn("actions", F.array().cast("array<string>"))


def q18_without_actions(spark, sf_dir):
    """The fused ranking of plans whose action needs are dropped: one ablation of the method comparison."""
    index, (p, members) = Index(spark, sf_dir), distinct_plans(_without_actions(plans(spark, sf_dir)))
    p = stored(p, "plans")
    return for_all_queries(_ranked(retrieve.fuse(components(p, index), p)), members)


_DROPPED = with_frames(*_ALL).replace(f"{FRAMES['plans'][2]['action_list']} AS action_list", "'' AS action_list")
Q18 = _DROPPED + "," + COMPONENTS + " SELECT query_id, segment_id, round(score, 6) AS score FROM fused"


def q19_method_comparison(spark, sf_dir):
    """Every method over every plan in one job: two baselines and the fused ranking."""
    index, (p, members) = Index(spark, sf_dir), distinct_plans(plans(spark, sf_dir))
    p = stored(p, "plans")
    spoken = retrieve.lexical_scores(p, index.texts, "spoken_terms", "transcript", "whisper_transcript")
    methods = {"transcript": _ranked(spoken, "value"), "entity": _ranked(retrieve.entity_scores(p, index.detections), "raw_score"), "fused": _ranked(retrieve.fuse(components(p, index), p))}
    return of_queries(assemble.compared_methods(methods), members).select("method", "query_id", "segment_id", "score", F.col("rank").cast("long").alias("rank"))


Q19 = (
    with_frames(*_ALL)
    + ","
    + COMPONENTS
    + f", m AS (SELECT 'transcript' AS method, query_id, segment_id, round(value, 6) AS score FROM lex UNION ALL SELECT 'entity', query_id, segment_id, round(raw, 6) FROM ent UNION ALL SELECT 'fused', query_id, segment_id, round(score, 6) FROM fused), {_TOP}"
)

def q17_blended_scores(spark, sf_dir):
    """Scores of one method blended with the window index of predicted actions."""
    r = frame(spark, sf_dir, "runs").filter("method = 'hybrid'")
    segment = lambda t: F.concat_ws(":", "video_id", F.floor(F.col(t) / 5))
    results = r.groupBy("query_id", segment("start_time").alias("segment_id")).agg(F.max("score").alias("score"))
    index = frame(spark, sf_dir, "actions").groupBy(segment("timestamp").alias("segment_id"), "label").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return retrieve.blend_with_index(results, index, plans(spark, sf_dir)).select("query_id", "segment_id", rounded("score").alias("score"))


Q17 = (
    with_frames("runs", "actions", "plans")
    + """, r AS (SELECT query_id, video_id || ':' || floor(start_time / 5)::BIGINT AS segment_id, max(score) AS score FROM runs WHERE method = 'hybrid' GROUP BY 1, 2),
i AS (SELECT video_id || ':' || floor(timestamp / 5)::BIGINT AS segment_id, label, max(coalesce(confidence, 0e0)) AS c FROM actions GROUP BY 1, 2),
w AS (SELECT query_id, unnest(string_split(action_list, ',')) AS need, len(string_split(action_list, ',')) AS n FROM plans WHERE action_list <> ''),
m AS (SELECT query_id, segment_id, avg(c) AS prediction FROM w JOIN i ON i.label = need GROUP BY 1, 2 HAVING count(*) = any_value(n))
SELECT r.query_id, r.segment_id, round(coalesce(0.8e0 * score + 0.2e0 * prediction, score), 4) AS score FROM r LEFT JOIN m ON m.query_id = r.query_id AND m.segment_id = r.segment_id"""
)


def q21_segment_documents(spark, sf_dir):
    """The searchable text of every segment, whole, by length and digest."""
    d = align.segment_document(align.build_segments(*_evidence(spark, sf_dir)))
    return d.select("segment_id", F.length("document").cast("long").alias("length"), F.md5("document").alias("digest"))


Q21 = (
    with_frames(*_ALL)
    + ","
    + SEGMENTS
    + """, o AS (SELECT segment_id, concat_ws(' ', coalesce(transcript, ''), replace(coalesce(entities, ''), ',', ' '), replace(coalesce(actions, ''), ',', ' ')) AS document FROM segments LEFT JOIN g_d USING (segment_id) LEFT JOIN g_a USING (segment_id) LEFT JOIN g_t USING (segment_id))
SELECT segment_id, length(document) AS length, md5(document) AS digest FROM o"""
)


def p13_readings(spark, sf_dir):
    """Plans with one action at most, half of them without the cue of their intent."""
    p = plans(spark, sf_dir).withColumns({"actions": F.slice("actions", 1, 1), "predicates": F.array().cast("array<string>"), "intent": F.expr("CASE query_id%2 WHEN 0 THEN 'multimodal_search' ELSE intent END")})
    return tagging.readings(p).select("query_id", "hypothesis_id", rounded("prior").alias("prior"))


P13 = (
    with_frames("plans")
    + """, p AS (SELECT query_id, entity_list <> '' AS e, action_list <> '' AS a, term_list <> '' AS t FROM plans WHERE speaker IS NULL AND CASE query_id%2 WHEN 0 THEN 'multimodal_search' ELSE intent END NOT IN ('ocr_search', 'transcript_search')),
k AS (SELECT query_id, CASE WHEN a AND NOT e AND NOT t THEN 'action' WHEN e AND NOT a AND NOT t THEN 'entity' WHEN t AND NOT e AND NOT a THEN 'concept' END AS kind FROM p),
o(kind, hypothesis_id, prior) AS (VALUES ('action', 'visible_action', 0.5e0), ('action', 'spoken_mention', 0.5e0), ('entity', 'visible_object', 0.6e0), ('entity', 'spoken_mention', 0.4e0), ('concept', 'spoken_mention', 0.6e0), ('concept', 'visible_text', 0.4e0))
SELECT query_id, hypothesis_id, round(prior, 4) AS prior FROM k JOIN o USING (kind)"""
)


def p14_case_results(spark, sf_dir):
    expected = frame(spark, sf_dir, "plans").select("query_id", "intent", "speaker")
    observed = expected.select("query_id", F.expr("CASE query_id%4 WHEN 0 THEN 'visual_search' ELSE intent END").alias("intent"), F.expr("CASE query_id%6 WHEN 0 THEN NULL ELSE speaker END").alias("speaker"))
    return tagging.case_results(observed, expected, ["intent", "speaker"]).select("query_id", F.array_join("wrong", ",").alias("wrong"), "passed")


P14 = (
    with_frames("plans")
    + """, c AS (SELECT query_id, CASE query_id%4 WHEN 0 THEN 'visual_search' ELSE intent END IS DISTINCT FROM intent AS i, CASE query_id%6 WHEN 0 THEN NULL ELSE speaker END IS DISTINCT FROM speaker AS s FROM plans)
SELECT query_id, concat_ws(',', CASE WHEN i THEN 'intent' END, CASE WHEN s THEN 'speaker' END) AS wrong, NOT (i OR s) AS passed FROM c"""
)

_EXPECTED = "CASE query_id%4 WHEN 0 THEN 'laptop' WHEN 1 THEN 'chair' WHEN 2 THEN 'cup' ELSE 'person' END"


def p8_evidence_faults(spark, sf_dir):
    r = frame(spark, sf_dir, "relevant").selectExpr("query_id", "video_id", "(query_id%6)*5e0 AS start_time", "(query_id%6)*5e0+6e0 AS end_time", f"{_EXPECTED} AS expected", "query_id%5=0 AS negative")
    return assemble.evidence_faults(r, frame(spark, sf_dir, "detections").select("video_id", "timestamp", F.col("class_label").alias("label")))


P8 = (
    with_frames("relevant", "detections")
    + f""", r AS (SELECT query_id, video_id, (query_id%6)*5e0 AS s, (query_id%6)*5e0+6e0 AS e, {_EXPECTED} AS expected, query_id%5=0 AS negative FROM relevant),
n AS (SELECT query_id, any_value(negative) AS negative, count(detection_id) AS n FROM r LEFT JOIN detections d ON d.video_id = r.video_id AND d.class_label = expected AND d.timestamp BETWEEN s AND e GROUP BY 1)
SELECT query_id, CASE WHEN negative THEN 'a negative query has evidence' ELSE 'a window lacks its evidence' END AS fault FROM n WHERE negative = (n > 0)"""
)


def f5_hashed_words(spark, sf_dir):
    """Words of every utterance in 16 buckets, over their norm."""
    t = datasets.hashed_words(frame(spark, sf_dir, "transcripts"), "utterance_id", "text")
    return t.select("utterance_id", rounded(F.element_at("vector", 1)).alias("v1"), rounded(F.element_at("vector", 16)).alias("v16"), rounded(F.array_max("vector")).alias("most"))


F5 = (
    with_frames("transcripts")
    + """, w AS (SELECT utterance_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM transcripts), c AS (SELECT utterance_id, ('0x' || substr(sha1(token), 1, 8))::BIGINT % 16 AS b, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
s AS (SELECT utterance_id, greatest(1e0, sqrt(sum(n * n))) AS norm, coalesce(max(n) FILTER (b = 0), 0e0) AS v1, coalesce(max(n) FILTER (b = 15), 0e0) AS v16, max(n) AS most FROM c GROUP BY 1)
SELECT t.utterance_id, round(coalesce(v1 / norm, 0e0), 4) AS v1, round(coalesce(v16 / norm, 0e0), 4) AS v16, round(coalesce(most / norm, 0e0), 4) AS most FROM transcripts t LEFT JOIN s USING (utterance_id)"""
)


def w4_previous_frame(spark, sf_dir):
    first = F.min_by(F.struct("x1", "y1", "x2", "y2"), "row_id").alias("b")
    boxes = frame(spark, sf_dir, "annotations").groupBy("video_id", F.col("entity_id").alias("track_id"), "timestamp").agg(first).select("video_id", "track_id", "timestamp", "b.*")
    return assemble.previous_frame_motion(boxes).select("video_id", "track_id", "timestamp", *(rounded(c).alias(c) for c in ("dx", "dy", "log_area")), "present")


W4 = (
    with_frames("annotations")
    + """, b AS (SELECT video_id, entity_id AS track_id, timestamp, arg_min(x1, row_id) AS x1, arg_min(y1, row_id) AS y1, arg_min(x2, row_id) AS x2, arg_min(y2, row_id) AS y2 FROM annotations GROUP BY 1, 2, 3),
p AS (SELECT *, coalesce(timestamp - lag(timestamp) OVER w = 1, false) AS there, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM b WINDOW w AS (PARTITION BY video_id, track_id ORDER BY timestamp))
SELECT video_id, track_id, timestamp, round(CASE WHEN there THEN (x1 + x2 - a1 - a2) / 2 ELSE 0e0 END, 4) AS dx, round(CASE WHEN there THEN (y1 + y2 - b1 - b2) / 2 ELSE 0e0 END, 4) AS dy,
  round(CASE WHEN there THEN ln(greatest((x2 - x1) * (y2 - y1), 1e-6) / greatest((a2 - a1) * (b2 - b1), 1e-6)) ELSE 0e0 END, 4) AS log_area, there::INT AS present FROM p"""
)

QUERIES = {
    f.__name__: f
    for f in (
        p5_mapped_classes, p10_crop_candidates, p11_scoped_runs, j3_semantic_relations, j15_preserved_evidence, j21_labelled_pairs, j22_prefiltered_runs, a24_calibration_observations, a25_progress, a28_compared_outputs, t5_top_labels, t6_selected_frames,
        t8_latest_first, u5_first_seen, f9_node_features, f14_softmax_choice, f18_label_overlap, f22_payloads, d13_training_samples, s15_scene_edges, q2_baselines, q18_without_actions, q19_method_comparison,
        q17_blended_scores, q21_segment_documents, p13_readings, p14_case_results, p8_evidence_faults, f5_hashed_words, w4_previous_frame,
    )
}
ORACLES = {
    "p5_mapped_classes": P5,
    "p10_crop_candidates": P10,
    "p11_scoped_runs": P11,
    "j3_semantic_relations": J3,
    "j15_preserved_evidence": J15,
    "j21_labelled_pairs": J21,
    "j22_prefiltered_runs": J22,
    "a24_calibration_observations": A24,
    "a25_progress": A25,
    "a28_compared_outputs": A28,
    "t5_top_labels": T5,
    "t6_selected_frames": T6,
    "t8_latest_first": with_frames("media") + " SELECT video_id, uploaded FROM media ORDER BY uploaded DESC, video_id",
    "u5_first_seen": U5,
    "f9_node_features": F9,
    "f14_softmax_choice": F14,
    "f18_label_overlap": F18,
    "f22_payloads": with_frames("detections") + " SELECT detection_id, class_label, round(confidence, 4) AS confidence, x1 FROM detections",
    "d13_training_samples": D13,
    "s15_scene_edges": S15,
    "q2_baselines": Q2,
    "q18_without_actions": Q18,
    "q19_method_comparison": Q19,
    "q17_blended_scores": Q17,
    "q21_segment_documents": Q21,
    "p13_readings": P13,
    "p14_case_results": P14,
    "p8_evidence_faults": P8,
    "f5_hashed_words": F5,
    "w4_previous_frame": W4,
}
