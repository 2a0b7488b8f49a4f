"""Registered queries: metrics and datasets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import datasets, evaluate, relations, selection, tracks
from sightline.plans import lexicon
from sightline.plans.frames import frame, rounded, with_frames
from sightline.plans.queries_align import DIST
from sightline.sources.scratch import stored


def _runs(spark, sf_dir):
    order = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "rank_id")
    return frame(spark, sf_dir, "runs").withColumn("rank", F.row_number().over(order).cast("long"))


RUNS = with_frames("runs", "relevant") + ", run AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, rank_id) AS rank FROM runs)"
_HITS = """, hits AS (SELECT r.method, r.query_id, r.rank, m.moment, greatest(0e0, least(r.end_time, m.end_time) - greatest(r.start_time, m.start_time)) AS o,
  greatest(0e0, least(r.end_time, m.end_time) - greatest(r.start_time, m.start_time)) / (greatest(r.end_time, m.end_time) - least(r.start_time, m.start_time)) AS iou
  FROM run r JOIN relevant m ON m.query_id = r.query_id AND m.video_id = r.video_id WHERE greatest(0e0, least(r.end_time, m.end_time) - greatest(r.start_time, m.start_time)) > 0 OR abs(r.start_time - m.start_time) <= tolerance)"""


def j24_judged_results(spark, sf_dir):
    return evaluate.judged(_runs(spark, sf_dir), frame(spark, sf_dir, "relevant")).select("method", "query_id", "rank", "moment", rounded("overlap").alias("overlap"), rounded("iou").alias("iou"))


def a12_query_metrics(spark, sf_dir):
    m = evaluate.query_metrics(_runs(spark, sf_dir), frame(spark, sf_dir, "relevant"))
    return m.select("method", "query_id", "category", *(rounded(c).alias(c) for c in ("p_at_1", "p_at_5", "r_at_5", "mrr", "iou")))


#: Each query has one moment, so claiming needs no order here; the fold itself has its own tests.
_METRICS = """, per AS (SELECT method, query_id, min(rank) AS first, count(DISTINCT rank) FILTER (rank <= 5) AS in5, count(DISTINCT moment) FILTER (rank <= 5) AS claimed, max(iou) FILTER (rank = 1) AS iou FROM hits GROUP BY 1, 2),
metrics AS (SELECT k.method, q.query_id, q.category, CASE WHEN first = 1 THEN 1e0 ELSE 0e0 END AS p_at_1, coalesce(in5, 0) / 5e0 AS p_at_5, coalesce(claimed, 0)::DOUBLE AS r_at_5, coalesce(1e0 / first, 0e0) AS mrr, coalesce(iou, 0e0) AS iou
  FROM relevant q CROSS JOIN (SELECT DISTINCT method FROM run) k LEFT JOIN per p ON p.method = k.method AND p.query_id = q.query_id)"""


def a13_summary(spark, sf_dir):
    s = evaluate.summary(evaluate.query_metrics(_runs(spark, sf_dir), frame(spark, sf_dir, "relevant")))
    return s.select("method", "category", "n_queries", *(rounded(c).alias(c) for c in ("p_at_1", "p_at_5", "r_at_5", "mrr", "iou")))


def a14_point_metrics(spark, sf_dir):
    m = evaluate.point_metrics(_runs(spark, sf_dir), frame(spark, sf_dir, "relevant"))
    return m.select("method", "query_id", *(rounded(c).alias(c) for c in ("p_at_1", "hit_at_5", "mrr", "error", "within")))


_POINTS = """, pts AS (SELECT r.method, r.query_id, min(rank) FILTER (least(r.end_time, m.end_time) > greatest(r.start_time, m.start_time) OR abs(r.start_time - peak_time) <= tolerance) AS first, min(abs(r.start_time - peak_time)) FILTER (rank = 1) AS error,
  max((rank = 1 AND abs(r.start_time - peak_time) <= tolerance)::INT) AS within FROM run r JOIN relevant m ON m.query_id = r.query_id AND m.video_id = r.video_id GROUP BY 1, 2),
points AS (SELECT method, query_id, CASE WHEN first = 1 THEN 1e0 ELSE 0e0 END AS p_at_1, CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END AS hit_at_5, coalesce(1e0 / first, 0e0) AS mrr, error, within::DOUBLE AS within FROM pts)"""


def a15_point_summary(spark, sf_dir):
    s = evaluate.point_summary(evaluate.point_metrics(_runs(spark, sf_dir), frame(spark, sf_dir, "relevant")))
    return s.select("method", "n", *(rounded(c).alias(c) for c in ("p_at_1", "hit_at_5", "mrr", "median_error", "within")))


def _answers(spark, sf_dir):
    r = _runs(spark, sf_dir).filter("rank = 1")
    return r.select("method", "query_id", "confidence", F.expr("cast(query_id%3=1 as int)").alias("wrong"), F.expr("confidence < 0.2e0").alias("abstained"), F.expr("query_id%4=0").alias("negative"))


_ANSWERS = ", answers AS (SELECT method, query_id, confidence, (query_id%3=1)::INT AS wrong, confidence < 0.2e0 AS abstained, query_id%4=0 AS negative FROM run WHERE rank = 1)"


def a16_risk_coverage(spark, sf_dir):
    return evaluate.risk_coverage(_answers(spark, sf_dir)).select("method", "query_id", rounded("coverage").alias("coverage"), rounded("risk").alias("risk"))


_CURVE = """, curve AS (SELECT method, query_id, count(*) OVER w / n::DOUBLE AS coverage, sum(wrong) OVER w / (count(*) OVER w)::DOUBLE AS risk FROM answers JOIN (SELECT method, count(*) AS n FROM answers GROUP BY 1) USING (method) WHERE NOT abstained
  WINDOW w AS (PARTITION BY method ORDER BY confidence DESC, query_id ROWS UNBOUNDED PRECEDING))"""


def a16_selective_summary(spark, sf_dir):
    return evaluate.selective_summary(_answers(spark, sf_dir)).select("method", rounded("aurc").alias("aurc"), rounded("rejection_f1").alias("rejection_f1"))


def a17_auroc(spark, sf_dir):
    return evaluate.auroc(_answers(spark, sf_dir).withColumn("positive", ~F.col("negative"))).select("method", rounded("auroc").alias("auroc"))


def a18_bootstrap(spark, sf_dir):
    values = _answers(spark, sf_dir).select("method", "query_id", F.col("wrong").cast("double").alias("value"))
    return evaluate.bootstrap_interval(values)


_TIMES = " + ".join(f"(u >= {x!r}e0)::INT" for x in evaluate.TIMES_DRAWN)
A18 = f""", x AS (SELECT method, wrong, s, (query_id::BIGINT * 48271 + s * 69621 + 2026) % {evaluate.PRIME} AS x FROM answers CROSS JOIN range(1, 2001) r(s)),
d AS (SELECT method, wrong, s, ((x * (x % 65521 + 7919)) % {evaluate.PRIME}) / {evaluate.PRIME}e0 AS u FROM x), t AS (SELECT method, wrong, s, {_TIMES} AS times FROM d),
m AS (SELECT method, s, sum(times * wrong)::DOUBLE / sum(times)::DOUBLE AS mean FROM t WHERE times > 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY mean, s) AS place FROM m)
SELECT method, max(mean) FILTER (place = 51) AS low, max(mean) FILTER (place = 1950) AS high FROM k GROUP BY 1"""


def _scores(spark, sf_dir):
    s = frame(spark, sf_dir, "label_scores")
    return s.select("item_id", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("quality").alias("y"), "p"), F.struct(F.lit(2).alias("label"), F.col("toxic").alias("y"), (1 - F.col("p")).alias("p")))).alias("s")).select("item_id", "s.*")


SCORES = with_frames("label_scores") + ", s AS (SELECT item_id, 1 AS label, quality AS y, p FROM label_scores UNION ALL SELECT item_id, 2, toxic, 1 - p FROM label_scores)"


def a10_class_frequency(spark, sf_dir):
    return datasets.positive_weights(_scores(spark, sf_dir)).withColumn("weight", rounded("weight"))


def a19_classification_report(spark, sf_dir):
    return evaluate.classification_report(_scores(spark, sf_dir)).select("label", *(rounded(c).alias(c) for c in ("precision", "recall", "f1")), "support")


def a20_average_precision(spark, sf_dir):
    return evaluate.average_precision(_scores(spark, sf_dir)).withColumn("average_precision", rounded("average_precision"))


def a21_thresholds(spark, sf_dir):
    return evaluate.best_thresholds(_scores(spark, sf_dir)).select("label", rounded("threshold").alias("threshold"), rounded("f1").alias("f1"))


def a21_thresholds_coarse(spark, sf_dir):
    return evaluate.best_thresholds(_scores(spark, sf_dir), 0.05, 0.85, 0.05, nearest_half=False, without_positives=None).select("label", rounded("threshold").alias("threshold"), rounded("f1").alias("f1"))


def _grid(low, high, step, tie):
    n = round((high - low) / step)
    return f""", grid AS (SELECT label, t, 2 * sum((cell >= t AND y = 1)::INT) / nullif(sum((cell >= t)::INT) + sum(y), 0)::DOUBLE AS f1 FROM (SELECT *, least({n}, floor((p - {low}e0) / {step}e0 + 1e-9))::INT AS cell FROM s) CROSS JOIN range({n + 1}) g(t) GROUP BY 1, 2)
SELECT label, round({low}e0 + t * {step}e0, 4) AS threshold, round(f1, 4) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC NULLS LAST, {tie}) AS rn FROM grid) WHERE rn = 1"""


def a23_fitted_priors(spark, sf_dir):
    seen = frame(spark, sf_dir, "actions").select("source_method", F.expr("action_id%3<>0").alias("correct"))
    return evaluate.fitted_priors(seen, lexicon.source_priors(spark)).withColumn("prior", rounded("prior"))


_PRIORS = ", ".join(f"('{s}', {p}e0)" for s, p in sorted(lexicon.SOURCE_PRIORS.items()))


def a26_word_error_rate(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null")
    said = F.regexp_replace("text", r"(?i)\bthe\b", "a")
    return evaluate.word_error_rates(c.select(F.col("role").alias("system"), F.col("text").alias("reference"), said.alias("hypothesis"))).select("system", rounded("wer").alias("wer"), "n")


def a27_best_run(spark, sf_dir):
    runs = frame(spark, sf_dir, "runs").select(F.col("video_id").alias("experiment"), F.col("rank_id").alias("run_id"), F.col("score").alias("val_f1"), F.col("confidence").alias("val_map"))
    return evaluate.best_run(runs)


def s3_grouped_annotations(spark, sf_dir):
    a = datasets.grouped_annotations(frame(spark, sf_dir, "annotations"))
    return a.select("video_id", "timestamp", "entity_id", "x1", "y1", F.array_join("action_ids", ",").alias("action_ids"))


def a8_action_coverage(spark, sf_dir):
    return datasets.action_coverage(frame(spark, sf_dir, "annotations"))


def a9_co_occurrence(spark, sf_dir):
    return datasets.co_occurrence(frame(spark, sf_dir, "annotations"))


def d1_hash_split(spark, sf_dir):
    return datasets.hash_split(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("video_id")))


D1 = """, k AS (SELECT c_custkey AS video_id, row_number() OVER (ORDER BY sha256('2026:' || c_custkey), c_custkey) AS rank, count(*) OVER () AS n FROM customer)
SELECT video_id, rank, CASE WHEN rank > n - greatest(1, floor(n * 0.1e0)) THEN 'test' WHEN rank > n - 2 * greatest(1, floor(n * 0.1e0)) THEN 'validation' ELSE 'train' END AS split FROM k"""


def a11_split_statistics(spark, sf_dir):
    a = frame(spark, sf_dir, "annotations")
    return datasets.split_statistics(a.join(datasets.hash_split(a.select("video_id")), "video_id"))


A11 = (
    with_frames("annotations")
    + """, v AS (SELECT DISTINCT video_id FROM annotations), k AS (SELECT video_id, row_number() OVER (ORDER BY sha256('2026:' || video_id), video_id) AS rank, count(*) OVER () AS n FROM v),
sp AS (SELECT video_id, CASE WHEN rank > n - greatest(1, floor(n * 0.1e0)) THEN 'test' WHEN rank > n - 2 * greatest(1, floor(n * 0.1e0)) THEN 'validation' ELSE 'train' END AS split FROM k)
SELECT split, count(DISTINCT video_id) AS videos, count(DISTINCT (video_id, timestamp)) AS frames, count(*) AS rows, count(DISTINCT action_id) AS labels FROM annotations JOIN sp USING (video_id) GROUP BY 1"""
)


def u6_split_leaks(spark, sf_dir):
    """Customers' videos against a split made per order: those that leak."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS video_id", "CASE WHEN o_orderkey%10=0 THEN 'test' ELSE 'train' END AS split")
    return datasets.leaks_between_splits(o).select("video_id", F.array_join("splits", ",").alias("splits"))


def d4_coverage_selection(spark, sf_dir):
    counts = stored(datasets.label_counts(frame(spark, sf_dir, "annotations")), "counts")
    targets = counts.groupBy("action_id").agg(F.least(F.sum("n"), F.lit(12)).alias("target"))
    picked = datasets.without_redundant(counts, targets, datasets.coverage_selection(counts, targets, 30))
    return spark.createDataFrame([(v, i) for i, v in enumerate(picked)], "video_id string, place int")


def d3_balanced_split(spark, sf_dir):
    """Every video of the annotations as train, validation or test."""
    return selection.balanced_split(datasets.label_counts(frame(spark, sf_dir, "annotations")), least=2)


def d5_incremental_selection(spark, sf_dir):
    """Ten more videos than those whose number 10 divides."""
    counts = datasets.label_counts(frame(spark, sf_dir, "annotations"))
    number = F.substring("video_id", 2, 20).cast("long")
    splits = counts.select("video_id", F.when(number % 3 == 0, "validation").otherwise("train").alias("split")).distinct()
    found = selection.incremental_selection(counts, splits, counts.filter(number % 10 == 0).select("video_id").distinct(), 10)
    return found.select("video_id", "place", *(rounded(c).alias(c) for c in ("gain", "breadth", "diversity")))


def w11_local_tracks(spark, sf_dir):
    """The persons among the detections; every fourth is annotated."""
    named = F.when(F.col("detection_id") % 4 == 0, F.concat(F.lit("a"), (F.col("detection_id") % 3).cast("string")))
    return tracks.local_tracks(frame(spark, sf_dir, "detections").filter("class_label = 'person'").withColumn("annotated", named))


def t7_selected_by_rarity(spark, sf_dir):
    return datasets.selected_by_rarity(datasets.label_counts(frame(spark, sf_dir, "annotations")), 20).withColumn("score", rounded("score"))


def d7_sampled_pairs(spark, sf_dir):
    pairs = relations.frame_pairs(frame(spark, sf_dir, "detections"), ordered=True)
    return datasets.sampled_pairs(pairs, pairs.filter("a_class_label = 'person' and b_class_label = 'cup'"))


def d8_candidate_recall(spark, sf_dir):
    d = frame(spark, sf_dir, "detections")
    return datasets.candidate_recall(relations.neighbours(d, k=3), relations.frame_pairs(d, ordered=True).select(F.col("a_detection_id").alias("source_id"), F.col("b_detection_id").alias("target_id"))).withColumn("recall", rounded("recall"))


D8 = (
    with_frames("detections")
    + f""", p AS (SELECT a.detection_id AS i, row_number() OVER (PARTITION BY a.detection_id ORDER BY {DIST}, b.detection_id) AS rn, {DIST} AS d FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id)
SELECT count(*) AS positives, round(avg((rn <= 3 AND d <= 0.85e0)::INT), 4) AS recall FROM p"""
)


def d9_sampling_weights(spark, sf_dir):
    rows = frame(spark, sf_dir, "annotations").select(F.col("row_id").alias("item_id"), F.col("action_id").alias("label"))
    return datasets.sampling_weights(rows).withColumn("weight", rounded("weight"))


D9 = (
    with_frames("annotations")
    + """, r AS (SELECT row_id AS item_id, max(1 / sqrt(n)) AS w FROM annotations JOIN (SELECT action_id, count(*) AS n FROM annotations GROUP BY 1) USING (action_id) GROUP BY 1),
h AS (SELECT item_id, greatest(0.25e0, least(8e0, w / (SELECT avg(w) FROM r))) AS w FROM r) SELECT item_id, round(w / (SELECT avg(w) FROM h), 4) AS weight FROM h"""
)


def a22_class_pair_prior(spark, sf_dir):
    pairs = relations.frame_pairs(frame(spark, sf_dir, "detections"), ordered=True)
    marked = pairs.select(F.col("a_class_label").alias("class_a"), F.col("b_class_label").alias("class_b"), F.lit("first").alias("predicate"), F.expr("(a_detection_id+b_detection_id)%3=0").alias("positive"))
    return datasets.class_pair_prior(marked).withColumn("prior", rounded("prior"))


def a29_feature_moments(spark, sf_dir):
    v = frame(spark, sf_dir, "detections").select(F.array("x1", "y1", "x2", "y2", "confidence").alias("vector"))
    return datasets.feature_moments(v).select("place", rounded("mean").alias("mean"), rounded("deviation").alias("deviation"))


A29 = with_frames("detections") + ", m AS (SELECT unnest([0,1,2,3,4])::INT AS place, unnest([x1,y1,x2,y2,confidence]) AS v FROM detections) SELECT place, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation FROM m GROUP BY 1"


def d12_newer_wins(spark, sf_dir):
    a = frame(spark, sf_dir, "annotations").select("video_id", "row_id", "action_id")
    fresh = a.filter("video_id like '%7'").withColumn("action_id", F.lit(80))
    return datasets.newer_wins(a, fresh).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum("action_id").alias("total"))


def p9_vector_faults(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.expr("CASE WHEN vec_id%5=0 THEN slice(embedding,1,10) WHEN vec_id%7=0 THEN transform(embedding, x -> CAST('NaN' AS FLOAT)) ELSE embedding END"))
    return datasets.vector_faults(e, {"embedding": 64}).select("vec_id", F.array_join("faults", "; ").alias("faults"))


def q3_nearest_vectors(spark, sf_dir):
    v = frame(spark, sf_dir, "appearances").select(F.col("appearance_id").alias("vec_id"), F.col("embedding").alias("vector"))
    queries = v.filter("vec_id%50=0").withColumnRenamed("vec_id", "query_id")
    return datasets.all_nearest_vectors(queries, v, k=10).withColumn("cosine", rounded("cosine"))


QUERIES = {f.__name__: f for f in (d3_balanced_split, d5_incremental_selection, w11_local_tracks, j24_judged_results, a12_query_metrics, a13_summary, a14_point_metrics, a15_point_summary, a16_risk_coverage, a16_selective_summary, a17_auroc, a18_bootstrap, a10_class_frequency, a19_classification_report, a20_average_precision, a21_thresholds, a21_thresholds_coarse, a23_fitted_priors, a26_word_error_rate, a27_best_run, s3_grouped_annotations, a8_action_coverage, a9_co_occurrence, d1_hash_split, a11_split_statistics, u6_split_leaks, d4_coverage_selection, t7_selected_by_rarity, d7_sampled_pairs, d8_candidate_recall, d9_sampling_weights, a22_class_pair_prior, a29_feature_moments, d12_newer_wins, p9_vector_faults, q3_nearest_vectors)}
ORACLES = {
    "a18_bootstrap": RUNS + _ANSWERS + A18,
    "j24_judged_results": RUNS + _HITS + " SELECT method, query_id, rank, moment, round(o, 4) AS overlap, round(iou, 4) AS iou FROM hits",
    "a12_query_metrics": RUNS + _HITS + _METRICS + " SELECT method, query_id, category, round(p_at_1, 4) AS p_at_1, round(p_at_5, 4) AS p_at_5, round(r_at_5, 4) AS r_at_5, round(mrr, 4) AS mrr, round(iou, 4) AS iou FROM metrics",
    "a13_summary": RUNS + _HITS + _METRICS + " SELECT method, category, count(*) AS n_queries, round(avg(p_at_1), 4) AS p_at_1, round(avg(p_at_5), 4) AS p_at_5, round(avg(r_at_5), 4) AS r_at_5, round(avg(mrr), 4) AS mrr, round(avg(iou), 4) AS iou FROM metrics GROUP BY GROUPING SETS ((method), (method, category))",
    "a14_point_metrics": RUNS + _POINTS + " SELECT method, query_id, round(p_at_1, 4) AS p_at_1, round(hit_at_5, 4) AS hit_at_5, round(mrr, 4) AS mrr, round(error, 4) AS error, round(within, 4) AS within FROM points",
    "a15_point_summary": RUNS + _POINTS + " SELECT method, count(*) AS n, round(avg(p_at_1), 4) AS p_at_1, round(avg(hit_at_5), 4) AS hit_at_5, round(avg(mrr), 4) AS mrr, round(quantile_cont(error, 0.5) FILTER (p_at_1 = 1), 4) AS median_error, round(avg(within), 4) AS within FROM points GROUP BY 1",
    "a16_risk_coverage": RUNS + _ANSWERS + _CURVE + " SELECT method, query_id, round(coverage, 4) AS coverage, round(risk, 4) AS risk FROM curve",
    "a16_selective_summary": RUNS
    + _ANSWERS
    + _CURVE
    + """, f AS (SELECT method, sum((negative AND abstained)::INT) AS tp, sum((NOT negative AND abstained)::INT) AS fp, sum((negative AND NOT abstained)::INT) AS fn FROM answers GROUP BY 1)
SELECT f.method, round(a, 4) AS aurc, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0e0), 4) AS rejection_f1 FROM f LEFT JOIN (SELECT method, avg(risk) AS a FROM curve GROUP BY 1) c ON c.method = f.method""",
    "a17_auroc": RUNS + _ANSWERS + " SELECT p.method, round(avg(CASE WHEN p.confidence > n.confidence THEN 1e0 WHEN p.confidence = n.confidence THEN 0.5e0 ELSE 0e0 END), 4) AS auroc FROM answers p JOIN answers n ON n.method = p.method WHERE NOT p.negative AND n.negative GROUP BY 1",
    "a10_class_frequency": SCORES + " SELECT label, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives, round(least(30e0, (count(*) - sum(y)) / greatest(sum(y), 1)::DOUBLE), 4) AS weight FROM s GROUP BY 1",
    "a19_classification_report": SCORES
    + """, m AS (SELECT label, sum((p >= 0.5 AND y = 1)::INT) AS tp, sum((p >= 0.5 AND y = 0)::INT) AS fp, sum((p < 0.5 AND y = 1)::INT) AS fn FROM s GROUP BY ROLLUP (label))
SELECT label, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0e0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0e0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0e0), 4) AS f1, (tp + fn)::BIGINT AS support FROM m""",
    "a20_average_precision": SCORES + ", r AS (SELECT label, y, sum(y) OVER w AS hits, count(*) OVER w AS seen FROM s WINDOW w AS (PARTITION BY label ORDER BY p DESC, item_id ROWS UNBOUNDED PRECEDING)) SELECT label, round(sum(hits / seen::DOUBLE) FILTER (y = 1) / sum(y), 4) AS average_precision FROM r GROUP BY 1",
    "a21_thresholds": SCORES + _grid(0.05, 0.95, 0.025, "abs(0.05e0 + t * 0.025e0 - 0.5e0), t DESC"),
    "a21_thresholds_coarse": SCORES + _grid(0.05, 0.85, 0.05, "t"),
    "a23_fitted_priors": with_frames("actions")
    + f""", d(source_method, prior) AS (VALUES {_PRIORS}), o AS (SELECT source_method, count(*) AS n, sum((action_id%3<>0)::INT) AS hits FROM actions GROUP BY 1)
SELECT source_method, round(CASE WHEN n >= 10 THEN (hits + 5 * prior) / (n + 5) ELSE prior END, 4) AS prior FROM d LEFT JOIN o USING (source_method)""",
    "a27_best_run": with_frames("runs") + " SELECT video_id AS experiment, arg_max(rank_id, struct_pack(a := score, b := confidence, c := rank_id)) AS run_id, max(score) AS val_f1 FROM runs GROUP BY 1",
    "s3_grouped_annotations": with_frames("annotations") + " SELECT video_id, timestamp, entity_id, x1, y1, array_to_string(list_sort(list(DISTINCT action_id)), ',') AS action_ids FROM annotations GROUP BY 1, 2, 3, 4, 5, x2, y2",
    "a8_action_coverage": with_frames("annotations") + ", l AS (SELECT range::INT AS action_id FROM range(1, 81)) SELECT l.action_id, count(video_id) AS n, count(DISTINCT video_id) AS videos, count(video_id) = 0 AS missing, count(video_id) BETWEEN 1 AND 5 AS rare FROM l LEFT JOIN annotations a USING (action_id) GROUP BY 1",
    "a9_co_occurrence": with_frames("annotations") + ", h AS (SELECT DISTINCT video_id, action_id FROM annotations) SELECT x.action_id AS a, y.action_id AS b, count(*) AS videos FROM h x JOIN h y USING (video_id) WHERE x.action_id < y.action_id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100",
    "d1_hash_split": "WITH one AS (SELECT 1)" + D1,
    "a11_split_statistics": A11,
    "u6_split_leaks": "SELECT o_custkey AS video_id, 'test,train' AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey%10=0) = 2",
    "t7_selected_by_rarity": with_frames("annotations") + ", c AS (SELECT video_id, action_id, count(*) AS n FROM annotations GROUP BY 1, 2), p AS (SELECT action_id, sum(n) AS support FROM c GROUP BY 1) SELECT video_id, round(sum(least(n, 25) / sqrt(support)) + 0.02e0 * count(*), 4) AS score FROM c JOIN p USING (action_id) GROUP BY 1 ORDER BY sum(least(n, 25) / sqrt(support)) + 0.02e0 * count(*) DESC, video_id LIMIT 20",
    "d8_candidate_recall": D8,
    "d9_sampling_weights": D9,
    "a22_class_pair_prior": with_frames("detections") + " SELECT a.class_label AS class_a, b.class_label AS class_b, 'first' AS predicate, round((sum(((a.detection_id+b.detection_id)%3=0)::INT) + 1) / (count(*) + 2)::DOUBLE, 4) AS prior FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id GROUP BY 1, 2",
    "a29_feature_moments": A29,
    "d12_newer_wins": with_frames("annotations") + " SELECT video_id, count(*) AS n, sum(CASE WHEN video_id LIKE '%7' THEN 80 ELSE action_id END)::BIGINT AS total FROM annotations GROUP BY 1",
    "p9_vector_faults": "SELECT vec_id, CASE WHEN vec_id%5=0 THEN 'embedding: length' ELSE 'embedding: not finite' END AS faults FROM embeddings WHERE vec_id%5=0 OR vec_id%7=0",
}
