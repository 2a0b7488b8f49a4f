"""Retrieval and classification metrics over tables of runs, moments and scores.

Every metric partitions by method, query or label; none needs all rows in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import interval_iou, overlap


def judged(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Results joined to the relevant moments of their query and video that they hit.

    A hit overlaps the moment or starts within its tolerance. results: method, query_id, rank, video_id, start_time, end_time.
    """
    r = relevant.select("query_id", "video_id", "moment", F.col("start_time").alias("m_start"), F.col("end_time").alias("m_end"), "peak_time", "tolerance")
    pairs = results.join(r, ["query_id", "video_id"])
    shared = overlap(F.col("start_time"), F.col("end_time"), F.col("m_start"), F.col("m_end"))
    hit = (shared > 0) | (F.abs(F.col("start_time") - F.col("m_start")) <= F.col("tolerance"))
    return pairs.filter(hit).withColumns({"overlap": shared, "iou": interval_iou(F.col("start_time"), F.col("end_time"), F.col("m_start"), F.col("m_end"))})


def query_metrics(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per method and query with moments: P@1, P@5 (of five always), R@5 with one result per moment, MRR, IoU of the first.

    In rank order each of the first five results claims the free moment it overlaps most; a fold over a short sorted array.
    """
    hits = judged(results, relevant)
    methods = [r.method for r in results.select("method").distinct().collect()]  # a few names
    queries = relevant.groupBy("query_id", "category").agg(F.count_distinct("moment").alias("moments")).withColumn("method", F.explode(F.array(*map(F.lit, methods)).cast("array<string>")))
    per_rank = hits.groupBy("method", "query_id", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("o"), "moment"))).alias("m"), F.max("iou").alias("iou"))
    lists = per_rank.groupBy("method", "query_id").agg(
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("in5"), F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "m")))).alias("ranks"), F.max(F.when(F.col("rank") == 1, F.col("iou"))).alias("iou1")
    )
    none = F.array().cast("array<bigint>")

    def claim(taken: Column, r: Column) -> Column:
        free = F.filter(r["m"], lambda m: ~F.array_contains(taken, m["moment"].cast("bigint")))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(free[0]["moment"].cast("bigint")))).otherwise(taken)

    claimed = lists.withColumn("claimed", F.size(F.aggregate("ranks", none, claim)))
    joined = queries.join(claimed, ["method", "query_id"], "left")
    zero = F.lit(0.0)
    return joined.select(
        "method", "query_id", "category", "moments", F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("p_at_1"), (F.coalesce("in5", F.lit(0)) / 5.0).alias("p_at_5"), (F.coalesce("claimed", F.lit(0)) / F.col("moments")).alias("r_at_5"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), F.coalesce("iou1", zero).alias("iou"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means overall and by category in one pass over grouping sets."""
    means = [F.avg(c).alias(c) for c in ("p_at_1", "p_at_5", "r_at_5", "mrr", "iou")]
    return metrics.groupingSets([[F.col("method")], [F.col("method"), F.col("category")]], "method", "category").agg(F.count(F.lit(1)).alias("n_queries"), *means)


def point_metrics(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per method and query: hit at 1, hit within 5, reciprocal rank, seconds from the first result's start to the nearest peak, and whether within tolerance."""
    r = relevant.select("query_id", "video_id", "peak_time", "tolerance", F.col("start_time").alias("m_start"), F.col("end_time").alias("m_end"))
    pairs = results.join(r, ["query_id", "video_id"])
    close = F.abs(F.col("start_time") - F.col("peak_time")) <= F.col("tolerance")
    hit = (F.least("end_time", "m_end") > F.greatest("start_time", "m_start")) | close
    by_query = pairs.groupBy("method", "query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.min(F.when(F.col("rank") == 1, F.abs(F.col("start_time") - F.col("peak_time")))).alias("error"), F.max(F.when((F.col("rank") == 1) & close & hit, 1).otherwise(0)).alias("within")
    )
    return by_query.select("method", "query_id", F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("p_at_1"), F.when(F.col("first") <= 5, 1.0).otherwise(0.0).alias("hit_at_5"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), "error", F.col("within").cast("double").alias("within"))


def point_summary(metrics: DataFrame) -> DataFrame:
    """Means, and the median timestamp error over hits."""
    return metrics.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("p_at_1").alias("p_at_1"), F.avg("hit_at_5").alias("hit_at_5"), F.avg("mrr").alias("mrr"), F.expr("percentile(CASE WHEN p_at_1 = 1 THEN error END, 0.5)").alias("median_error"), F.avg("within").alias("within"))


def method_deltas(summaries: DataFrame, base: str) -> DataFrame:
    b = summaries.filter(F.col("method") == base).select("category", *(F.col(c).alias(f"base_{c}") for c in ("p_at_1", "mrr")))
    return summaries.join(b, F.col("category").eqNullSafe(b["category"])).select(summaries["method"], summaries["category"], *((F.col(c) - F.col(f"base_{c}")).alias(f"delta_{c}") for c in ("p_at_1", "mrr")))


#: Equal cells of [0, 1] that scores are summed in, so that no task holds all rows of a group.
CELLS = 4096


def running_sums(rows: DataFrame, group: str, score: str, tie: str, sums: dict[str, Column]) -> DataFrame:
    """Running totals of each group by falling score in [0, 1], then ``tie``: prefix sums over cells of scores, then inside a cell."""
    cell = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(F.col(score) * CELLS))).cast("int")
    placed = rows.withColumns({"cell": cell, **{f"own_{k}": c for k, c in sums.items()}})
    cells = placed.groupBy(group, "cell").agg(*(F.sum(f"own_{k}").alias(k) for k in sums))
    above = Window.partitionBy(group).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(group, "cell", *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"before_{k}") for k in sums))
    inside = Window.partitionBy(group, "cell").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.withColumns({f"in_{k}": F.sum(f"own_{k}").over(inside) for k in sums}).join(before, [group, "cell"])
    return totals.withColumns({k: F.col(f"before_{k}") + F.col(f"in_{k}") for k in sums}).select(*rows.columns, *sums)


def risk_coverage(answers: DataFrame) -> DataFrame:
    """answers: method, query_id, confidence, wrong (0/1), abstained. Risk of the answers given so far, by falling confidence."""
    everyone = answers.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    given = answers.filter("not abstained").select("method", "query_id", "confidence", "wrong")
    running = running_sums(given, "method", "confidence", "query_id", {"covered": F.lit(1).cast("long"), "errors": F.col("wrong").cast("long")}).join(everyone, "method")
    return running.select("method", "query_id", (F.col("covered") / F.col("n")).alias("coverage"), (F.col("errors") / F.col("covered")).alias("risk"))


def selective_summary(answers: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve, and F1 of abstaining on queries that have no answer. answers: + negative (bool)."""
    aurc = risk_coverage(answers).groupBy("method").agg(F.avg("risk").alias("aurc"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    neg, out = F.col("negative"), F.col("abstained")
    f = answers.groupBy("method").agg(count(neg & out).alias("tp"), count(~neg & out).alias("fp"), count(neg & ~out).alias("fn"))
    return f.join(aurc, "method", "left").select("method", "aurc", F.coalesce(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("rejection_f1"))


def auroc(scores: DataFrame, group: str = "method", label: str = "positive", score: str = "confidence") -> DataFrame:
    """Area under the ROC curve with half credit for ties, from average ranks (Mann-Whitney): no pairs are made.

    Scores are counted by value first, so a group's window holds its distinct scores.
    """
    values = scores.groupBy(group, score).agg(F.sum(F.col(label).cast("int")).alias("p"), F.sum((~F.col(label).cast("boolean")).cast("int")).alias("n"))
    below = Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    credit = values.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return credit.groupBy(group).agg((F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


#: Cumulative odds that a draw of n from n rows takes a row 0, 1, 2, ... times, for large n (Poisson of mean 1).
TIMES_DRAWN = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
PRIME = (1 << 31) - 1


def times_drawn(row: Column, sample: Column, seed: int) -> Column:
    """How often a sample takes a row, from a hash of both in whole numbers that any engine computes alike."""
    x = F.pmod(row * 48271 + sample * 69621 + seed, F.lit(PRIME))
    odds = F.pmod(x * (x % 65521 + 7919), F.lit(PRIME)) / float(PRIME)
    return reduce(lambda total, limit: total + F.when(odds >= limit, 1).otherwise(0), TIMES_DRAWN, F.lit(0))


def bootstrap_interval(values: DataFrame, key: str = "method", samples: int = 2000, seed: int = 2026, row: str = "query_id") -> DataFrame:
    """values: key, row (a whole number), value. 95 % percentile interval of the mean over seeded resamples.

    Each row says by itself how often each sample takes it, so that sums of counts and values, combined before they are
    shuffled, give all means: rows are never drawn by position, joined or gathered.
    """
    drawn = values.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    drawn = drawn.withColumn("times", times_drawn(F.col(row).cast("long"), F.col("sample").cast("long"), seed)).filter("times > 0")
    means = drawn.groupBy(key, "sample").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("mean"))
    rank = means.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("mean", "sample")))
    low, high = max(1, int(0.025 * samples) + 1), int(0.975 * samples)
    return rank.groupBy(key).agg(F.max(F.when(F.col("place") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("place") == high, F.col("mean"))).alias("high"))


# ---- labels: long rows (item_id, label, y, p) ----


def classification_report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each label, and over all labels together (label null)."""
    said = F.col("p") >= threshold
    marked = scores.select("label", (said & (F.col("y") == 1)).cast("int").alias("tp"), (said & (F.col("y") == 0)).cast("int").alias("fp"), (~said & (F.col("y") == 1)).cast("int").alias("fn"))
    sums = marked.rollup("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Mean of the precision at each positive, in order of falling score (then item)."""
    running = running_sums(scores.select("label", "item_id", "y", "p"), "label", "p", "item_id", {"hits": F.col("y").cast("long"), "seen": F.lit(1).cast("long")})
    return running.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("seen"))) / F.nullif(F.sum("y"), F.lit(0)), F.lit(0.0)).alias("average_precision"))


def best_thresholds(scores: DataFrame, low: float = 0.05, high: float = 0.95, step: float = 0.025, nearest_half: bool = True, without_positives: float | None = 1.0) -> DataFrame:
    """The grid threshold with the best F1 for each label; ties go to the one nearest one half, or else to the first.

    Each score is put in its grid cell once and cells are summed from the top, instead of rows times thresholds.
    """
    steps = round((high - low) / step)
    cell = F.least(F.lit(steps), F.floor((F.col("p") - low) / step + 1e-9)).cast("int")
    cells = scores.withColumn("cell", cell).filter("cell >= 0").groupBy("label", "cell").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = scores.groupBy("label").agg(F.sum("y").alias("all_pos"))
    grid = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(steps)))).join(cells, ["label", "cell"], "left").fillna({"pos": 0, "n": 0})
    above = Window.partitionBy("label").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = grid.withColumns({"tp": F.sum("pos").over(above), "said": F.sum("n").over(above)}).withColumn("threshold", F.round(low + F.col("cell") * step, 6))
    f1 = F.when(F.col("said") + F.col("all_pos") > 0, 2 * F.col("tp") / (F.col("said") + F.col("all_pos"))).otherwise(0.0)
    tie = -F.abs(F.col("threshold") - 0.5) if nearest_half else -F.col("threshold")
    best = curve.withColumn("f1", f1).groupBy("label", "all_pos").agg(F.max(F.struct("f1", tie.alias("tie"), "threshold")).alias("b"))
    empty = F.lit(without_positives) if without_positives is not None else F.col("b.threshold")
    return best.select("label", F.when(F.col("all_pos") == 0, empty).otherwise(F.col("b.threshold")).alias("threshold"), F.col("b.f1").alias("f1"))


def decoded(scores: DataFrame, thresholds: DataFrame, caps: DataFrame) -> DataFrame:
    """Labels above their own threshold, at most ``cap`` for each item and label group. caps: label, grp, cap."""
    kept = scores.join(F.broadcast(thresholds.select("label", "threshold")), "label").filter("p >= threshold").join(F.broadcast(caps), "label")
    order = Window.partitionBy("item_id", "grp").orderBy(F.desc("p"), "label")
    return kept.withColumn("place", F.row_number().over(order)).filter("place <= cap").select("item_id", "label", "p", "place")


def fitted_priors(observations: DataFrame, defaults: DataFrame, least: int = 10, strength: int = 5) -> DataFrame:
    """observations: source_method, correct. A source seen ``least`` times gets (hits + strength * prior) / (n + strength), others keep the default."""
    seen = observations.groupBy("source_method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("hits"))
    joined = defaults.join(seen, "source_method", "left")
    value = F.when(F.col("n") >= least, (F.col("hits") + strength * F.col("prior")) / (F.col("n") + strength)).otherwise(F.col("prior"))
    return joined.select("source_method", F.round(value, 6).alias("prior"))


def word_error_rates(pairs: DataFrame) -> DataFrame:
    """pairs: system, reference, hypothesis. Mean word error rate: Levenshtein distance over words by reference length.

    Words become single characters (from U+4E00 on; up to 35,000 distinct words a pair) of the pair's own vocabulary, so that the built-in ``levenshtein`` counts words.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    split = pairs.select("system", words(F.col("reference")).alias("r"), words(F.col("hypothesis")).alias("h"))
    vocabulary = split.withColumn("v", F.array_distinct(F.concat("r", "h")))
    letters = lambda c: F.array_join(F.transform(c, lambda w: F.decode(F.unhex(F.hex(F.array_position(F.col("v"), w) + 0x4DFF)), "UTF-16BE")), "")
    scored = vocabulary.withColumn("wer", F.levenshtein(letters("r"), letters("h")) / F.greatest(F.size("r"), F.lit(1)))
    return scored.groupBy("system").agg(F.avg("wer").alias("wer"), F.count(F.lit(1)).alias("n"))


def best_run(runs: DataFrame) -> DataFrame:
    """runs: experiment, run_id, val_f1, val_map. The run that validation prefers; test figures aren't looked at."""
    return runs.groupBy("experiment").agg(F.max_by("run_id", F.struct("val_f1", "val_map", "run_id")).alias("run_id"), F.max("val_f1").alias("val_f1"))
