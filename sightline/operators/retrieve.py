"""Retrieval of a table of queries against a table of segments.

Queries reach segments only by joins on tokens, labels, speakers or relation keys, never by a product of
the two tables. A need that a query names is a hard constraint: a segment must meet all of them, which is
an inner join and a count of distinct needs.

plans: query_id, intent, entities, actions, spoken_terms, ocr_terms (arrays of strings), speaker.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import clipped_cosine, hashed_entries, tokens
from sightline.plans.lexicon import SUPPORTED, WEAK, intent_weights, source_priors

#: Weights of the components of a score; a lexical part and a vector part share one.
LEXICAL, VECTOR, HARD, APPEARANCE = 0.7, 0.3, 1.0, 1.25
COMPONENT = ("query_id", "segment_id", "component", "weight", "value", "modality", "source_method", "raw_score")


def needs(plans: DataFrame, column: str) -> DataFrame:
    """query_id, need, n_needs for each value of an array column."""
    return plans.select("query_id", "intent", F.size(F.array_distinct(column)).alias("n_needs"), F.explode(F.array_distinct(column)).alias("need"))


def of_segment(df: DataFrame) -> list[str]:
    """The columns that name a segment. With its video, where ``df`` has it, rows that are dealt out by video are grouped where they are."""
    return [c for c in ("video_id", "segment_id") if c in df.columns]


def all_needs_met(wanted: DataFrame, have: DataFrame, *extra: Column) -> DataFrame:
    """wanted: query_id, need, n_needs; have: segment_id, need, .... Pairs of query and segment that meet every need."""
    met = wanted.join(have, "need").groupBy("query_id", *of_segment(have)).agg(F.count_distinct("need").alias("met"), F.first("n_needs").alias("n_needs"), *extra)
    return met.filter("met = n_needs").drop("met", "n_needs")


def _component(df: DataFrame, name: str, weight: float, value: Column, modality: str, source: Column, raw: Column) -> DataFrame:
    return df.select("query_id", "segment_id", F.lit(name).alias("component"), F.lit(weight).alias("weight"), value.alias("value"), F.lit(modality).alias("modality"), source.alias("source_method"), raw.alias("raw_score"))


def token_index(texts: DataFrame) -> DataFrame:
    """texts: segment_id, text. The inverted index: token, segment_id, once each."""
    return texts.select("segment_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def lexical_scores(plans: DataFrame, texts: DataFrame, terms: str, modality: str, source: str) -> DataFrame:
    """The fraction of a query's terms that each segment's text has, for segments with at least one."""
    wanted = needs(plans, terms)
    hits = wanted.join(token_index(texts).withColumnRenamed("token", "need"), "need").groupBy("query_id", "segment_id").agg((F.count_distinct("need") / F.first("n_needs")).alias("value"))
    return _component(hits, f"{modality}_lexical", LEXICAL, F.col("value"), modality, F.lit(source), F.col("value"))


def vector_scores(plans: DataFrame, texts: DataFrame, terms: str, candidates: DataFrame | None = None) -> DataFrame:
    """Cosine of the hashed vectors of a query's terms and a segment's text.

    With ``candidates`` (query_id, segment_id) only those pairs are scored: segments that share a term. Without, every
    pair that shares an index is, as an exhaustive scan would.
    """
    q = hashed_entries(plans.filter(F.size(terms) > 0).select("query_id", F.array_join(terms, " ").alias("text")), ["query_id"], "text")
    s = hashed_entries(texts, ["segment_id"], "text")
    if candidates is None:
        pairs = clipped_cosine(q, s, ["query_id"], ["segment_id"])
    else:
        joined = candidates.select("query_id", "segment_id").join(q.withColumnRenamed("val", "a"), "query_id").join(s.withColumnRenamed("val", "b"), ["segment_id", "idx"])
        pairs = joined.groupBy("query_id", "segment_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("a") * F.col("b")))).alias("cosine"))
    return _component(pairs, "vector", VECTOR, F.col("cosine"), "semantic", F.lit("hashing_embedding"), F.col("cosine"))


#: Segments of a block of the block-max index.
BLOCK_SEGMENTS = 64


def block_max_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries: segment_id, idx, val. (entries with their segment's block; block, idx, low, high: the least and the greatest value of a cell in a block).

    Blocks are runs of segments in order of their largest cell, so that segments of like content share one; a block's number is its
    cell's and the run's in it.
    """
    lead = entries.groupBy("segment_id").agg(F.max_by("idx", F.struct(F.abs("val"), "idx")).alias("lead"))
    sizes = lead.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    run = F.pmod(F.xxhash64("segment_id"), F.ceil(F.col("n") / BLOCK_SEGMENTS))
    blocks = lead.join(sizes, "lead").select("segment_id", (F.col("lead").cast("long") * (1 << 40) + run).alias("block"))
    placed = entries.join(blocks, "segment_id")
    return placed, placed.groupBy("block", "idx").agg(F.min("val").alias("low"), F.max("val").alias("high"), F.count(F.lit(1)).alias("n"))


def top_vectors(wanted: DataFrame, placed: DataFrame, extremes: DataFrame, k: int, slack: float = 1e-4) -> DataFrame:
    """The k best segments of each query by cosine: query_id, segment_id, value, blocks_scored, blocks_met.

    wanted: query_id, idx, val. A block's bound is what its segments could reach at most in the cells of the query; a cell that some
    segment lacks bounds no better than zero. Blocks of the best bounds are scored first, enough to hold k; their k-th score rules out every block
    whose bound is lower. Only what is left is scored. Scores within ``slack`` aren't ruled out, so ties are all seen. Segments of score zero are no results.
    """
    gain = F.greatest(F.lit(0.0), F.col("q") * F.col("low"), F.col("q") * F.col("high"))
    asked = wanted.withColumnRenamed("val", "q")
    bounds = asked.join(extremes, "idx").groupBy("query_id", "block").agg(F.sum(gain).alias("bound"), F.max("n").alias("n")).filter("bound > 0")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = bounds.withColumn("before", F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, -1)))

    def scored(blocks: DataFrame) -> DataFrame:
        cells = blocks.select("query_id", "block").join(asked, "query_id").join(placed, ["block", "idx"])
        return cells.groupBy("query_id", "segment_id").agg(F.sum(F.col("q") * F.col("val")).alias("value")).filter("value > 0")

    first = F.coalesce("before", F.lit(0)) < 2 * k
    kth = scored(bounds.filter(first)).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value")))).filter(F.col("place") == k).select("query_id", F.col("value").alias("least"))
    open_blocks = bounds.join(kth, "query_id", "left").filter(F.coalesce(F.col("bound") >= F.col("least") - slack, F.lit(True)))
    found = scored(open_blocks).withColumn("value", F.least(F.lit(1.0), F.col("value")))
    shares = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_met")).join(open_blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_scored")), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.bround("value", 6)), "segment_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).join(shares, "query_id").select("query_id", "segment_id", F.col("place").cast("long").alias("place"), "value", "blocks_scored", "blocks_met")


def entity_scores(plans: DataFrame, placed_detections: DataFrame) -> DataFrame:
    """Segments that show every entity of a query; evidence is the mean of each one's best confidence."""
    best = placed_detections.groupBy(*of_segment(placed_detections), F.lower("class_label").alias("need")).agg(F.max("confidence").alias("c"))
    met = all_needs_met(needs(plans, "entities"), best, F.avg("c").alias("raw"))
    return _component(met, "entity", HARD, F.lit(1.0), "entity", F.lit("yolo_detection"), F.col("raw"))


def action_scores(plans: DataFrame, rollup: DataFrame) -> DataFrame:
    """Segments that show every action; an action of unknown confidence counts as 1. One contribution per action, the value once."""
    have = rollup.select(*of_segment(rollup), F.col("label").alias("need"), F.coalesce("confidence", F.lit(1.0)).alias("c"), "source_method")
    met = all_needs_met(needs(plans, "actions"), have, F.avg("c").alias("value"), F.collect_list(F.struct("need", "c", "source_method")).alias("each"))
    each = met.select("query_id", "segment_id", "value", F.posexplode(F.sort_array("each")).alias("at", "x"))
    weight = F.when(F.col("at") == 0, F.lit(HARD)).otherwise(0.0)
    return each.select("query_id", "segment_id", F.concat(F.lit("action_"), F.col("at").cast("string")).alias("component"), weight.alias("weight"), "value", F.lit("action").alias("modality"), F.col("x.source_method").alias("source_method"), F.col("x.c").alias("raw_score"))


def _per_need(met: DataFrame, name: str, modality: str) -> DataFrame:
    """met: query_id, segment_id, value, each (need, c, source_method). One contribution per need, the value once."""
    each = met.select("query_id", "segment_id", "value", F.posexplode(F.sort_array("each")).alias("at", "x"))
    weight = F.when(F.col("at") == 0, F.lit(HARD)).otherwise(0.0)
    return each.select("query_id", "segment_id", F.concat(F.lit(f"{name}_"), F.col("at").cast("string")).alias("component"), weight.alias("weight"), "value", F.lit(modality).alias("modality"), F.col("x.source_method").alias("source_method"), F.col("x.c").alias("raw_score"))


def relation_scores(matched: DataFrame, wanted: DataFrame) -> DataFrame:
    """matched: best relation of each (query, need, segment). Segments with every tuple; the value is the mean of the best confidences."""
    sizes = wanted.groupBy("query_id").agg(F.count_distinct("need_id").alias("n"))
    each = F.collect_list(F.struct(F.col("need_id").alias("need"), F.col("confidence").alias("c"), "source_method")).alias("each")
    met = matched.groupBy("query_id", "segment_id").agg(F.count_distinct("need_id").alias("met"), F.avg("confidence").alias("value"), each).join(sizes, "query_id").filter("met = n")
    return _per_need(met, "relation", "relationship")


def predicate_scores(plans: DataFrame, placed_relations: DataFrame) -> DataFrame:
    """Segments with every predicate (array ``predicates``) of a query, whatever it holds between; evidence is each one's best relation."""
    best = placed_relations.groupBy("segment_id", F.col("predicate").alias("need")).agg(F.max(F.struct(F.col("confidence").alias("c"), "source_method")).alias("b")).select("segment_id", "need", "b.*")
    met = all_needs_met(needs(plans, "predicates"), best, F.collect_list(F.struct("need", "c", "source_method")).alias("each"))
    return _per_need(met.withColumn("value", F.lit(1.0)), "relation", "relationship")


def appearance_scores(matches: DataFrame) -> DataFrame:
    """matches: query_id, segment_id, constraint_id, value, source_method. One component a constraint."""
    name = F.concat(F.lit("appearance_"), F.col("constraint_id").cast("string"))
    return matches.select("query_id", "segment_id", name.alias("component"), F.lit(APPEARANCE).alias("weight"), "value", F.lit("appearance").alias("modality"), "source_method", F.col("value").alias("raw_score"))


def speaker_scores(plans: DataFrame, placed_utterances: DataFrame) -> DataFrame:
    said = placed_utterances.filter("speaker <> 'UNKNOWN'").select(*of_segment(placed_utterances), "speaker").distinct()
    met = plans.filter("speaker is not null").select("query_id", "speaker").join(said, "speaker")
    return _component(met, "speaker", HARD, F.lit(1.0), "speaker", F.lit("pyannote_diarization"), F.lit(1.0))


def hard_needs(plans: DataFrame) -> DataFrame:
    """How many kinds of hard constraint each query has."""
    return plans.select("query_id", "intent", sum(F.when(c, 1).otherwise(0) for c in (F.size("entities") > 0, F.size("actions") > 0, F.col("speaker").isNotNull())).alias("n_hard"))


def _fusion_sums() -> list[Column]:
    is_hard = F.col("modality").isin("entity", "action", "relationship", "speaker", "appearance")
    return [F.count_distinct(F.when(is_hard, F.col("modality"))).alias("met"), F.sum(F.col("weight") * F.col("value")).alias("x"), F.sum(F.when(is_hard, F.col("weight")).otherwise(0.0)).alias("hard_weight")]


def _fused(summed: DataFrame, plans: DataFrame, extra_hard: DataFrame | None) -> DataFrame:
    hard = hard_needs(plans)
    if extra_hard is not None:
        hard = hard.join(extra_hard, "query_id", "left").withColumn("n_hard", F.col("n_hard") + F.coalesce("n", F.lit(0))).drop("n")
    soft = plans.select("query_id", (F.when(F.size("spoken_terms") > 0, 1.0).otherwise(0.0) + F.when(F.size("ocr_terms") > 0, 1.0).otherwise(0.0)).alias("soft"))
    scored = summed.join(hard, "query_id").filter("met = n_hard").join(soft, "query_id")
    return scored.withColumn("score", F.col("x") / (F.col("hard_weight") + F.col("soft"))).filter("score > 0").drop("met", "n_hard", "soft", "x", "hard_weight")


def fuse(components: DataFrame, plans: DataFrame, extra_hard: DataFrame | None = None) -> DataFrame:
    """Weighted mean of a pair's components, for pairs that meet all hard constraints: query_id, segment_id, score.

    A lexical or vector part that a query asks for counts as zero where the segment has none of it. extra_hard:
    query_id, n (further kinds, such as relation tuples).
    """
    return _fused(components.groupBy("query_id", "segment_id").agg(*_fusion_sums()), plans, extra_hard).select("query_id", "intent", "segment_id", "score")


def _weighted(components: DataFrame, plans: DataFrame, priors: DataFrame | None) -> DataFrame:
    """Components with the weight ``w`` of their modality and ``v``, what they say times how far their source is trusted."""
    spark = components.sparkSession
    priors = priors if priors is not None else source_priors(spark)
    unknown = priors.filter("source_method = 'unknown'").first().prior
    known = components.join(F.broadcast(priors), "source_method", "left").withColumn("prior", F.coalesce("prior", F.lit(unknown)))
    known = known.join(plans.select("query_id", "intent"), "query_id")
    weights = intent_weights(spark).withColumnRenamed("weight", "w")
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_score")))
    return known.join(F.broadcast(weights), ["intent", "modality"], "left").withColumns({"w": F.coalesce("w", F.lit(0.5)), "v": raw * F.col("prior")}).drop("intent")


def _reliability() -> Column:
    return (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("confidence")


def _verdict() -> Column:
    return F.when(F.col("confidence") >= SUPPORTED, "supported").when(F.col("confidence") >= WEAK, "weak").otherwise("insufficient")


def assess(components: DataFrame, plans: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Reliability of a pair's evidence: confidence = sum(weight * raw * prior) / sum(weight), and the verdict it allows."""
    strongest = F.max_by(F.struct("modality", "source_method"), F.struct(F.col("v") * F.col("w"), "modality", "source_method"))
    found = _weighted(components, plans, priors).groupBy("query_id", "segment_id").agg(_reliability(), strongest.alias("s"))
    why = F.format_string("%s evidence from %s leads; confidence %.2f: %s.", F.col("s.modality"), F.col("s.source_method"), F.col("confidence"), _verdict())
    return found.select("query_id", "segment_id", "confidence", _verdict().alias("verdict"), F.col("s.modality").alias("lead_modality"), F.col("s.source_method").alias("lead_source"), why.alias("explanation"))


def scored(components: DataFrame, plans: DataFrame, extra_hard: DataFrame | None = None) -> DataFrame:
    """``fuse`` and the confidence and verdict of ``assess`` in one grouping: query_id, intent, segment_id, score, confidence, verdict."""
    summed = _weighted(components, plans, None).groupBy("query_id", "segment_id").agg(*_fusion_sums(), _reliability())
    return _fused(summed, plans, extra_hard).withColumn("verdict", _verdict()).select("query_id", "intent", "segment_id", "score", "confidence", "verdict")


def ranked(results: DataFrame, limit: int | None = None, order: str = "score") -> DataFrame:
    """Rank within a query by the score rounded to four places, then start, video and segment; the first ``limit`` if given.

    order: ``score``, or ``reliability`` for half score and half confidence.
    """
    score = F.bround("score", 4)
    by = score if order == "score" else F.bround(0.5 * score + 0.5 * F.col("confidence"), 4)
    window = Window.partitionBy("query_id").orderBy(F.desc(by), F.desc(score), "start_time", "video_id", "segment_id")
    out = results.withColumn("rank", F.row_number().over(window))
    return out.filter(F.col("rank") <= limit) if limit else out


def _apart(gap: float):
    """Rows (query_id, video_id, peak_time, rank, segment_id) by query, video and peak: those that no better kept one of their video is near."""

    def kept(piece: list[tuple]) -> list[tuple]:
        # only a kept peak suppresses, so peaks are taken by rank; kept ones stay sorted and more than the gap apart
        out, peaks = [], []
        for row in sorted(piece, key=lambda r: r[3]):
            at = bisect.bisect_left(peaks, row[2])
            if (at == 0 or abs(peaks[at - 1] - row[2]) > gap) and (at == len(peaks) or abs(peaks[at] - row[2]) > gap):
                peaks.insert(at, row[2])
                out.append(row)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if piece and (row[:2] != piece[-1][:2] or row[2] - piece[-1][2] > gap):
                    out += kept(piece)
                    piece = []
                piece.append(row)
            schema = batch.schema
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        if piece:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept(piece)), schema)], schema=schema)

    return run


def collapse_moments(results: DataFrame, gap: float = 0.5) -> DataFrame:
    """Walks each query's ranks and drops a result within ``gap`` seconds of a kept one of its video.

    results: query_id, rank, video_id, segment_id, peak_time. Nothing suppresses across a distance above the gap between neighbouring
    peaks, so rows sorted by peak are cut there, and each piece is walked by rank as it passes by.
    """
    rows = results.select("query_id", "video_id", "peak_time", "rank", "segment_id")
    kept = rows.repartition("query_id", "video_id").sortWithinPartitions("query_id", "video_id", "peak_time").mapInArrow(_apart(gap), rows.schema)
    return kept.select("query_id", "video_id", "rank", "segment_id", "peak_time")


def interpretations(queries: DataFrame, results: DataFrame) -> DataFrame:
    """insufficient_evidence for a query without results or with insufficient ones only, else answered."""
    seen = results.groupBy("query_id").agg(F.every(F.col("verdict") == "insufficient").alias("none"))
    return queries.select("query_id").join(seen, "query_id", "left").select("query_id", F.when(F.coalesce("none", F.lit(True)), "insufficient_evidence").otherwise("answered").alias("interpretation"))


def fuse_hypotheses(hypotheses: DataFrame, results: DataFrame, margin: float = 0.25, floor: float = 0.05) -> DataFrame:
    """hypotheses: query_id, hypothesis_id, prior; results: + segment_id, rank, score, confidence.

    Support is the best score times confidence of the first three results; posteriors are prior * (floor + support)
    normalised. The leader is chosen if it leads by the margin or no other hypothesis has results.
    """
    top = results.filter("rank <= 3").groupBy("query_id", "hypothesis_id").agg(F.max(F.col("score") * F.col("confidence")).alias("support"), F.count(F.lit(1)).alias("n"))
    known = hypotheses.join(top, ["query_id", "hypothesis_id"], "left").fillna({"support": 0.0, "n": 0})
    of_query = Window.partitionBy("query_id")
    weighted = known.withColumn("w", F.col("prior") * (floor + F.col("support")))
    posterior = weighted.withColumn("posterior", F.col("w") / F.sum("w").over(of_query))
    order = of_query.orderBy(F.desc("posterior"), "hypothesis_id")
    placed = posterior.withColumns({"place": F.row_number().over(order), "next": F.lead("posterior").over(order)})
    others = F.sum(F.when((F.col("place") > 1) & (F.col("n") > 0), 1).otherwise(0)).over(of_query)
    chosen = (F.col("place") == 1) & (F.col("n") > 0) & ((F.col("posterior") - F.coalesce("next", F.lit(0.0)) >= margin) | (others == 0))
    return placed.withColumn("selected", chosen).select("query_id", "hypothesis_id", "prior", "support", "posterior", "place", "selected")


def union_of_readings(results: DataFrame) -> DataFrame:
    """Results of several readings of a query as one list: the higher score (the first reading on ties) and the readings' sorted tags."""
    best = F.max_by(F.struct("score", "hypothesis_id"), F.struct(F.col("score"), -F.col("reading")))
    return results.groupBy("query_id", "segment_id").agg(best.alias("b"), F.sort_array(F.collect_set("hypothesis_id")).alias("readings")).select("query_id", "segment_id", "b.score", F.col("b.hypothesis_id").alias("best_reading"), "readings")


def keep_higher(*rankings: DataFrame) -> DataFrame:
    """Rankings (query_id, segment_id, score) merged, the higher score for each pair."""
    first, *rest = rankings
    for r in rest:
        first = first.unionByName(r)
    return first.groupBy("query_id", "segment_id").agg(F.max("score").alias("score"))


def blend_with_index(results: DataFrame, index: DataFrame, plans: DataFrame, weight: float = 0.2) -> DataFrame:
    """.8 score + .2 mean prediction for windows that have every action a query names. index: segment_id, label, confidence."""
    have = index.select("segment_id", F.col("label").alias("need"), "confidence")
    # only pairs that are results meet the index, not every query every window
    asked = results.select("query_id", "segment_id").distinct().join(needs(plans, "actions"), "query_id").join(have, ["segment_id", "need"])
    met = asked.groupBy("query_id", "segment_id").agg(F.count_distinct("need").alias("met"), F.first("n_needs").alias("n"), F.avg("confidence").alias("prediction")).filter("met = n").drop("met", "n")
    joined = results.join(met, ["query_id", "segment_id"], "left")
    return joined.withColumn("score", F.when(F.col("prediction").isNotNull(), (1 - weight) * F.col("score") + weight * F.col("prediction")).otherwise(F.col("score"))).drop("prediction")


def matches_pattern(plans: DataFrame, evidence: DataFrame, limit: int = 50) -> DataFrame:
    """Relational division over entities, actions, tokens and speaker: evidence is (segment_id, kind, need); first ``limit`` segments of each query by id.

    ``matches_whole_pattern`` also has predicates, tuples and substrings, and the order of time.
    """
    wanted = None
    for column, kind in (("entities", "entity"), ("actions", "action"), ("spoken_terms", "token")):
        part = plans.select("query_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(column)).alias("need"))
        wanted = part if wanted is None else wanted.union(part)
    wanted = wanted.union(plans.filter("speaker is not null").select("query_id", F.lit("speaker"), "speaker"))
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = evidence.select("segment_id", "kind", "need").join(wanted.select("kind", "need").distinct(), ["kind", "need"], "left_semi").distinct()
    met = wanted.join(asked, ["kind", "need"]).groupBy("query_id", "segment_id").agg(F.count(F.lit(1)).alias("met"))
    order = Window.partitionBy("query_id").orderBy("segment_id")
    return met.join(sizes, "query_id").filter("met = n").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "segment_id", "place")


#: So many distinct terms are tested in place.
FEW_TERMS = 64


def segments_containing(plans: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """query_id, need, segment_id: segments of whose texts (segment_id, text) one has the term as a substring.

    A term's first run of word characters lies within one token of such a text, so distinct terms meet distinct tokens, and tokens
    their segments; only then the text is fetched, once a segment and term, and the whole term tested. A term without word
    characters meets all tokens. Up to ``FEW_TERMS`` distinct terms are tested on the texts as they pass by, so neither tokens nor texts are shuffled.
    """
    wanted = plans.select("query_id", F.explode(F.array_distinct(column)).alias("need"))
    few = [r.need for r in wanted.select("need").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(few)))) if few else F.array().cast("array<string>")
        return wanted.join(texts.withColumn("low", F.lower("text")).select("segment_id", F.explode(held).alias("need")).distinct(), "need")
    terms = wanted.select("need").distinct().withColumn("word", F.regexp_extract("need", "[a-z0-9_]+", 0))
    index = texts.select("segment_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    vocabulary = index.select("token").distinct().join(terms, F.expr("contains(token, word)")).select("token", "need")
    likely = index.join(vocabulary, "token").select("segment_id", "need").distinct()
    found = likely.join(texts, "segment_id").filter(F.contains(F.lower("text"), F.col("need"))).select("segment_id", "need").distinct()
    return wanted.join(found, "need")


def matches_whole_pattern(met: DataFrame, sizes: DataFrame, segments: DataFrame, limit: int = 50) -> DataFrame:
    """Relational division over needs of every kind, in the order of time.

    met: query_id, kind, need, segment_id; sizes: query_id, n (needs of all kinds); segments: segment_id, start_time. The first
    ``limit`` segments of each query by start and id; a query without needs has none.
    """
    whole = met.distinct().groupBy("query_id", "segment_id").agg(F.count(F.lit(1)).alias("met")).join(sizes, "query_id").filter("met = n")
    order = Window.partitionBy("query_id").orderBy("start_time", "segment_id")
    return whole.join(segments.select("segment_id", "start_time"), "segment_id").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "segment_id", "start_time", "place")
