"""Query texts as structured plans, by joins to vocabularies; readings of ambiguous ones; checks of foreign plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import tokens

#: Words that are never spoken terms, and cues of what a query is after.
STOP_WORDS = ("a", "an", "and", "any", "are", "at", "find", "for", "from", "in", "is", "me", "moment", "moments", "of", "on", "or", "please", "scene", "segment", "show", "someone", "the", "to", "video", "when", "where", "who", "with")
SPEECH_CUE = r"\b(said|say|says|saying|spoke|spoken|speak|talk about|talks about|mention|mentions|mentioned|discuss|discussed|discussing)\b"
SCREEN_CUE = r"\b(on screen|screen text|slide|slides|written|reads|caption|title card|ocr)\b"
LONGEST = 4


def phrases(queries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """query_id, at, n, phrase: all runs of up to ``longest`` tokens."""
    words = queries.select("query_id", tokens(F.col("text")).alias("w"))
    sizes = F.sequence(F.lit(1), F.lit(longest))
    spread = words.select("query_id", "w", F.posexplode("w").alias("at", "first")).select("query_id", "w", "at", F.explode(sizes).alias("n")).filter(F.col("at") + F.col("n") <= F.size("w"))
    return spread.select("query_id", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("phrase"))


def tagged(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lexicon: phrase, kind, canonical. Labels of each kind per query; where phrases overlap the longest, leftmost one counts.

    A phrase is kept if no longer (or equally long but earlier) match covers one of its tokens.
    """
    hits = phrases(queries).join(F.broadcast(lexicon), "phrase").withColumn("cell", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)))
    best = hits.withColumn("place", F.dense_rank().over(Window.partitionBy("query_id", "cell").orderBy(F.desc("n"), "at")))
    kept = best.groupBy("query_id", "at", "n", "kind", "canonical").agg(F.max("place").alias("worst")).filter("worst = 1")
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("canonical")))).alias(kind)
    return kept.groupBy("query_id").agg(of("entity"), of("action"), of("predicate"), F.collect_set(F.struct("at", "n")).alias("spans"))


def plans_of(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """query_id, entities, actions, predicates, speaker, spoken_terms, ocr_terms, intent of each query text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = queries.select("query_id", low.alias("low"), tokens(F.col("text")).alias("w")).join(tagged(queries, lexicon), "query_id", "left")
    none, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<at:int,n:int>>")
    found = found.select("query_id", "low", "w", *(F.coalesce(k, none).alias(k) for k in ("entity", "action", "predicate")), F.coalesce("spans", no_spans).alias("spans"))
    speaker = F.regexp_extract("low", r"speaker[_ ]?(\d+)", 1)
    free = F.filter(F.transform("w", lambda t, i: F.when(~F.exists("spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["n"])) & ~t.isin(*STOP_WORDS) & ~t.rlike("^(speaker.*|\\d+)$") & (F.length(t) > 1), t)), lambda t: t.isNotNull())
    said, shown = F.col("low").rlike(SPEECH_CUE), F.col("low").rlike(SCREEN_CUE)
    terms = F.array_distinct(F.filter(free, lambda t: ~t.rlike(SPEECH_CUE) & ~t.rlike(SCREEN_CUE)))
    out = found.withColumns({"speaker": F.when(speaker != "", F.concat(F.lit("SPEAKER_"), F.lpad(speaker, 2, "0"))), "terms": terms, "said": said, "shown": shown})
    intent = F.when(F.col("shown"), "ocr_search").when(F.col("said"), "transcript_search").when(F.size("predicate") > 0, "relationship_search").when(F.size("action") > 0, "action_search").when(F.size("entity") > 0, "visual_search").when(F.col("speaker").isNotNull(), "speaker_search").otherwise("multimodal_search")
    return out.select("query_id", F.col("entity").alias("entities"), F.col("action").alias("actions"), F.col("predicate").alias("predicates"), "speaker", F.when(F.col("shown"), none).otherwise(F.col("terms")).alias("spoken_terms"), F.when(F.col("shown"), F.col("terms")).otherwise(none).alias("ocr_terms"), intent.alias("intent"))


def readings(plans: DataFrame) -> DataFrame:
    """Readings of plans that admit more than one: a lone action (seen or said, even odds), lone entities (.6 seen, .4 said),
    a lone concept (.6 said, .4 on screen). Plans with a cue have one reading and give no rows."""
    cued = F.col("intent").isin("ocr_search", "transcript_search")
    bare = (F.size("predicates") == 0) & F.col("speaker").isNull() & (F.size("ocr_terms") == 0)

    def pair(first: str, second: str, odds: float) -> Column:
        return F.array(*(F.struct(F.lit(h).alias("hypothesis_id"), F.lit(p).alias("prior")) for h, p in ((first, odds), (second, 1 - odds))))

    lone_action = bare & (F.size("actions") == 1) & (F.size("entities") == 0) & (F.size("spoken_terms") == 0)
    lone_entity = bare & (F.size("entities") > 0) & (F.size("actions") == 0) & (F.size("spoken_terms") == 0)
    lone_concept = bare & (F.size("spoken_terms") > 0) & (F.size("entities") == 0) & (F.size("actions") == 0)
    both = F.when(lone_action, pair("visible_action", "spoken_mention", 0.5)).when(lone_entity, pair("visible_object", "spoken_mention", 0.6)).when(lone_concept, pair("spoken_mention", "visible_text", 0.6))
    return plans.filter(~cued).select("query_id", F.explode(both).alias("r")).select("query_id", "r.*")


def foreign_labels(plans: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Labels of plans (query_id, kind, label) that the vocabulary (kind, label) doesn't allow."""
    return plans.join(F.broadcast(vocabulary), ["kind", "label"], "left_anti")


def case_results(observed: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Null-safe comparison of fields per case: which differ, and whether it passed."""
    o = observed.select("query_id", *(F.col(f).alias(f"o_{f}") for f in fields))
    wrong = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"o_{f}")), F.lit(f)) for f in fields)))
    return expected.join(o, "query_id", "left").select("query_id", wrong.alias("wrong"), (F.size(wrong) == 0).alias("passed"))
