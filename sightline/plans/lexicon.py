"""Fixed vocabularies: synonyms, predicate properties, modality weights and source priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Words -> entity class.
ENTITY_SYNONYMS = {
    "people": "person", "persons": "person", "someone": "person", "somebody": "person", "man": "person", "woman": "person",
    "computer": "laptop", "notebook": "laptop", "white board": "whiteboard", "board": "whiteboard", "phone": "cell phone",
    "mobile": "cell phone", "table": "dining table", "desk": "dining table", "television": "tv",
}
#: Words -> predicate.
PREDICATE_SYNONYMS = {
    "next to": "near", "close to": "near", "beside": "near", "beneath": "below", "touching": "touches", "touch": "touches",
    "overlapping": "overlaps_with", "overlapping with": "overlaps_with", "overlaps": "overlaps_with", "overlaps with": "overlaps_with",
    "holding": "hold", "holds": "hold", "holding hands with": "hold_hand_of", "shaking hands with": "shake_hand_with",
    "looking at": "watch", "pointing to": "point_to", "points to": "point_to", "in front of": "in_front_of",
    "interacting with": "interacts_with", "writing on": "write_on", "write on": "write_on", "writes on": "write_on",
    "talk to": "talk_to", "talks to": "talk_to", "talking to": "talk_to", "speak to": "talk_to", "speaks to": "talk_to",
    "speak with": "talk_to", "speaking to": "talk_to", "speaking with": "talk_to", "speaking with each other": "talk_to",
}
#: Predicates that hold both ways in matching, in interval smoothing, and in relation data.
SYMMETRIC_IN_MATCHING = ("near", "overlaps_with", "touches", "hug", "kiss", "shake_hand_with", "hold_hand_of")
SYMMETRIC_IN_SMOOTHING = ("near", "overlaps_with", "touches")
#: How far each evidence source is trusted.
SOURCE_PRIORS = {
    "whisper_transcript": 0.90, "whisper_word_timing": 0.90, "easyocr": 0.80, "yolo_detection": 0.80, "pyannote_diarization": 0.75,
    "bounding_box_geometry": 0.65, "sentence_embedding": 0.60, "openclip_appearance": 0.55, "visual_attribute_model": 0.55,
    "relationship_gnn": 0.35, "gnn_action_model": 0.30, "gnn_action_plus_target_resolver": 0.25, "learned_action_model": 0.30,
    "heuristic_action_mapping": 0.40, "ava_ground_truth": 1.00, "manual_annotation": 1.00, "hashing_embedding": 0.35, "unknown": 0.50,
}
MODALITIES = ("transcript", "semantic", "ocr", "entity", "action", "relationship", "speaker", "appearance")
#: Weight of each modality, in the order above, by what a query is after.
INTENT_WEIGHTS = {
    "transcript_search": (1.0, 0.5, 0.3, 0.2, 0.2, 0.2, 0.6, 0.2),
    "ocr_search": (0.3, 0.4, 1.0, 0.3, 0.2, 0.2, 0.2, 0.2),
    "visual_search": (0.3, 0.3, 0.3, 1.0, 0.5, 0.5, 0.2, 0.9),
    "action_search": (0.3, 0.3, 0.2, 0.6, 1.0, 0.5, 0.2, 0.4),
    "relationship_search": (0.3, 0.3, 0.2, 0.6, 0.4, 1.0, 0.2, 0.4),
    "speaker_search": (0.6, 0.4, 0.2, 0.2, 0.2, 0.2, 1.0, 0.2),
    "multimodal_search": (1.0, 0.8, 0.8, 1.0, 0.8, 0.8, 0.8, 0.8),
}
SUPPORTED, WEAK = 0.45, 0.15


def synonyms(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(table.items()), "words string, canonical string")


def source_priors(spark: SparkSession, given: dict[str, float] | None = None) -> DataFrame:
    """Priors by source; ``given`` ones replace the defaults and must name known sources in [0, 1]."""
    given = given or {}
    wrong = [s for s, p in given.items() if s not in SOURCE_PRIORS or not 0 <= p <= 1]
    if wrong:
        raise ValueError(f"unknown sources or priors outside [0, 1]: {', '.join(sorted(wrong))}")
    return spark.createDataFrame(sorted((SOURCE_PRIORS | given).items()), "source_method string, prior double")


def intent_weights(spark: SparkSession) -> DataFrame:
    rows = [(i, m, w) for i, ws in INTENT_WEIGHTS.items() for m, w in zip(MODALITIES, ws)]
    return spark.createDataFrame(rows, "intent string, modality string, weight double")


#: Actions that are done to something, whether that is a person, and the predicate they become.
ACTION_TARGETS = (
    ("carry/hold", "object", "carry_hold"), ("point to", "object", "point_to"), ("write", "object", "write_on"),
    ("talk to", "person", "talk_to"), ("listen to", "person", "listen_to"), ("watch person", "person", "watch_person"), ("give/serve", "person", "give_serve_to"),
    ("grab person", "person", "grab_person"), ("hand shake", "person", "hand_shake"), ("hug", "person", "hug"), ("kick person", "person", "kick_person"), ("kiss", "person", "kiss"),
    ("lift person", "person", "lift_person"), ("push person", "person", "push_person"), ("sing to", "person", "sing_to"), ("take from person", "person", "take_from_person"),
)


def action_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTION_TARGETS, "label string, kind string, predicate string")
