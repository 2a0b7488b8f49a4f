"""Evidence frames derived from the driver's tables, in expressions that Spark and ANSI SQL engines read alike.

One day of ``events`` stands for one second of media time. The frames are functions of whole tables,
so work on them grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: frame -> (source table, condition, {column: expression})
FRAMES: dict[str, tuple[str, str, dict[str, str]]] = {}

_CLASS_PLACE = "(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)"
_X1 = f"round(0.05e0+0.16e0*{_CLASS_PLACE}+0.01e0*((day(ts)-1)%5)+0.005e0*(event_id%7),4)"
_Y1 = "round(0.1e0+0.02e0*(event_id%11),4)"
FRAMES["detections"] = (
    "events",
    "1 = 1",
    {
        "detection_id": "event_id",
        "video_id": "concat('v',user_id)",
        "frame_id": "concat('v',user_id,':',day(ts)-1)",
        "timestamp": "cast(day(ts)-1 as double)",
        "class_label": "CASE event_type WHEN 'error' THEN 'laptop' WHEN 'purchase' THEN 'chair' WHEN 'view' THEN 'cup' ELSE 'person' END",
        "confidence": "0.25e0+(event_id*13%75)/100e0",
        "x1": _X1,
        "y1": _Y1,
        "x2": f"{_X1}+round(0.1e0+0.02e0*(event_id%5),4)",
        "y2": f"{_Y1}+round(0.2e0+0.03e0*(event_id%9),4)",
    },
)
FRAMES["transcripts"] = (
    "conversations",
    "text IS NOT NULL",
    {
        "utterance_id": "conv_id*1000+turn",
        "video_id": "concat('v',conv_id%150)",
        "start_time": "turn*4e0",
        "end_time": "turn*4e0+1e0+(length(text)%60)/10e0",
        "text": "text",
    },
)
FRAMES["speaker_turns"] = (
    "conversations",
    "text IS NOT NULL",
    {
        "turn_id": "conv_id*1000+turn",
        "video_id": "concat('v',conv_id%150)",
        "start_time": "turn*4e0+0.5e0",
        "end_time": "turn*4e0+4e0+(turn%3)*0.5e0",
        "speaker": "CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END",
    },
)
FRAMES["ocr_tokens"] = (
    "documents",
    "text IS NOT NULL",
    {
        "token_id": "doc_id",
        "video_id": "concat('v',doc_id%50)",
        "timestamp": "floor(doc_id/50)*1e0",
        "raw_text": "substr(lower(text),1,24)",
        "raw_confidence": "0.3e0+(doc_id*7%70)/100e0",
    },
)
FRAMES["actions"] = (
    "events",
    "1 = 1",
    {
        "action_id": "event_id",
        "video_id": "concat('v',user_id)",
        "timestamp": "cast(day(ts)-1 as double)",
        "label": "CASE event_id%5 WHEN 0 THEN 'talk to' WHEN 1 THEN 'watch person' WHEN 2 THEN 'sit' WHEN 3 THEN 'stand' ELSE 'carry/hold' END",
        "source_method": "CASE event_id%3 WHEN 0 THEN 'ava_ground_truth' WHEN 1 THEN 'gnn_action_model' ELSE 'learned_action_model' END",
        "confidence": "CASE WHEN event_id%10=0 THEN NULL ELSE round(abs(value)/(abs(value)+50e0),6) END",
    },
)
FRAMES["annotations"] = (
    "lineitem",
    "1 = 1",
    {
        "video_id": "concat('s',l_suppkey)",
        "timestamp": "l_linenumber*1e0",
        "action_id": "cast(1+l_partkey%80 as int)",
        "entity_id": "concat('e',l_orderkey%5)",
        "x1": "round((l_orderkey%10)/20e0,4)",
        "y1": "round((l_orderkey%7)/14e0,4)",
        "x2": "round((l_orderkey%10)/20e0+0.4e0,4)",
        "y2": "round((l_orderkey%7)/14e0+0.4e0,4)",
        "row_id": "l_orderkey*10+l_linenumber",
    },
)
FRAMES["label_scores"] = (
    "labels",
    "quality IS NOT NULL AND toxic IS NOT NULL",
    {"item_id": "doc_id", "quality": "cast(quality as int)", "toxic": "cast(toxic as int)", "p": "((doc_id*37)%101)/100e0"},
)
FRAMES["media"] = ("documents", "text IS NOT NULL", {"video_id": "doc_id", "sha": "md5(text)", "uploaded": "doc_id%97"})
FRAMES["appearances"] = ("embeddings", "1 = 1", {"appearance_id": "vec_id", "video_id": "concat('v',vec_id%150)", "track": "label", "embedding": "embedding"})
FRAMES["appearance_records"] = (
    "embeddings",
    "1 = 1",
    {
        "appearance_id": "vec_id",
        "video_id": "concat('v',vec_id%150)",
        "track": "label",
        "class_label": "CASE vec_id%4 WHEN 0 THEN 'laptop' WHEN 1 THEN 'cup' ELSE 'person' END",
        "vector": "embedding",
        "observations": "1+vec_id%6",
        "model": "CASE WHEN vec_id%11=0 THEN 'older' ELSE 'clip' END",
    },
)
FRAMES["appearance_colors"] = ("embeddings", "1 = 1", {"appearance_id": "vec_id", "name": "'color'", "value": "CASE vec_id%3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'black' END", "confidence": "round((vec_id*37%100)/100e0,4)"})
FRAMES["appearance_bags"] = ("embeddings", "vec_id%2=0", {"appearance_id": "vec_id", "name": "'bag'", "value": "CASE vec_id%5 WHEN 0 THEN 'no' ELSE 'yes' END", "confidence": "round((vec_id*53%100)/100e0,4)"})
FRAMES["runs"] = (
    "events",
    "1 = 1",
    {
        "query_id": "user_id",
        "rank_id": "event_id",
        "video_id": "concat('v',user_id%20)",
        "score": "round(abs(value)/(abs(value)+50e0),4)",
        "start_time": "(event_id%40)*5e0",
        "end_time": "(event_id%40)*5e0+5e0",
        "method": "CASE event_id%2 WHEN 0 THEN 'lexical' ELSE 'hybrid' END",
        "confidence": "round((event_id*17%101)/100e0,4)",
    },
)
FRAMES["relevant"] = (
    "customer",
    "c_custkey%3<>0",
    {
        "query_id": "c_custkey",
        "moment": "c_custkey%7",
        "video_id": "concat('v',c_custkey%20)",
        "start_time": "(c_custkey%40)*5e0+2e0",
        "end_time": "(c_custkey%40)*5e0+9e0",
        "peak_time": "(c_custkey%40)*5e0+4e0",
        "tolerance": "2e0",
        "category": "c_mktsegment",
    },
)
FRAMES["plans"] = (
    "supplier",
    "1 = 1",
    {
        "query_id": "s_suppkey",
        "intent": "CASE s_suppkey%5 WHEN 0 THEN 'visual_search' WHEN 1 THEN 'action_search' WHEN 2 THEN 'transcript_search' WHEN 3 THEN 'speaker_search' ELSE 'multimodal_search' END",
        "entity_list": "CASE WHEN s_suppkey%5=0 THEN 'laptop,person' WHEN s_suppkey%5=4 THEN 'cup' ELSE '' END",
        "action_list": "CASE WHEN s_suppkey%5=1 THEN 'sit,stand' WHEN s_suppkey%10=4 THEN 'sit' ELSE '' END",
        "term_list": "CASE WHEN s_suppkey%5=2 THEN 'the,with,thaner' WHEN s_suppkey%20=9 THEN 'is,de' ELSE '' END",
        "speaker": "CASE WHEN s_suppkey%5=3 THEN concat('SPEAKER_0',s_suppkey%2) END",
    },
)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, condition, columns = FRAMES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").where(condition).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as on-screen readings: every line of a document is one, at the video and second of its ``ocr_tokens`` row."""
    _, condition, columns = FRAMES["ocr_tokens"]
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").where(condition).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.selectExpr("doc_id*1000000+line AS token_id", *(f"{columns[c]} AS {c}" for c in ("video_id", "timestamp", "raw_confidence")), "text AS raw_text")


def with_frames(*names: str) -> str:
    """The same frames as common table expressions, for the comparison engine."""
    parts = []
    for name in names:
        source, condition, columns = FRAMES[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})")
    return "WITH " + ",\n".join(parts)


def rounded(column, places: int = 4) -> Column:
    """Half up by arithmetic alone, so that engines agree on ties: floor(x * 10**places + 0.5) / 10**places."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * float(10**places) + 0.5) / float(10**places)


def arithmetic_rounding(sql: str) -> str:
    """``round(x, n)`` of a query's SQL as the arithmetic of ``rounded``."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        if sql[at - 1 : at].isalnum():
            at += 1
            continue
        depth, end, comma = 0, at + 5, -1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        places = sql[comma + 1 : end].strip() if comma > 0 else ""
        if places.isdigit():
            sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]})*1e{places}+0.5e0)/1e{places}){sql[end + 1 :]}"
        at += 1
    return sql
