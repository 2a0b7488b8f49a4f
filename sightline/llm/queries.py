"""The registered queries of this subpackage: thin digests of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import conversation_repair, exact_topk, grace_dedup, html_blocks, ngram_join, packing, pii, sharding, spaced_seed, spelling_variants, token_counts, toxicity, url_reputation
from sightline.llm.common import CRC_TABLE_SQL, ascii_lower, crc32_sql, table


def op1_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return placed.select(F.col("row.doc_id").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _damaged(conversations: DataFrame) -> DataFrame:
    """One row of 20 is lost, one loses its text, one its full stops, one is there twice, one is said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.filter("damage <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _repaired(batches: Iterator) -> Iterator:
    """Edits by conversation in order: its audit, and the hash of what it says now, taken as the text passes by."""
    import hashlib

    import pyarrow as pa

    now, audit, said, any_said, out, begun = None, [], hashlib.sha256(), False, [], False
    for batch in batches:
        for x in batch.to_pylist():
            if not begun or x["conv_id"] != now:
                if begun:
                    out.append({"conv_id": now, "audit": "".join(audit), "repaired_sha256": said.hexdigest()})
                now, audit, said, any_said, begun = x["conv_id"], [], hashlib.sha256(), False, True
            audit.append(x["edit"] * x["times"])
            if x["role"] is not None:
                said.update(f"{chr(10) if any_said else ''}{x['role']}:{x['text']}".encode())
                any_said = True
        schema = pa.schema([batch.schema.field("conv_id"), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if begun:
        yield pa.RecordBatch.from_pylist([{"conv_id": now, "audit": "".join(audit), "repaired_sha256": said.hexdigest()}], schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    reports, edits = conversation_repair.repair(_damaged(conversations))
    told = edits.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step").mapInArrow(_repaired, f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")
    counts = [c for c in reports.columns if c != "conv_id"]
    parts = conversations.select("conv_id").distinct().unionByName(reports, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 7 letters; one run of 31, drawn by document and word, loses a letter."""
    docs = table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))).alias("run"))
    runs = runs.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), ascii_lower(F.col("run"))).alias("drawn_by"), ascii_lower(F.col("run")).alias("run"))
    drawn = F.crc32("drawn_by")
    at = F.pmod(drawn, F.length("run"))
    lost = F.concat(F.col("run").substr(F.lit(1), at.cast("int")), F.col("run").substr(at.cast("int") + 2, F.length("run")))
    words = runs.select(F.when(drawn % 31 == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= 7)
    return spelling_variants.spelling_groups(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_topk.top_matches(vectors, F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed": op1_spaced_seed,
    "op2_grace_dedup": op2_grace_dedup,
    "op3_url_reputation": op3_url_reputation,
    "op4_toxicity": op4_toxicity,
    "op5_html_blocks": op5_html_blocks,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_ngram_join": op9_ngram_join,
    "op10_external_shuffle": op10_external_shuffle,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_topk": op13_exact_topk,
}

ORACLES: dict[str, str] = {
    "op2_grace_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""",
    "op3_url_reputation": url_reputation.ORACLE,
    "op11_conversation_repair": f"""
WITH RECURSIVE {CRC_TABLE_SQL},
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE damage <> 0),
ordered AS (
  SELECT *, row_number() OVER w AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM ordered),
reports AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after a
inserts(state, upto, cost, edits, said) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']),
  (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
letters(letter, state, upto) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
steps(conv_id, k, state, best) AS (
  SELECT conv_id, 0, 0, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} FROM reports
  UNION ALL
  SELECT conv_id, k, upto, min({{'cost': cost, 'audit': audit, 'said': said}}) FROM (
    SELECT s.conv_id, s.k + 1 AS k, e.upto, s.best.cost + i.cost + e.cost AS cost, s.best.audit || i.edits || e.edit AS audit, s.best.said || i.said || e.said AS said
    FROM steps s JOIN inserts i ON i.state = s.state JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.k = s.k + 1,
    LATERAL (
      SELECT i.upto AS upto, 2 AS cost, 'D' AS edit, []::VARCHAR[] AS said
      UNION ALL SELECT l.upto, CASE WHEN j.fault IS NULL THEN 0 ELSE 5 END, 'K', [j.role || ':' || j.text] FROM letters l WHERE l.state = i.upto AND l.letter = left(j.role, 1) AND coalesce(j.fault, 'truncated') = 'truncated'
      UNION ALL SELECT l.upto, CASE WHEN j.fault IS NULL THEN 1 ELSE 6 END, 'R', [CASE l.letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] FROM letters l WHERE l.state = i.upto AND l.letter <> 's' AND coalesce(j.fault, 'truncated') = 'truncated') e)
  GROUP BY conv_id, k, upto),
ended AS (
  SELECT s.conv_id, min({{'cost': s.best.cost + i.cost, 'audit': s.best.audit || i.edits, 'said': s.best.said || i.said}}) AS best
  FROM steps s JOIN reports r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.k JOIN inserts i ON i.state = s.state AND i.upto IN (0, 3) GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN reports r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
drawn AS (SELECT run, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM drawn)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
-- near words share a string that is made by taking one letter out of one of them or, at the same place, of both
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM words, range(1, length(word) + 1) AS r(i)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.root AND e.form IS NULL
""",
    "op13_exact_topk": exact_topk.ORACLE,
    "op9_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes sx ON sx.doc_id = x.doc_id JOIN sizes sy ON sy.doc_id = y.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(sx.n) + any_value(sy.n) - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
""",
}
