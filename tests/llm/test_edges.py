"""Very long texts, empty tables and clashing columns through every operator of documents, and through the pipeline."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from sightline.llm import grace_dedup, ngram_join, packing, pii, sharding, spaced_seed, token_counts, toxicity

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a purple potion"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(150_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, node string, row string, queue int, key string, bucket int"
TEXTS = [LONG, LONG.upper(), LONG + " " + ITEM, "z" * 1_000_000, "same " * 100_000, "", None, "a@b.co 4539 1488 0343 6467 " * 5_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, "n", "r", 1, "k", 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    return labels, spark.createDataFrame([(0, ITEM)], "item_id long, text string")


def test_long_texts(docs, tables):
    labels, benchmark = tables
    assert {(r.doc_id, r.item_id) for r in spaced_seed.find_leaks(docs, benchmark).collect()} == {(2, 0)}
    groups = {r.doc_id: (r.keep_id, r.group_size) for r in grace_dedup.exact_groups(docs).collect()}
    assert groups[0] == groups[1] == (1, 2) and groups[5] == groups[6] == (6, 2) and groups[3] == (3, 1)
    assert toxicity.score_documents(docs, labels).count() == len(TEXTS)
    tokens = {r.doc_id: r for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert tokens[0].over_limit and tokens[5].n_tokens == tokens[6].n_tokens == 0 and tokens[3].n_bytes == 1_000_000
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert (found[7].n_email, found[7].n_card, found[0].n_phone) == (5_000, 5_000, 0)
    alike = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert alike[0][1] == alike[1][1] == alike[2][1] == 0 and alike[3] == (1, 3) and alike[4] == (1, 4) and alike[6] == (0, 6)
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 3).collect()) == [(s, i) for s, n in ((0, 3), (1, 3), (2, 2)) for i in range(n)]


def test_long_texts_are_packed_whole(docs):
    sizes = {}
    for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "length", "doc_tokens").collect():
        sizes.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert len(sizes) == len(TEXTS) and all(sum(lengths) == n for (_, n), lengths in sizes.items())


def test_pipeline_without_rows(spark, docs, tables, tmp_path):
    labels, benchmark = tables
    for name, table in (("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)), ("labels", labels.limit(0)), ("benchmark", benchmark.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
