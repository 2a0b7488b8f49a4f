from __future__ import annotations

import random
import zlib

import corpus_pipeline


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    near = text(120).split()
    rows = [(i, text(60) + (" you worthless pathetic moron idiot " if i % 4 == 0 else " ") + text(10), "en", f"s{i % 3}", 1, None) for i in range(240)]
    rows += [(1000, "Same Text here", "en", "s0", 1, 1), (1001, "same text HERE", "en", "s0", 1, 2), (1002, " ".join(near), "en", "s1", 1, 3), (1003, " ".join(near[:-1] + ["zz"]), "en", "s1", 1, 4), (1004, text(20) + " " + item, "en", "s2", 1, 5), (1005, None, "en", None, None, 6), (None, text(30), None, "s0", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/out-{name}"
        stage(spark, at, str(tmp_path)).write.parquet(out)
        at = spark.read.parquet(out)
        seen[name] = at
    ids = {n: {x.doc_id for x in seen[n].select("doc_id").collect()} for n in seen}
    clean = {i for i in range(240) if i % 4} | {None, 1005}
    assert ids["toxicity"] == clean | {1000, 1001, 1002, 1003, 1004}
    assert ids["exact_dedup"] == clean | {1001, 1002, 1003, 1004}
    assert ids["ngram_jaccard_join"] == clean | {1001, 1002, 1004}
    assert ids["benchmark_decontamination"] == clean | {1001, 1002}
    assert ids["packing"] == clean | {1001, 1002}
    assert all(seen[n].columns == docs.columns for n in list(seen)[:-1])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == seen["packing"].count() and zlib.crc32(b"") == 0
