from __future__ import annotations

import itertools
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import ngram_join, shingles, spaced_seed
from sightline.llm.components import component_labels, joined_labels


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, list(groups.values())


def _corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((3, 6, 12, 60, 200)))] for _ in range(25)]
    texts = ["", None, "one", "One  ", "\t\n", "a b c d", "a b c d e"]
    while len(texts) < n:
        words = list(r.choice(bases))
        if r.random() < 0.3:
            words = passage + words
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append((" " if r.random() < 0.8 else "\n").join(words))
    return [(i if r.random() > 0.03 else None, t) for i, t in enumerate(texts)] + [(7, texts[20]), (7, texts[20])]


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = _corpus(seed)
        sets, groups = _components(rows)
        df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, node string").repartition(6)
        got = ngram_join.similar_groups(df).collect()
        want = []
        for g in groups:
            name = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
            want += [(rows[i][0], len(sets[i]), name if sets[i] else rows[i][0]) for i in g]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_of_each_group_stays(spark):
    rows = _corpus(3)
    sets, groups = _components(rows)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, node string, again int").repartition(6)
    got = ngram_join.one_of_each_group(df)
    assert got.columns == df.columns
    wordless = sum(not s for s in sets)
    assert got.count() == wordless + sum(bool(sets[g[0]]) for g in groups)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(df).count() == 0 and ngram_join.one_of_each_group(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_groups(df).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("per_task", [1000, 7])
def test_labels_of_long_chains(spark, per_task):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 2), (9, 9)], "a long, b long").repartition(4)
    known = component_labels(chain, per_task)
    got = {r.node: r.root for r in known.collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1} and known.count() == len(got)
    more = spark.createDataFrame([(2, 120), (500, 501), (501, 2)], "a long, b long")
    joined = joined_labels(known, more, per_task)
    got = {r.node: r.root for r in joined.collect()}
    assert set(got.values()) == {1} and set(got) == {*range(100, 141), 1, 2, 500, 501} and joined.count() == len(got)


def _leaky(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(40)] for _ in range(6)] + [[word() for _ in range(8)], [word() for _ in range(3)]]
    changed = [w if i % 9 else "zz" for i, w in enumerate(items[1])]
    filler = lambda n: [word() for _ in range(n)]
    texts = [
        filler(50) + items[0] + filler(9), filler(5) + changed, filler(60), [w.upper() + "," for w in items[2]], items[3][:16] + filler(30), items[4][:7] + filler(30), filler(4) + items[6] + filler(5), items[7] + filler(20),
        [w if i % 2 else "zz" for i, w in enumerate(items[5])], ["At"] * 3000,
    ]
    docs = [(i, " ".join(t), 1) for i, t in enumerate(texts)] + [(100, None, 1), (101, "", 1), (None, " ".join(items[0]), 1), (0, " ".join(texts[0]), 1), (200, ", ".join(items[7]).upper(), 1)]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, ""), (8, " ".join(items[7]))]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string")


def test_leaks_survive_substitutions_and_chance_does_not(spark):
    docs, bench = _leaky(spark)
    want = {(0, 0), (1, 1), (3, 2), (4, 3), (6, 6), (None, 0), (200, 7), (200, 8)}
    for block in (1 << 20, 300):
        found = spaced_seed.find_leaks(docs, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert sum(r.doc_id == 0 for r in found) == 2  # the repeated row too
    whole = next(r for r in found if (r.doc_id, r.item_id) == (0, 0))
    assert (whole.doc_word, whole.item_word, whole.span_words, whole.equal_words) == (50, 0, 40, 40)


def _brute_stretch(equal):
    best = (0, 0, 0)
    for end in range(len(equal) + 1):
        sums = [sum(1 if e else -2 for e in equal[start:end]) for start in range(end + 1)]
        if max(sums) > best[0]:
            best = (max(sums), sums.index(max(sums)), end)
    return best[1], best[2], sum(equal[best[1] : best[2]])


def _brute_leaks(doc, item):
    """All masks at all positions, all diagonals, all stretches, in lists of words."""
    if not item or len(item) < spaced_seed.SHORTEST:
        return (0, 0, len(doc), len(doc)) if item and doc == item else None
    masks = [*spaced_seed.MASKS, *(["1" * spaced_seed.SHORTEST] if len(item) < max(map(len, spaced_seed.MASKS)) + 3 else [])]
    begins = set()
    for mask in masks:
        for p in range(len(doc) - len(mask) + 1):
            for q in range(len(item) - len(mask) + 1):
                if all(doc[p + i] == item[q + i] for i, kept in enumerate(mask) if kept == "1"):
                    begins.add(p - q)
    best, need = None, min(spaced_seed.MIN_WORDS, -(-4 * len(item) // 5))
    for begin in sorted(begins):
        lo, hi = max(0, -begin), min(len(item), len(doc) - begin)
        start, end, equal = _brute_stretch([item[i] == doc[begin + i] for i in range(lo, hi)])
        if equal >= need and equal >= spaced_seed.IDENTITY * (end - start) and (not best or equal > best[3]):
            best = (begin + lo + start, lo + start, end - start, equal)
    return best


def test_leaks_equal_brute_force(monkeypatch):
    r = random.Random(9)
    for together in (spaced_seed.TOGETHER, 40):
        monkeypatch.setattr(spaced_seed, "TOGETHER", together)
        for few in (2, 60):  # few different words make very many hits
            word = lambda: f"w{r.randrange(few)}"
            items = [[word() for _ in range(r.choice((1, 3, 5, 9, 14, 30, 45)))] for _ in range(12)]
            docs = []
            for _ in range(12):
                doc = [word() for _ in range(r.randint(0, 30))] + list(r.choice(items)) + [word() for _ in range(r.randint(0, 20))]
                for _ in range(r.randint(0, 5)):
                    doc[r.randrange(len(doc))] = "other"
                docs.append(doc)
            docs += [[], items[0], ["w1"] * 90]
            index = spaced_seed.SeedIndex(list(range(len(items))), [" ".join(i) for i in items])
            got = {(row, item): tuple(leak) for row, item, *leak in index.leaks(pa.array([" ".join(d) for d in docs]))}
            want = {(d, i): leak for d, doc in enumerate(docs) for i, item in enumerate(items) if (leak := _brute_leaks(doc, item))}
            assert got == want


def test_repeated_words_take_bounded_work():
    index = spaced_seed.SeedIndex(list(range(10)), ["at " * 150 + f"at{i} " * i * 20 for i in range(10)])
    began = time.process_time()
    assert len({item for _, item, *_ in index.leaks(pa.array(["at " * 20_000, "at so " * 10_000]))}) == 10
    assert time.process_time() - began < 10


def test_words_hash_alike_wherever_they_stand():
    r = random.Random(1)
    texts = ["".join(r.choice([" ", "\n", "a", "B", "b", "é", "\x0b", "xyz", "\xa0", "A"]) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["w " * 400_000, "z" * 1_200_000 + " q", "", "z" * 1_200_000]
    h, at = shingles.word_hashes(pa.array(texts))
    name, word = {}, {}
    for i, text in enumerate(texts):
        own = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        assert len(own) == at[i + 1] - at[i]
        for w, x in zip(own, h[at[i] : at[i + 1]].tolist()):
            assert name.setdefault(w, x) == x and word.setdefault(x, w) == w
    part, at_part = shingles.word_hashes(pa.array(texts).slice(5, 100))
    assert (part == h[at[5] : at[105]]).all() and (at_part + at[5] == at[5:106]).all()


def test_leaky_rows_go_and_clean_rows_stay(spark):
    docs, bench = _leaky(spark)
    kept = spaced_seed.drop_leaks(docs, bench, block_bytes=400)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 7, 8, 9, 100, 101]  # 200 is an item of three words and nothing else
    assert spaced_seed.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    assert spaced_seed.find_leaks(docs.limit(0), bench).count() == 0


def test_words_built_to_collide_modulo_a_power_of_two(spark):
    """Letters by the parity of the place's bits: such a word and its swap agree under any polynomial modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    swap = word.translate(str.maketrans("ab", "ba"))
    filler = [f"w{i}" for i in range(20)]
    one, two = (list(shingles.shingle_sets(pa.array([" ".join([x] * 30 + filler)])))[0] for x in (word, swap))
    assert not set(one.tolist()) & set(two.tolist()) - set(list(shingles.shingle_sets(pa.array([" ".join(filler)])))[0].tolist())
    docs = spark.createDataFrame([(1, " ".join([word] * 40)), (2, " ".join([swap] * 40)), (3, f"{word} {swap} {word} {word} {swap} {word} {swap} {swap} x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs).collect()} == {1: 1, 2: 2, 3: 3}
    item = spark.createDataFrame([(0, " ".join([swap, "alpha", word, "beta", swap, "gamma", word, "delta", swap, "eta", "zeta", "theta"]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([word, "alpha", swap, "beta", word, "gamma", swap, "delta", word, "eta", "zeta", "theta"]))], "doc_id long, text string")
    assert spaced_seed.find_leaks(docs, item).count() == 0


def test_word_hashes_of_all_short_words_differ():
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abcdefghijklmnopqrstuvwxyz0123456789", repeat=n)]
    h, _ = shingles.word_hashes(pa.array([" ".join(words)]))
    again, at = shingles.word_hashes(pa.array(words))
    assert len(set(h.tolist())) == len(words) and (h == again).all() and (np.diff(at) == 1).all()


@pytest.mark.parametrize("block", [3, 10])
def test_many_small_components_share_an_ngram(spark, monkeypatch, block):
    """Minor nodes are dealt in blocks too; every pair that could link is still met."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng, rows = random.Random(block), []
    for g in range(25):
        own = [f"g{g}x{i}" for i in range(rng.randint(14, 40))]
        for c in range(rng.choice([1, 2, 3])):
            text = ["one", "phrase", "that", "everyone", "writes"] + own
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(5, len(text))] = f"c{c}"
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label and len(set(label.values())) < len(label)


def test_ngrams_that_agree_in_their_kept_bits_keep_the_least_position():
    """Node 5 has two n-grams under one kept part: the later position could rule out a link that the earlier allows."""
    keys = np.array([8 << ngram_join.PLACE_BITS | pos for pos in (3, 90, 4)], np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([100, 100, 101], pa.int32()), pa.array([5, 5, 6], pa.int64())], names=["key", "n", "node"])
    rows = [r for b in ngram_join._meet(75)(iter([batch])) for r in b.to_pylist() if r["n"] > 0]
    assert [(r["x"], r["y"], r["n"], r["pos"]) for r in rows] == [(8, 5, 100, 3), (8, 6, 101, 4)]


@pytest.mark.parametrize("crowd", [0, 2, 1 << 40])
def test_components_are_the_same_whatever_rows_carry_parts(spark, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    rows = [(i, t) for i, (_, t) in enumerate(_corpus(4))]
    sets, groups = _components(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: min(g) if sets[i] else i for g in groups for i in g}


def test_join_shuffles_less_than_nine_quarters_of_the_text(spark):
    """Without broadcasts, as at size; 2.37 times the text's bytes when the rows of every n-gram carried parts and were placed anew."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size, before = docs.selectExpr("sum(octet_length(text))").first()[0], shuffled()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ngram_join.similar_groups(docs).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled() - before < 2.25 * size
