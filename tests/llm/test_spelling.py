"""Near words, forms and roots against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sightline.llm import spelling_variants as sv


def _is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(counts: dict[str, int]) -> set[tuple]:
    form, out = {}, {}
    for w, n in counts.items():
        near = [(-m, o) for o, m in counts.items() if _is_near(w, o)]
        best = min(near, default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
        out[w] = len(near)

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return {(w, form[w], root(w), n, out[w], counts.get(form[w])) for w, n in counts.items()}


def _words(seed: int, size: int, letters: str = "abcdeÀñ") -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 5, 5, 6, 7, 8]))) for _ in range(size)}
    for w in list(words)[::3]:
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    return {w: rng.choice([2, 3, 30, 31, 400, 5000, 60_000]) for w in words}


@pytest.mark.parametrize("leaf", [40, 10_000])
def test_equals_brute_force(spark, leaf):
    counts = _words(leaf, 400)
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, best string, leaf int").repartition(3)
    got = {tuple(r) for r in sv.spelling_groups(df, leaf_words=leaf).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == _brute(counts)
    assert any(r[1] and r[2] != r[1] for r in got)  # chains of forms


def test_odd_words(spark):
    long = "ab" * 10_000
    rows = [(None, 5), ("x", 2), ("x", 3), ("", 4), ("日本語", 50), ("日本", 5), ("a\U0001f600b", 7), (long, 2), (long + "c", 30), (long[1:], 4)]
    got = {r.word: (r.n, r.n_near, r.form, r.root) for r in sv.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"x": (5, 1, None, "x"), "": (4, 1, None, ""), "日本語": (50, 1, None, "日本語"), "日本": (5, 1, "日本語", "日本語"), "a\U0001f600b": (7, 0, None, "a\U0001f600b"), long: (2, 2, long + "c", long + "c"), long + "c": (30, 1, None, long + "c"), long[1:]: (4, 1, None, long[1:])}
    assert sv.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_boxes_lose_no_point_within_an_edit():
    words = list(_words(3, 300))
    points = sv._points(words)
    tree = sv.BoxTree(points, 5)
    home = np.empty(len(words), int)
    for k, leaf in enumerate(tree.leaves):
        home[leaf] = k
    assert sum(map(len, tree.leaves)) == len(words)
    reached = {(i, k) for longer in (0, 1) for k, at in tree.boxes(sv._asked(points, longer), 1, 1 - longer) for i in at}
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if len(words[j]) - len(words[i]) in (0, 1) and _is_near(words[i], words[j])]
    assert len(pairs) > 100 and all((i, home[j]) in reached for i, j in pairs)
    assert len(reached) < 0.5 * len(words) * len(tree.leaves)


def test_anagrams_fill_one_box(spark):
    import itertools

    words = ["".join(p) for p in itertools.permutations("abcdef")] + ["abcdee", "abcde"]
    got = sv.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), leaf_words=50).collect()
    assert {(r.word, r.n_near) for r in got} == {(w, sum(_is_near(w, o) for o in words)) for w in words}
