"""Spelling variants of words by range searches in k-d trees over letter counts.

One edit adds a letter, takes one away or does both, so the letter counts of two near words are at an L1 distance of
two at most, one up and one down. Words of a length are looked for in the tree of that length and in the tree of the next; on the way
down a box is left out as soon as it asks for more letters up or down than the edit has. What is left
is verified letter by letter.

The trees are dealt over the cluster by a tree of the same kind, fitted on a bounded sample: its leaves are boxes of about ``LEAF_WORDS``
words. Every word is stored in the one box it lies in and asks only the boxes within one edit. The
sample only decides how even the boxes are, never what is found. In a task the stored words of a box make one
tree a length, the asking words stream past it. A word's answers are added up in the task before they are shuffled.

A word's form is its near word of the largest count (ties: the smallest), if that count is at least ``TIMES`` its
own; its root is the end of the chain of forms. Counts grow tenfold on each step, so five doublings of pointers reach any root.

Defined results: null words are left out; repeated words count once, with the sum of their counts; words may hold
any letters (code points share 160 counters, which prunes less but loses nothing) and be of any length, an empty
word too; an empty table gives no rows; only the two columns named are read, others may have any names. A box of words
with one and the same letter counts can't be divided; it is verified in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize

#: Words of a box, words of a tree's leaf, and times that a form is more frequent than its variant.
LEAF_WORDS, TREE_LEAF, TIMES = 40_000, 32, 10
#: Words that the dividing tree is fitted on: one of so many, at most so many.
SAMPLE_SHARE, SAMPLE_WORDS = 100, 100_000
#: Letters that are compared at once.
PIECE = 1 << 21
COUNTERS = 160
#: What a word is to a box, in the order of a box's rows.
HOME, OWN, LATER, NEXT = range(4)
LENGTH = COUNTERS


def _points(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word, and its length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cells = np.repeat(np.arange(len(words)), lengths) * COUNTERS + letters % COUNTERS
    counts = np.bincount(cells, minlength=len(words) * COUNTERS).reshape(-1, COUNTERS)
    return np.column_stack([counts, lengths]).astype(np.int32)


class BoxTree:
    """A k-d tree over points; each leaf is a box, ``leaves`` has the places of its points."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaves: list[np.ndarray] = []
        #: A node: dimension, cut (to the left what is not above it), bounds of the dimension so far, children; a leaf: its number.
        self.nodes: list[tuple | int] = []
        self._grow(points, np.arange(len(points)), {}, max(1, leaf))

    def _grow(self, points: np.ndarray, at: np.ndarray, bounds: dict[int, tuple[int, int]], leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(len(self.leaves))
        if len(at) > leaf:
            few = points[at[:: ceil(len(at) / 1000)]] if len(at) > 2000 else points[at]
            dim = int(few.var(0).argmax())
            values = points[at, dim]
            if values.min() == values.max():
                dim = int(np.ptp(points[at], 0).argmax())
                values = points[at, dim]
            if values.min() < values.max():
                cut = int(min(np.median(values), values.max() - 1))
                low, high = bounds.get(dim, (0, 1 << 30))
                left = self._grow(points, at[values <= cut], bounds | {dim: (low, cut)}, leaf)
                right = self._grow(points, at[values > cut], bounds | {dim: (cut + 1, high)}, leaf)
                self.nodes[me] = (dim, cut, low, high, left, right)
                return me
        self.leaves.append(at)
        return me

    def boxes(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the points that reach it with so many letters up and down); the length has to fit."""
        none = np.zeros(len(points), np.int32)
        stack = [(0, np.arange(len(points)), none, none)]
        while stack:
            node, at, rose, fell = stack.pop()
            if isinstance(self.nodes[node], int):
                yield self.nodes[node], at
                continue
            dim, cut, low, high, left, right = self.nodes[node]
            value, times = points[at, dim], 4 if dim == LENGTH else 1
            falls = fell + times * (np.maximum(value - cut, 0) - np.maximum(value - high, 0))
            rises = rose + times * (np.maximum(cut + 1 - value, 0) - np.maximum(low - value, 0))
            for child, r, f in ((left, rose, falls), (right, rises, fell)):
                near = (r <= up) & (f <= down)
                if near.any():
                    stack.append((child, at[near], r[near], f[near]))


def _router(words: DataFrame, total: int, leaf_words: int) -> BoxTree:
    size = min(SAMPLE_WORDS, ceil(total / SAMPLE_SHARE) + 1000)
    sample = [r.word for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(size).collect()]
    return BoxTree(_points(sample), max(8, leaf_words * len(sample) // max(total, 1)))


def _asked(points: np.ndarray, longer: int) -> np.ndarray:
    """Points that look for words longer by so many letters."""
    wanted = points.copy()
    wanted[:, LENGTH] += longer
    return wanted


def _routed(router: BoxTree):
    """Each word to the box it lies in (``HOME``) and to the boxes that it asks for its own length (``OWN``: its home, ``LATER``:
    boxes after it, since two words of a length need to meet once) and for the next (``NEXT``)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column(0).to_pylist())
            home = np.zeros(len(points), np.int64)
            for leaf, at in router.boxes(points, 0, 0):
                home[at] = leaf
            every = np.arange(len(points))
            same = [(k, at[home[at] < k]) for k, at in router.boxes(points, 1, 1)]
            longer = router.boxes(_asked(points, 1), 1, 0)
            for side, found in ((HOME, None), (OWN, None), (LATER, same), (NEXT, longer)):
                found = [*found] if found is not None else []
                at = np.concatenate([x for _, x in found]) if found else every if side in (HOME, OWN) else every[:0]
                leaf = np.concatenate([np.full(len(x), k) for k, x in found]) if found else home[at]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(np.full(len(at), side), pa.int32()), *(c.take(pa.array(at)) for c in batch.columns)], ["leaf", "side", "word", "n"])

    return route


class _Stored:
    """The words of a box by length: their letters as a matrix, their counts, and a tree over their letter counts."""

    def __init__(self, words: list[str], n: np.ndarray, tree_leaf: int) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)  # so that a smaller place is a smaller word
        self.words, self.n = [words[i] for i in order], n[order]
        points = _points(self.words)
        self.trees = {}
        for length in np.unique(points[:, LENGTH]):
            of = np.flatnonzero(points[:, LENGTH] == length)
            self.trees[int(length)] = of, _letters([self.words[i] for i in of], int(length)), BoxTree(points[of], tree_leaf)

    def near(self, words: list[str], points: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (word that asks, stored word) of near pairs."""
        asks, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in np.unique(points[:, LENGTH]):
            if (int(length) + longer) not in self.trees:
                continue
            of, stored, tree = self.trees[int(length) + longer]
            mine = np.flatnonzero(points[:, LENGTH] == length)
            letters = _letters([words[i] for i in mine], int(length))
            for leaf, at in tree.boxes(_asked(points[mine], longer), 1, 1 - longer):
                there = tree.leaves[leaf]
                step = max(1, PIECE // (len(there) * max(1, int(length))))
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    i, j = np.nonzero(_one_edit(letters[part], stored[there]))
                    asks.append(mine[part[i]])
                    hits.append(of[there[j]])
        return np.concatenate(asks), np.concatenate(hits)


def _letters(words: list[str], length: int) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether row i of the first is one replaced letter (equal lengths) or one inserted letter from row j of the second."""
    length = short.shape[1]
    short, long = short[:, None, :], long[None, :, :]
    if length == long.shape[2]:
        return (short != long).sum(2, dtype=np.int32) == 1
    if not length:
        return np.ones((len(short), long.shape[1]), bool)
    differs, shifted = short != long[:, :, :length], (short != long[:, :, 1:])[:, :, ::-1]
    ahead = np.where(differs.any(2), differs.argmax(2), length)
    behind = np.where(shifted.any(2), shifted.argmax(2), length)
    return ahead + behind >= length


def _best(of: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``of``: itself, how many rows it has, and the row with the largest n, then the smallest rank."""
    order = np.lexsort((rank, -n, of))
    who, first, count = np.unique(of[order], return_index=True, return_counts=True)
    return who, count, order[first]


_FOUND = "word string, n_near long, best_n long, best string"


def _searched(tree_leaf: int):
    def answers(names: list[str], of: np.ndarray, others: list[str], other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        who, count, row = _best(of, n[other], rank[other])
        best = other[row]
        return pa.RecordBatch.from_pydict({"word": pa.array([names[i] for i in who], pa.string()), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array([others[i] for i in best], pa.string())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by box, the stored words first."""
        box, stored, words, counts = None, None, [], []
        for batch in batches:
            leaves, sides, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
            names, begin = batch.column(2).to_pylist(), 0
            for (leaf, side), run in groupby(zip(leaves.tolist(), sides.tolist())):
                end = begin + sum(1 for _ in run)
                asking, asking_n = names[begin:end], n[begin:end]
                begin = end
                if leaf != box:
                    box, stored, words, counts = leaf, None, [], []
                if side == HOME:
                    words += asking
                    counts.append(asking_n)
                    continue
                if not words:
                    continue
                stored = stored or _Stored(words, np.concatenate(counts), tree_leaf)
                i, j = stored.near(asking, _points(asking), int(side == NEXT))
                if len(i):
                    yield answers(asking, i, stored.words, j, stored.n, np.arange(len(stored.words)))
                    if side != OWN:
                        rank = np.empty(len(asking), np.int64)
                        rank[sorted(range(len(asking)), key=asking.__getitem__)] = np.arange(len(asking))
                        yield answers(stored.words, j, asking, i, asking_n, rank)

    return search


def near_words(words: DataFrame, leaf_words: int = LEAF_WORDS, tree_leaf: int = TREE_LEAF) -> DataFrame:
    """words: word, n. A row a word: word, n, n_near, best_n and best (null without near words)."""
    words = materialize(words.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    total = words.count()
    router = _router(words, total, leaf_words)
    routed = words.mapInArrow(_routed(router), "leaf int, side int, word string, n long")
    found = routed.repartition(len(router.leaves), "leaf").sortWithinPartitions("leaf", "side").mapInArrow(_searched(tree_leaf), _FOUND)
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:bigint,word:string>").alias("near"))
    both = alone.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("near")))
    summed = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    return summed.select("word", "n", "n_near", (-F.col("near.minus")).alias("best_n"), F.col("near.word").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """links: word, root (its form). The same with the ends of the chains, by doubling pointers."""
    links = materialize(links, "roots")
    for _ in range(5):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(onward, "root", "left_semi").isEmpty():
            break
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links


def spelling_groups(words: DataFrame, times: int = TIMES, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """words: word, n. A row a word: word, form, root, n, n_near, form_n."""
    is_form = F.col("best_n") >= times * F.col("n")
    forms = materialize(near_words(words, leaf_words).select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
