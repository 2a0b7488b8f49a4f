"""Toxicity: Levenshtein automata over a lexicon trie, scored by context.

The lexicon is learned: words and word beginnings (trie nodes whose tail is open) that labelled toxic
documents hold far more often than clean ones. The trie and the Levenshtein automata of its terms are
run as one automaton, built as words need its states and started anew when they are many, so a word is matched in one pass over its
letters in bounded memory; terms of 5 letters and more allow one edit, of 9 and more two, shorter
ones and beginnings none. A hit inside quotation marks or after a reporting verb counts as quotation, any
other as abuse; the marks and verbs are looked for in a context window of ``WINDOW`` characters to either
side. A logistic model weighs exact, misspelled and quoted hits, their weights and their density.

Of terms that match a word, that with fewest edits counts, then a beginning before a whole word, then the
heavier. Training uses at most ``SAMPLE`` labelled rows, those of smallest hash, one text an id (a documented
bound), split into one part for the lexicon and one for the weights; the lexicon keeps the ``terms``
heaviest entries (a parameter). Labels, language, source and id are no inputs of a score.

Defined results: null text counts as empty and gets the model's score for no hits; without labels of
both kinds nothing is learned and every score is 0; labels that are null or lack a document are
passed over, as are those of null ids; of several labels of an id the toxic one counts, of several texts of
an id the one of smallest hash trains; very long words and texts are matched whole; repeated rows are rows
of their own, each with its score; an empty table gives no rows. Extra columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize

SAMPLE = 20_000
TERMS = 2_000
MIN_PART, MIN_DOCS, MIN_WEIGHT = 0.01, 4, 3.0
REJECT = 0.7
WINDOW = 80
#: Trie nodes in the states that an automaton holds, about; then it starts anew, as states are only a cache.
MEMBERS = 400_000
#: Words whose match a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Quotation marks, and words that report another's speech.
QUOTES = re.compile("[\"“”„«»‘]")
REPORTS = re.compile(r"\b(?:said|says|wrote|writes|called|quote[ds]?|quoting|reported|dijo|escribió|llamó|sagte|schrieb|nannte|dit|écrit|appelé)\b")
_WORD = re.compile(r"\w+")
DEAD = -1


class LexiconAutomaton:
    """terms: text -> weight; a text ending in ``*`` matches every word that begins with it."""

    def __init__(self, terms: dict[str, float]):
        self.terms = sorted(terms)
        self.weights = [terms[t] for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.open_at: dict[int, int] = {}
        self.reach = [0]  # most edits that a term below a node allows
        for number, term in enumerate(self.terms):
            open_tail = term.endswith("*")
            letters = term.rstrip("*")
            edits = 0 if open_tail else self.edits(letters)
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            (self.open_at if open_tail else self.term_at)[node] = number
        self._forget()

    def _forget(self) -> None:
        """Only the first state is known; the others are built again as words need them."""
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.size = 0
        self.start = self._state({0: 0})

    @staticmethod
    def edits(term: str) -> int:
        return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0

    def _state(self, at: dict[int, int]) -> int:
        """at: trie node -> fewest edits. Adds what skipped letters of the trie reach."""
        queue = list(at.items())
        while queue:
            node, e = queue.pop()
            if e < self.reach[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.reach[child] and at.get(child, 9) > e + 1:
                        at[child] = e + 1
                        queue.append((child, e + 1))
        if not at:
            return DEAD
        key = tuple(sorted(at.items()))
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            self.size += len(key)
            ends = [(e, self.term_at[n]) for n, e in key if n in self.term_at and e <= self.edits(self.terms[self.term_at[n]])]
            ends += [(0, self.open_at[n]) for n, e in key if n in self.open_at and e == 0]
            self.accepts.append(min(ends, key=lambda x: (x[0], not self.terms[x[1]].endswith("*"), -self.weights[x[1]], x[1])) if ends else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        at: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and at.get(node, 9) > e:
                at[node] = e

        for node, e in self.members[state]:
            if node in self.open_at and e == 0:
                put(node, 0)
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        self.moves[state][c] = to = self._state(at)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None."""
        if self.size > MEMBERS:
            self._forget()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == DEAD:
                return None
        return self.accepts[state]


class _Matches(dict):
    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        found = self.automaton.match(word)
        if len(self) < REMEMBERED and len(word) <= LONGEST:
            self[word] = found
        return found


FEATURES = 8


def features(text: str, matches: _Matches) -> list[float]:
    """Hits of a text as numbers: abusive, misspelled, by beginning, quoted, heaviest weight, three heaviest, density."""
    low = text.lower()
    words = _WORD.findall(low)
    if not any(map(matches.__getitem__, set(words))):
        return [0.0] * (FEATURES - 1) + [1.0]
    automaton, weights = matches.automaton, {}
    plain = near = opened = quoted = 0
    for m in _WORD.finditer(low):
        if not (hit := matches[m[0]]):
            continue
        edits, term = hit
        before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
        if (len(QUOTES.findall(before)) % 2 and QUOTES.search(after)) or REPORTS.search(before):
            quoted += 1
            continue
        weights[term] = automaton.weights[term]
        if automaton.terms[term].endswith("*"):
            opened += 1
        elif edits:
            near += 1
        else:
            plain += 1
    top = sorted(weights.values(), reverse=True)[:3]
    hits = plain + near + opened
    return [log(1 + plain), log(1 + near), log(1 + opened), log(1 + quoted), top[0] if top else 0.0, sum(top), 10 * hits / max(1, len(words)) ** 0.5, 1.0]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(text_col: str):
    """Distinct words of a text, and beginnings of 5 to 9 letters of its longer words, marked with ``*``."""

    @F.arrow_udf("array<string>")
    def entries(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = set(_WORD.findall((t or "").lower()))
            out.append(list(words | {w[:k] + "*" for w in words for k in range(5, 10) if len(w) > k}))
        return pa.array(out, pa.list_(pa.string()))

    return entries(F.col(text_col))


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> tuple[dict[str, float], list[float]]:
    """(lexicon, logistic weights) from labelled rows of folds 0 and 2; fold 1 is never looked at."""
    chosen = labels.filter((fold(id_col) != 1) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same")).join(F.broadcast(chosen), "id")  # at most ``sample`` ids
    first = rows.groupBy("id").agg(F.min("same").alias("same"))  # a row for each id, however often it is repeated
    rows = rows.dropDuplicates(["id", "same"]).join(first, ["id", "same"], "left_semi")
    rows = materialize(rows.withColumn("part", fold("id")), "labelled")
    words = rows.filter("part = 0").groupBy("same").agg(F.first("text").alias("text"), F.max("y").alias("y")).select("y", F.explode(_entries("text")).alias("entry"))
    counts = rows.filter("part = 0").agg(F.count_distinct(F.when(F.col("y") == 1, F.col("same"))).alias("toxic"), F.count_distinct(F.when(F.col("y") == 0, F.col("same"))).alias("clean")).first()
    if not counts.toxic or not counts.clean:
        return {}, []
    toxic, clean = F.col("toxic"), F.col("clean")
    weight = F.log((toxic + 0.1) / (counts.toxic + 0.2)) - F.log((clean + 0.1) / (counts.clean + 0.2))
    found = (
        words.groupBy("entry")
        .agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("clean"))
        .filter((toxic >= max(MIN_DOCS, MIN_PART * counts.toxic)) & (weight >= MIN_WEIGHT))
        .select("entry", "toxic", "clean", weight.alias("weight"))
        .orderBy(F.desc("weight"), F.desc("toxic"), "entry")
        .limit(terms)
        .collect()
    )
    lexicon = _without_covered({r.entry: (r.weight, r.toxic) for r in found})
    if not lexicon:
        return {}, []

    @F.arrow_udf("array<double>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matches = _Matches(LexiconAutomaton(lexicon))
        for t in texts:
            yield pa.array([features(x or "", matches) for x in t.to_pylist()], pa.list_(pa.float64()))

    seen = rows.filter("part = 2").select("y", of("text").alias("x")).collect()  # at most ``sample`` rows of 8 numbers
    y = np.array([r.y for r in seen], float)
    if not len(y) or y.min() == y.max():
        return {}, []
    return lexicon, _fit(np.array([r.x for r in seen]), y).tolist()


def _without_covered(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """All words, so that their misspellings match too; a beginning only if it finds more than the words below it, and no shorter one does."""
    kept: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (not e.endswith("*"), len(e), e)):
        weight, docs = found[entry]
        if entry.endswith("*"):
            best = max((found[w][1] for w in found if not w.endswith("*") and w.startswith(entry[:-1])), default=0)
            if docs < 1.5 * best or any(entry[:k] + "*" in kept for k in range(5, len(entry) - 1)):
                continue
        kept[entry] = weight
    return kept


def score(model: tuple[dict[str, float], list[float]]):
    """A function from a text column to its score in 0..1."""
    lexicon, weights = model

    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matches, w = _Matches(LexiconAutomaton(lexicon)), np.array(weights)
        for t in texts:
            if not len(w):
                yield pa.array(np.zeros(len(t)))
                continue
            x = np.array([features(s or "", matches) for s in t.to_pylist()]).reshape(-1, FEATURES)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return of


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, held_out, score, predicted."""
    of = score(train(docs, labels, id_col, text_col))
    scored = docs.select(F.col(id_col), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), of(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows scored under ``REJECT``, with the columns of ``docs``."""
    return docs.filter(score(train(docs, labels, id_col, text_col))(F.col(text_col)) < REJECT)
