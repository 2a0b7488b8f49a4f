"""Token counts by map-side lookup in two tiers.

A pre-token is what stands between two spaces, or a newline and what follows it up to the next space. Each
task splits many texts at once and looks their distinct pre-tokens up: first in tier one, a broadcast
Arrow hash table of the lengths of frequent ones, then in the worker's own cache, tier two; what neither
holds is encoded once per worker. Counts add up because no piece of the vocabulary joins characters
across a pre-token's edge; this is checked when the model is loaded, and a model for which it doesn't hold
encodes whole texts, as do texts with runs of spaces.

Pre-tokens are never shuffled: tier one is counted on the driver over a sample of at most ``SAMPLE`` rows and
``SAMPLE_CHARS`` characters of each, and has at most ``ENTRIES``. It only saves time; every text is counted whole,
with or without it.

Defined results: null text counts as empty (no bytes, no tokens); texts of any length are counted whole;
repeated rows and null ids each get a row; an empty table gives none. Only id and text are read, other
columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import chunks

#: Rows of the sample that tier one is counted on, characters of each, and entries of tier one.
SAMPLE, SAMPLE_CHARS, ENTRIES = 2_000, 2_000, 20_000
#: Misses that a worker remembers, and the bytes of the longest of them; misses that are encoded in one text.
REMEMBERED, LONGEST, TOGETHER = 200_000, 64, 256
#: Bytes of text that are split together.
CHUNK_BYTES = 4 << 20
SPACE = "▁"
_RUNS = re.compile(f"\n|[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+")


class PieceCounter:
    """Exact token counts of a sentencepiece model; ``known`` holds lengths of pre-tokens found frequent."""

    def __init__(self, model: str, known: pa.RecordBatch | None = None) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        plain = self.sp.encode("a  b \ufb01\xa0x", out_type=str)
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and "".join(plain) == f"{SPACE}a{SPACE}{SPACE}b{SPACE}\ufb01\xa0x"
        nothing = (pa.array([], pa.large_string()), np.zeros(0, np.int64))
        #: Tier one and tier two: words and their lengths.
        self.known, self.cache = (known.column(0), known.column(1).to_numpy()) if known else nothing, nothing
        self.begins_word = np.array([self.sp.id_to_piece(i).startswith(SPACE) for i in range(self.sp.get_piece_size())])
        *_, self.newline_id = self.sp.encode("x\n")
        self.splits = self.splits and self.sp.encode("x\n") == [*self.sp.encode("x"), self.newline_id]

    def _encoded(self, words: pa.Array) -> np.ndarray:
        """Tokens of pre-tokens: after a space, or with the newline that they begin with. Many are encoded in one text and told apart by their first tokens."""
        out = np.ones(len(words), np.int64)  # a space alone is one token
        after_newline = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        for which, first, glue in ((~after_newline & ~empty, "", " "), (after_newline, "x", "")):
            at = np.flatnonzero(which)
            some = words.take(pa.array(at)).to_pylist()
            ids = [np.array(x, np.int64) for x in self.sp.encode([first + glue.join(some[i : i + TOGETHER]) for i in range(0, len(some), TOGETHER)])]
            for i, x in zip(range(0, len(some), TOGETHER), ids):
                starts = np.flatnonzero(x == self.newline_id if first else self.begins_word[x])
                lengths = np.diff(np.append(starts, len(x)))
                if len(lengths) != len(some[i : i + TOGETHER]):  # some pre-token looks like two
                    lengths = [len(own) - bool(first) for own in self.sp.encode(some[i : i + TOGETHER])]
                out[at[i : i + TOGETHER]] = lengths
        return out

    def of_words(self, words: pa.Array) -> np.ndarray:
        """The lengths of distinct pre-tokens: tier one, tier two, then the encoder."""
        out, left = np.zeros(len(words), np.int64), np.arange(len(words))
        for table, lengths in (self.known, self.cache):
            if len(table) and len(left):
                at = pc.index_in(words.take(pa.array(left)), table)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                out[left[hit]] = lengths[at.drop_null().to_numpy()]
                left = left[~hit]
        if len(left):
            new = words.take(pa.array(left))
            out[left] = self._encoded(new)
            if len(self.cache[0]) < REMEMBERED:
                keep = pc.less_equal(pc.binary_length(new), LONGEST)
                self.cache = pa.concat_arrays([self.cache[0], new.filter(keep)]), np.concatenate([self.cache[1], out[left][keep.to_numpy(zero_copy_only=False)]])
        return out

    def pretokens(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's pre-tokens begin, with the end, and all of them."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        return words.offsets.to_numpy().astype(np.int64), words.flatten()

    def apart(self, texts: pa.Array) -> pa.Array:
        """Which texts have runs of spaces, or spaces at an edge, and aren't cut at every space."""
        return pc.match_substring_regex(texts, f"  | \n|^ | $|{SPACE}") if len(texts) else pa.array([], pa.bool_())

    def count_all(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.splits:
            return np.array([len(x) for x in self.sp.encode(texts.to_pylist())], np.int64)
        apart = self.apart(texts)
        apart_at = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        own = [self._runs(t) for t in texts.take(pa.array(apart_at)).to_pylist()]
        if len(own):
            texts = pc.if_else(apart, pa.scalar("", pa.large_string()), texts)
        at, words = self.pretokens(texts)
        coded = words.dictionary_encode()
        upto = np.concatenate(([0], np.cumsum(self.of_words(coded.dictionary)[coded.indices.to_numpy()])))
        counts = upto[at[1:]] - upto[at[:-1]]
        counts[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
        counts[apart_at] = own
        return counts

    def _runs(self, text: str) -> int:
        """Texts with runs of spaces: the encoder puts one space before what it is given."""
        total, spaced, bare = 0, [], []
        for run in _RUNS.findall(" " + text):
            word = run.lstrip(f" {SPACE}")
            lead = len(run) - len(word)
            if run == "\n":
                total += 1
            elif not lead:  # what follows a newline at once
                bare.append("\n" + word)
            elif lead == 1:
                spaced.append(word)
            else:
                total += len(self.sp.encode(" " * (lead - 1) + word))
        return total - len(bare) + int(self._encoded(pa.array(spaced + bare, pa.large_string())).sum())


def frequent_lengths(docs: DataFrame, model: str, text_col: str = "text", sample: int = SAMPLE, entries: int = ENTRIES) -> pa.RecordBatch:
    """(word, length) of the most frequent pre-tokens in the first ``SAMPLE_CHARS`` characters of a sample of rows."""
    counter, seen = PieceCounter(model), Counter()
    rows = docs.select(F.substring(text_col, 1, SAMPLE_CHARS)).limit(sample).collect()  # at most ``sample`` short texts
    texts = pa.array([r[0] or "" for r in rows], pa.large_string())
    for at, length in chunks(texts, CHUNK_BYTES):
        part = texts.slice(at, length)
        values, counts = counter.pretokens(part.filter(pc.invert(counter.apart(part))))[1].value_counts().flatten()
        for w, n in zip(values.to_pylist(), counts.to_pylist()):
            seen[w] += n
    top = pa.array(sorted(w for w, n in seen.most_common(entries) if n > 1 and len(w.encode()) <= LONGEST), pa.large_string())
    return pa.RecordBatch.from_pydict({"word": top, "n": pa.array(counter.of_words(top), pa.int64())})


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, sample: int = SAMPLE) -> DataFrame:
    """A row per input row: id, n_bytes, n_tokens, over_limit."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text_col, sample))

    @F.arrow_udf("long")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(model, known.value)
        for x in texts:
            counts = [counter.count_all(x.slice(at, length)) for at, length in chunks(x, CHUNK_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), tokens(text_col).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
