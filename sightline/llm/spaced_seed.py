"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; words under its zeros are ignored, so one changed word
still leaves seeds that match. Hashes of the benchmark's masked windows are broadcast in blocks of a
bounded size and looked up for every word position of every document; each hit names a diagonal (an
item laid over the document), and around the hit the words of that diagonal are compared in full. The
best stretch, where a match earns 1 and a substitution costs 2, is a leak if it holds at least
``MIN_WORDS`` equal words (for shorter items ``SHORT_PART`` of the item) at ``IDENTITY`` or better.

Words are runs of letters, marks, digits and underscores in lower case, so case, punctuation and white
space don't hide a leak. An item shorter than the widest mask is looked up by its runs of ``SHORTEST`` words;
one that has fewer words than that can't be told from chance inside a text and matches a document that
consists of it alone. Words and seeds are hashed by 64 bits; whole batches of documents are hashed at once.

Defined results: null text counts as empty and leaks nothing, nor does an item without words match. Of
stretches with equally many equal words on different diagonals, that of the first diagonal counts (where
the item would begin earliest in the document), on one diagonal the one that ends first. Repeated documents or
items each give their own rows; null ids are kept. Texts of any length are compared whole: a document full
of one repeated word holds no more than a flag for each diagonal of an item. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import chunks
from sightline.llm.shingles import mixed, values_of, word_hashes

#: The masks. Each keeps 7 words; spans are 9, 11, 12 and 12.
MASKS = ("110110111", "11010011011", "110010101011", "101100100111")
MIN_WORDS, IDENTITY, SHORT_PART, SHORTEST = 13, 0.8, 0.8, 5
#: Bytes of benchmark text in a broadcast block, and of document text hashed together.
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
CELL_BITS = 22
#: Hits of a document that are expanded to pairs of positions at once.
TOGETHER = 1 << 18
#: Odd multipliers, one for each place in a mask.
_PLACES = np.random.default_rng(7_07).integers(0, 1 << 62, max(map(len, MASKS)), np.uint64) * np.uint64(2) + np.uint64(1)
#: What separates words in lower-cased text: ASCII other than letters, digits and the underscore, and all else that is no letter, mark or digit.
_VALUES = values_of({b for b in range(128) if not (chr(b).isalnum() or chr(b) == "_")})
_ODD = r"[^\x00-\x7f\pL\pM\pN]"


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and where each text's words begin, with the end."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    odd = pc.match_substring_regex(low, _ODD)
    if pc.any(odd).as_py():
        low = pc.if_else(odd, pc.replace_substring_regex(low, _ODD, " "), low)
    return word_hashes(low, _VALUES)


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(h) - len(mask) + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for at, kept in enumerate(mask):
            if kept == "1":
                total += h[at : at + n] * _PLACES[at]
    return mixed(total)


class SeedIndex:
    """Masked hashes of a block of items: for each mask sorted keys, with item and position."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        h, at = hashes_of(pa.array(texts, pa.string()))
        self.items = [h[lo:hi] for lo, hi in zip(at[:-1], at[1:])]
        self.whole: dict[bytes, list[int]] = {}
        for i, item in enumerate(self.items):
            if 0 < len(item) < SHORTEST:
                self.whole.setdefault(item.tobytes(), []).append(i)
        widest = max(map(len, MASKS))
        self.tables = []
        for mask in (*MASKS, "1" * SHORTEST):
            short = mask == "1" * SHORTEST
            use = [i for i, item in enumerate(self.items) if SHORTEST <= len(item) and (not short or len(item) < widest + 3)]
            seeds = [_masked(self.items[i], mask) for i in use]
            keys = np.concatenate([np.zeros(0, np.uint64), *seeds])
            item = np.repeat(np.array(use, np.int64), [len(k) for k in seeds])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k in seeds)])
            order = np.argsort(keys, kind="stable")
            cells = np.zeros(1 << CELL_BITS, bool)
            cells[keys >> np.uint64(64 - CELL_BITS)] = True
            if len(keys):
                self.tables.append((mask, keys[order], item[order], place[order], np.packbits(cells)))
        self._cells: list[np.ndarray] | None = None

    def leaks(self, texts: pa.Array) -> Iterator[tuple]:
        """(row, item id, document word, item word, words spanned, words equal): for each text the best stretch of each item that leaks."""
        h, at = hashes_of(texts)
        for row, words in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if self.whole and 0 < words[1] - words[0] < SHORTEST:
                for item in self.whole.get(h[words[0] : words[1]].tobytes(), ()):
                    yield row, self.ids[item], 0, 0, words[1] - words[0], words[1] - words[0]
        for row, begins in self._diagonals(h, at):
            own = h[at[row] : at[row + 1]]
            for item, begin in begins.items():
                if best := self._best(own, item, begin):
                    yield row, self.ids[item], *best

    def _best(self, h: np.ndarray, item: int, begins: np.ndarray) -> tuple | None:
        """The best stretch over an item's diagonals, in order; none beats one that holds the whole item."""
        own, best = self.items[item], None
        size, need = len(own), min(MIN_WORDS, ceil(SHORT_PART * len(own)))
        step = max(1, TOGETHER // size)
        for k in range(0, len(begins), step):
            some = begins[k : k + step]
            lo, hi = int(some[0]), int(some[-1]) + size
            outside = own.max() + np.uint64(1) if own.max() < np.uint64(2**64 - 1) else own.min() - np.uint64(1)  # equals no word of the item
            laid = np.full(hi - lo, outside, np.uint64)
            laid[max(0, -lo) : min(hi, len(h)) - lo] = h[max(0, lo) : min(hi, len(h))]
            start, end, equal = _stretches(np.lib.stride_tricks.sliding_window_view(laid, size)[some - lo] == own)
            equal[equal < np.maximum(need, IDENTITY * (end - start))] = 0
            at = int(equal.argmax())
            if equal[at] > (best[3] if best else 0):
                best = (int(some[at] + start[at]), int(start[at]), int(end[at] - start[at]), int(equal[at]))
            if best and best[3] == size:
                break
        return best

    def _diagonals(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
        """(row, item -> document positions, ascending, where the item would begin) that some mask hits."""
        if self._cells is None:
            self._cells = [np.unpackbits(t[4]).view(bool) for t in self.tables]
        hits = []
        for number, ((mask, keys, *_), cells) in enumerate(zip(self.tables, self._cells)):
            seeds = _masked(h, mask)
            pos = np.flatnonzero(cells[seeds >> np.uint64(64 - CELL_BITS)])
            row = np.searchsorted(at, pos, "right") - 1
            inside = pos + len(mask) <= at[row + 1]
            pos, row = pos[inside], row[inside]
            lo, hi = np.searchsorted(keys, seeds[pos], "left"), np.searchsorted(keys, seeds[pos], "right")
            found = hi > lo
            hits.append(np.stack([row, pos - at[row], lo, hi, np.full(len(pos), number)], 1)[found])
        hits = np.concatenate([np.zeros((0, 5), np.int64), *hits])
        hits = hits[np.argsort(hits[:, 0], kind="stable")]
        for own in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1):
            if len(own):
                few = (own[:, 3] - own[:, 2]).sum() <= TOGETHER
                yield int(own[0, 0]), self._paired(own) if few else self._flagged(own, int(at[own[0, 0] + 1] - at[own[0, 0]]))

    def _paired(self, hits: np.ndarray) -> dict[int, np.ndarray]:
        items, begins = [], []
        for number in np.unique(hits[:, 4]).tolist():
            _, pos, lo, hi, _ = hits[hits[:, 4] == number].T
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            _, _, item, place, _ = self.tables[number]
            items.append(item[which])
            begins.append(np.repeat(pos, n) - place[which])
        both = np.unique(np.stack((np.concatenate(items), np.concatenate(begins)), 1), axis=0)
        cuts = np.flatnonzero(np.diff(both[:, 0])) + 1
        return {int(x[0, 0]): x[:, 1] for x in np.split(both, cuts)}

    def _flagged(self, hits: np.ndarray, length: int) -> dict[int, np.ndarray]:
        """As ``_paired``, for hits of few keys at very many positions: a flag for each diagonal of an item."""
        flags: dict[int, np.ndarray] = {}
        hits = hits[np.lexsort((hits[:, 2], hits[:, 4]))]
        same_key = np.flatnonzero((np.diff(hits[:, 4]) != 0) | (np.diff(hits[:, 2]) != 0)) + 1
        for of_key in np.split(hits, same_key):
            _, _, item, place, _ = self.tables[of_key[0, 4]]
            for k in range(int(of_key[0, 2]), int(of_key[0, 3])):
                i = int(item[k])
                if i not in flags:
                    flags[i] = np.zeros(length + len(self.items[i]), bool)
                flags[i][of_key[:, 1] - place[k] + len(self.items[i])] = True
        return {i: np.flatnonzero(flags[i]) - len(self.items[i]) for i in sorted(flags)}


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row (start, end, matches) of the stretch with the largest score of +1 for a match and -2 for a substitution."""
    n, size = equal.shape
    total, matches = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
    np.cumsum(np.where(equal, 1, -2), axis=1, out=total[:, 1:])
    np.cumsum(equal, axis=1, out=matches[:, 1:])
    lowest = np.minimum.accumulate(total, axis=1)
    end = (total - lowest).argmax(axis=1)
    row = np.arange(n)
    start = (total == lowest[row, end][:, None]).argmax(axis=1)
    return start, end, matches[row, end] - matches[row, start]


def _blocks(benchmark: DataFrame, text_col: str, block_bytes: int) -> Iterator[SeedIndex]:
    """The benchmark's distinct texts, named by their hashes, in blocks of about ``block_bytes`` (a longer text is a block of
    its own), each small enough for the driver and a broadcast."""
    texts = benchmark.select(F.col(text_col).alias("text")).filter("text <> ''").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ceil(size / block_bytes)
    for i in range(n):
        part = texts if n == 1 else texts.filter(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(n)) == i)
        rows = part.select(F.xxhash64("text").alias("key"), "text").collect()
        if rows:
            yield SeedIndex([r.key for r in rows], [r.text for r in rows])


LEAKS = "doc_id long, key long, doc_word long, item_word long, span_words long, equal_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document and item that it leaks: doc_id, item_id, where (in words), words spanned and equal."""
    spark = docs.sparkSession
    schema = pa.schema([(c.split()[0], pa.int64()) for c in LEAKS.split(", ")])
    found = spark.createDataFrame([], LEAKS)
    for block in _blocks(benchmark, text_col, block_bytes):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, length in chunks(batch.column(1), CHUNK_BYTES):
                    out = list(index.value.leaks(batch.column(1).slice(at, length)))
                    if out:
                        row, *leak = zip(*out)
                        ids = batch.column(0).slice(at, length).take(pa.array(row)).cast(pa.int64())
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in leak)], schema=schema)

        found = found.union(docs.select(id_col, text_col).mapInArrow(run, LEAKS))
    items = benchmark.select(F.xxhash64(F.col(text_col)).alias("key"), F.col(item_col).cast("long").alias("item_id"))
    return found.join(items, "key").select("doc_id", "item_id", "doc_word", "item_word", "span_words", "equal_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that leak nothing, with the columns of ``docs``."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, text_col, block_bytes):
        docs = docs.filter(_is_clean(spark.sparkContext.broadcast(block))(F.col(text_col)))
    return docs


def _is_clean(index):
    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            keep = np.ones(len(x), bool)
            for at, length in chunks(x, CHUNK_BYTES):
                leaky = {row for row, *_ in index.value.leaks(x.slice(at, length))}
                keep[[at + row for row in leaky]] = False
            yield pa.array(keep)

    return clean
