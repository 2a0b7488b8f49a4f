"""Packing with a controlled mixture: deficit round-robin over source queues.

Documents become token ids once. Each source is a queue; a source earns credit in proportion to its
target share and takes a turn of ``TURN`` tokens when its credit covers one, what it lacks or keeps is
carried on. Turn k of a source with weight w therefore falls due at time (k + 1) / w, and ties go by the
order of the queues. How many turns of every other queue fall due earlier is a whole-number division, so
each turn's place in the round-robin of the whole corpus, deficits carried across windows and tasks,
follows from k and the small table of queues alone: nothing is sorted, and no task serves the queues in
sequence. Four turns fill a window of 1024, so every sequence but the last is full. By default shares
are the corpus's own, so all queues end together; with other shares a queue that ends early leaves its
turns to the rest.

A queue holds its documents in the order in which tasks read them: a task sums its tokens by source as
it makes them, so that the start of each task's stretch of a queue is a prefix sum over tasks, and the
ids themselves are written once and never shuffled. The ``QUEUES`` largest sources are queues of their
own; any others share one more queue, so the table of queues has a bounded size.

Defined results: null text is empty, so its document is the end id alone; null and empty sources are
one queue; null and repeated ids are documents of their own; a source without tokens doesn't occur (every
document has its end id); very long texts are cut like others; an empty table gives no rows. Only the
id, text and source columns are read; others may have any names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import chunks, materialize

WINDOW, TURN = 1024, 256
END_ID = 0
#: Sources that are queues of their own.
QUEUES = 4096
#: Shares are rounded to this many steps, so that due times of up to 2**39 turns are compared in whole 64-bit numbers.
WEIGHT_STEPS = 1 << 24
#: Bytes of text that are tokenised together.
CHUNK_BYTES = 8 << 20
#: The split pattern of the byte-level pre-tokeniser, and two white-space characters in a row.
GPT2_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


class ByteTokenizer:
    """Ids of a byte-level BPE as little-endian bytes, two to an id.

    Texts whose white space is single are cut at spaces and newlines, where the pre-tokeniser cuts too;
    the distinct words of many texts are then encoded in one call and laid out again. Texts with runs of
    white space are encoded whole, and those that hold an added token's string go to the tokenizer
    itself, which gives that token's id. So do all texts if the file's normaliser or pre-tokeniser is
    another than the plain byte-level one.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of over 65,536 ids doesn't fit two bytes an id")
        splits = model.get("pre_tokenizer") or {}
        self.plain = model.get("normalizer") is None and splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
        if not self.plain:
            return
        ranks = _byte_ranks(model["model"]["vocab"], set(self.added))
        self.fast = tiktoken.Encoding("bytes", pat_str=GPT2_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def _encode(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return self._encode(text)

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.LargeBinaryArray:
        """The ids of every text (null: empty), each followed by ``end``."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.plain or not len(texts):
            return pa.array([self.encode(t) + end for t in texts.to_pylist()], pa.large_binary())
        apart = pc.match_substring_regex(texts, TWO_SPACES)
        for a in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, a))
        apart_at = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        own = [self.encode(t) for t in texts.take(pa.array(apart_at)).to_pylist()]
        if len(own):
            texts = pc.if_else(apart, pa.scalar("", pa.large_string()), texts)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten()
        heads = [self._encode(w) for w in flat.take(pa.array(at[:-1])).to_pylist()]  # nothing comes before a text's first word
        for i, ids in zip(apart_at.tolist(), own):
            heads[i] = ids
        coded = flat.dictionary_encode()
        known = self._words(coded.dictionary)
        table = pa.concat_arrays([known, pa.array([*heads, end], pa.large_binary())])
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[at[:-1]] = len(known) + np.arange(len(texts))
        codes = np.insert(codes, at[1:], len(table) - 1)
        laid = table.take(pa.array(codes))
        _, offsets, data = laid.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(codes) + 1)[at + np.arange(len(at))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.tobytes()), data])

    def _words(self, words: pa.Array) -> pa.LargeBinaryArray:
        """The ids of distinct words, each after a space unless it begins with a newline."""
        spaced = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string())))
        _, offsets, data = spaced.buffers()
        ends = np.frombuffer(offsets, np.int64, len(spaced) + 1)
        ids = np.array(self.fast.encode_ordinary(data.to_pybytes()[ends[0] : ends[-1]].decode()), "<u2")
        upto = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        bounds = np.searchsorted(upto, ends - ends[0])
        if (upto[bounds] != ends - ends[0]).any():
            raise ValueError("a token spans two words")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer((2 * bounds).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])


def _byte_ranks(vocab: dict[str, int], added: set[str]) -> dict[bytes, int]:
    """The vocabulary with its printable stand-ins for bytes turned back: printable Latin-1 stands for itself, the other bytes for 256 onwards."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}


TOKENS = "doc_id long, source string, task int, before long, n long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document with the end id added; ``before`` counts the tokens of its source that its task made earlier."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("task", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = ByteTokenizer(tokenizer), TaskContext.get().partitionId()
        sums: dict[str, int] = {}
        for batch in batches:
            for at, length in chunks(batch.column(2), CHUNK_BYTES):
                ids = coder.encode_all(batch.column(2).slice(at, length), end)
                n = pc.binary_length(ids).to_numpy().astype(np.int64) // 2
                sources = batch.column(1).slice(at, length)
                before = []
                for source, size in zip(sources.to_pylist(), n.tolist()):
                    so_far = sums.get(source, 0)
                    before.append(so_far)
                    sums[source] = so_far + size
                columns = [batch.column(0).slice(at, length).cast(pa.int64()), sources, pa.array(np.full(length, task, np.int32)), pa.array(before, pa.int64()), pa.array(n), ids]
                for i in range(0, length, 1000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 1000).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")
    return docs.select(F.col(id_col), source, F.col(text_col)).mapInArrow(run, TOKENS)


class Mixture:
    """The round-robin of all queues: weights, whole turns, and where the queues' last, short turns lie."""

    def __init__(self, totals: list[int], weights: list[float]):
        self.full = np.array(totals, np.int64) // TURN
        rest = np.array(totals, np.int64) % TURN
        top = max(weights, default=0.0) or 1.0
        self.weight = np.array([max(1, round(w / top * WEIGHT_STEPS)) for w in weights], np.int64)
        self.tail = self.full.sum() * TURN + np.cumsum(rest) - rest

    def place(self, queue: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The place in the round-robin of each queue's turn (one before the queue's last, short one)."""
        place = np.zeros(len(turn), np.int64)
        due, own = turn + 1, self.weight[queue]
        for other in range(len(self.full)):
            ahead = due * self.weight[other]  # turns of the other queue due earlier; at the same time if it comes first
            ahead = np.where(other < queue, ahead // own, (ahead - 1) // own)
            place += np.where(other == queue, turn, np.minimum(self.full[other], ahead))
        return place


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut(mixture):
    """Cuts each document where its queue's turns end (in a queue's last, short turn where a window ends) and places the pieces."""
    schema = pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix: Mixture = mixture.value
        full, tail = mix.full.tolist(), mix.tail.tolist()
        for batch in batches:
            rows, starts, lengths, sums, turns, insides = [], [], [], [], [], []
            queues = batch.column(5).to_pylist()
            for row, (n, ids, begin, queue) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), queues)):
                wide = memoryview(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")).cast("B")
                at = 0
                while at < n:
                    turn, inside = divmod(begin + at, TURN)
                    length = min(n - at, TURN - inside)
                    if turn >= full[queue]:
                        length = min(length, WINDOW - (tail[queue] + inside) % WINDOW)
                    rows.append(row)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(wide[4 * at : 4 * (at + length)]))
                    turns.append(turn)
                    insides.append(inside)
                    at += length
            which, turn, inside = (np.array(x, np.int64) for x in (rows, turns, insides))
            queue = np.array(queues, np.int64)[which]
            short = turn >= mix.full[queue]
            position = np.where(short, mix.tail[queue], 0) + inside
            position[~short] += TURN * mix.place(queue[~short], turn[~short])
            doc_id, source, n = (batch.column(i).take(pa.array(which)) for i in range(3))
            columns = [doc_id, starts, lengths, sums, n, position // WINDOW, position % WINDOW, source]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)
            for i in range(0, len(out), 20_000):
                yield out.slice(i, 20_000)

    return run


def pack(docs: DataFrame, tokenizer: str, shares: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", queues: int = QUEUES) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    shares: target proportions by source; a source without one gets its own share of the corpus.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, id_col, text_col, source_col), "tokens")
    stretches = materialize(tokens.groupBy("source", "task").agg(F.sum("n").alias("n")), "stretches")
    sources = stretches.groupBy("source").agg(F.sum("n").alias("n"))
    largest = sorted((r.source, r.n) for r in sources.orderBy(F.desc("n"), "source").limit(queues).collect())
    total = stretches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    others = total - sum(n for _, n in largest)
    sizes = [n for _, n in largest] + [others] * (others > 0)
    wanted = [(shares or {}).get(source, n / total) for source, n in largest] + [others / max(total, 1)] * (others > 0)
    mixture = spark.sparkContext.broadcast(Mixture(sizes, wanted))

    numbered = spark.createDataFrame([(source, i) for i, (source, _) in enumerate(largest)], "source string, queue int")
    queued = stretches.join(F.broadcast(numbered), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(largest))))
    earlier = Window.partitionBy("queue").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1)
    begins = materialize(queued.select("source", "task", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")), "begins")  # so that Spark knows its size
    placed = tokens.join(begins, ["source", "task"]).select("doc_id", "source", "n", "ids", (F.col("begin") + F.col("before")).alias("begin"), "queue")
    return placed.mapInArrow(_cut(mixture), PIECES)
