"""Jaccard self-join on 5-word shingles: rare-first prefix filtering, verified once per pair.

Copies with one shingle set collapse to one node first. A fixed-size count sketch over the shingles
of all documents orders every set from rare to common; a wrong count only costs time, since any total
order keeps the prefix filter exact. Each node sends its prefix n-grams; nodes that meet in an n-gram
are paired. So that a crowd of near copies doesn't make all its pairs, pairing takes two rounds: the
first proposes neighbours by size, keeps each node's five that share most n-grams, verifies them and finds components (then lets what is left try a few members of the larger components);
the second pairs, under the length and positional filters, only nodes that are still in different
components. Verification counts the overlap of complete sets, after a suffix filter that bounds it
from the parts of both sets. No link between components is lost, so components are exact.

Sets are compared by 64-bit hashes: n different sets or shingles collide with odds of about n*n/2**65.

Defined results: null text counts as empty; a document without words has an empty set, links with
nothing and is its own component; a null id takes part in links but never names a component with
ids (one of null ids alone has a null id); repeated rows each get a row. An empty table gives no rows.
Only the id and text columns are read; others may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import chunks, materialize
from sightline.llm.components import component_labels, joined_labels
from sightline.llm.shingles import shingle_sets

#: Percent of the union that two sets must share.
PERCENT = 75
#: The sketch has 2**22 counters, summed in 64 slices; the node filter 2**24 bits.
SKETCH_BITS, SLICES, FILTER_BITS = 22, 64, 24
#: Nodes that a task remembers having sent.
SEEN = 1_000_000
#: Set members to a part of the suffix filter, about; parts that the rows of shared n-grams carry.
PER_PART, FEW = 1, 256
#: Partners that a node keeps in the first round. The second round looks at all others that could link.
FIRST_PARTNERS = 5
#: Members of a larger component that a node outside is compared with before it is compared with all that could link.
TRIES = 8
#: Members of a component that are partners to try, about; rows of an n-gram that a group takes of each kind; pairs that a task looks at together.
SAMPLE, BLOCK, TOGETHER = 64, 2_000, 500_000
#: What a row does in a group: it is outside the n-gram's largest component, it asks, it is asked.
MINOR, ASKS, STAYS = 1, 2, 4
#: Rows of an n-gram above which they carry parts of their sets: its pairs could be so many that they have to be bounded where they are made.
CROWD = 16
#: Bits of a prefix row's key that hold the position (a later one counts as the last of them); the others are the n-gram's leading ones.
PLACE_BITS = 20
#: Parts of sets that are compared at once.
PART_CELLS = 1 << 20
#: Bytes of text that are shingled together.
CHUNK_BYTES = 4 << 20


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), 7) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


PROFILE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("parts", pa.binary()), ("few", pa.binary()), ("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _parts(s: np.ndarray) -> bytes:
    """Members of a set by equal parts of the hash range, a power of two of them, a byte each; empty if one overflows."""
    bits = max(3, (len(s) // PER_PART).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _folded(parts: bytes) -> bytes:
    """At most ``FEW`` parts, for rows that carry them by the n-gram; empty if one overflows."""
    x = np.frombuffer(parts, np.uint8)
    if len(x) <= FEW:
        return parts
    x = x.reshape(FEW, -1).sum(1, dtype=np.int64)
    return x.astype(np.uint8).tobytes() if x.max() < 256 else b""


class _PartSums:
    """The parts of many sets, to bound the overlap of pairs of them."""

    def __init__(self, n: np.ndarray, parts: pa.Array):
        self.n, self.size = n, pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at, self.rows = np.zeros(len(n), np.int64), {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            of = np.flatnonzero(self.size == size)
            self.at[of] = np.arange(len(of))
            self.rows[size] = np.frombuffer(b"".join(parts.take(pa.array(of)).to_pylist()), np.uint8).reshape(len(of), size)

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of sets i with sets j."""
        out = np.minimum(self.n[i], self.n[j]).astype(np.int64)
        pair = self.size[i] << 32 | self.size[j]
        for both in np.unique(pair).tolist():
            x, y = both >> 32, both & 0xFFFFFFFF
            if x and y:
                every, k = np.flatnonzero(pair == both), min(x, y)
                for of in np.array_split(every, len(every) * max(x, y) // PART_CELLS + 1):
                    left, right = (self.rows[size][self.at[side[of]]].reshape(len(of), k, -1).sum(2, dtype=np.uint16) for size, side in ((x, i), (y, j)))
                    out[of] = np.minimum(left, right).sum(1, dtype=np.int64)
        return out


def _overlap_bound(n1: int, x: bytes, n2: int, y: bytes) -> int:
    """No two sets with these parts share more."""
    if not x or not y:
        return min(n1, n2)
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(size, -1).sum(1), b.reshape(size, -1).sum(1)).sum())


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, ...) in batches of about ``CHUNK_BYTES`` of text, null texts made empty."""
    for batch in batches:
        batch = batch.set_column(1, batch.schema.names[1], pc.fill_null(batch.column(1), ""))
        for at, length in chunks(batch.column(1), CHUNK_BYTES):
            yield batch.slice(at, length)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; at the end the task's sketch counters, a row per slice."""
    seen: set[int] = set()
    counters, held, n_held = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
    shift = np.uint64(64 - SKETCH_BITS)
    for batch in _in_chunks(batches):
        sizes, nodes, parts, few = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            node = _node(s) if len(s) else None
            sizes.append(len(s))
            nodes.append(node)
            parts.append(_parts(s) if len(s) else None)
            few.append(_folded(parts[-1]) if len(s) else None)
            if node is not None and node not in seen:
                if len(seen) < SEEN:
                    seen.add(node)
                held.append(s)
                n_held += len(s)
            if n_held > 1_000_000:
                counters += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=len(counters)).astype(np.uint32)
                held, n_held = [], 0
        nothing = [None] * len(sizes)
        yield _batch(PROFILE, batch.column(0).cast(pa.int64()), batch.column(2), sizes, nodes, parts, few, nothing, nothing, nothing)
    if held:
        counters += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=len(counters)).astype(np.uint32)
    part = TaskContext.get().partitionId()
    used = [(i, s) for i, s in enumerate(np.split(counters, SLICES)) if s.any()]
    if used:
        nothing = [None] * len(used)
        yield _batch(PROFILE, nothing, nothing, nothing, nothing, nothing, nothing, [i for i, _ in used], [part] * len(used), [zlib.compress(s.tobytes(), 1) for _, s in used])


SLICE = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of the slices that this task was dealt; holds one array a slice, however many rows come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            x = np.frombuffer(zlib.decompress(data), np.uint32)
            sums[i] = sums[i] + x if i in sums else x
    for i, x in sums.items():
        yield _batch(SLICE, [i], [i], [zlib.compress(x.tobytes(), 1)])


def _summed(slices: DataFrame, bits: int) -> np.ndarray:
    """The whole sketch on the driver: 2**bits counters, whatever the input's size."""
    schema = "slice int, part int, counts binary"
    partly = slices.repartition("slice", F.pmod("part", F.lit(32))).mapInArrow(_sum_slices, schema)
    whole = np.zeros((SLICES, (1 << bits) // SLICES), np.uint32)
    for row in partly.repartition("slice").mapInArrow(_sum_slices, schema).collect():
        whole[row.slice] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return whole.reshape(-1)


def _prefixes(ranks, percent: int):
    """For every distinct node its prefix, rare first: n-gram and position in one key, size, node.

    N-grams that agree in the bits that the key keeps only meet more nodes, and a position that is cut only passes more of them.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("node", pa.int64())])
    last = np.uint64((1 << PLACE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shift = ranks.value, np.uint64(64 - SKETCH_BITS)
        seen: set[int] = set()
        for batch in _in_chunks(batches):
            keys, sizes, nodes = [], [], []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                if not n or (node := _node(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                length = n - (percent * n + 99) // 100 + 1
                order = np.lexsort((s, rank[(s >> shift).astype(np.int64)]))[:length]
                keys.append(_signed(s[order] & ~last | np.minimum(np.arange(length, dtype=np.uint64), last)))
                sizes.append(np.full(length, n, np.int32))
                nodes.append(np.full(length, node, np.int64))
            if keys:
                yield _batch(schema, *map(np.concatenate, (keys, sizes, nodes)))

    return run


MET = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _could_link(n1, p1, n2, p2, percent: int):
    """Length and positional filters for pairs that share an n-gram at these positions, if it is their first."""
    short, long = np.minimum(n1, n2), np.maximum(n1, n2)
    most = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * short.astype(np.int64) >= percent * long) & ((100 + percent) * most.astype(np.int64) >= percent * (n1.astype(np.int64) + n2))


def _meet(percent: int):
    """From rows (key, n, node) in order of n-gram, size, node, position: rows (n-gram, node, n, pos) of n-grams that two nodes share, and
    proposed pairs (x, y, -times, null) of each node with the one before it and with its n-gram's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32)]
        first = None  # the first row of the n-gram that carry belongs to
        shared = False  # carry's row has been found to share its n-gram
        for batch in batches:
            key, size, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = [np.concatenate(x) for x in zip(carry, (key >> PLACE_BITS, size, name, (key & ((1 << PLACE_BITS) - 1)).astype(np.int32)))]
            keep = np.ones(len(rows[0]), bool)
            keep[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
            h, n, node, pos = (r[keep] for r in rows)
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            at = np.arange(len(h))
            starts = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), at, 0))
            a, b = at[:-1][same], at[1:][same]
            ok = _could_link(n[a], pos[a] * 0, n[b], pos[b] * 0, percent)
            lead = starts[b]
            out = [(node[a[ok]], node[b[ok]])]
            if first is not None and len(carry[0]):
                inside = starts[b] == 0
                if inside.any():
                    far = b[inside]
                    fit = 100 * np.minimum(first[0], n[far]).astype(np.int64) >= percent * np.maximum(first[0], n[far])
                    out.append((np.full(int(fit.sum()), first[1]), node[far[fit]]))
                lead, b2 = lead[~inside], b[~inside]
            else:
                b2 = b
            fit = (100 * np.minimum(n[lead], n[b2]).astype(np.int64) >= percent * np.maximum(n[lead], n[b2])) & (lead != b2 - 1)
            out.append((node[lead[fit]], node[b2[fit]]))
            x, y = (np.concatenate([o[i] for o in out]) for i in (0, 1))
            unequal = x != y
            x, y = np.minimum(x, y)[unequal], np.maximum(x, y)[unequal]
            if len(x):
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
                yield _batch(MET, x[at], y[at], -np.diff(np.append(at, len(x))).astype(np.int32), [None] * len(at))
            with_next = np.concatenate((same, [False]))
            with_last = np.concatenate(([False], same))
            if shared and len(carry[0]):
                with_last[0] = True
            emit = (with_next | with_last)[:-1]
            if emit.any():
                yield _batch(MET, h[:-1][emit], node[:-1][emit], n[:-1][emit], pos[:-1][emit])
            if starts[-1] != 0 or first is None or not len(carry[0]):
                first = (n[starts[-1]], node[starts[-1]])
            shared = bool(with_last[-1])
            carry = [h[-1:], n[-1:], node[-1:], pos[-1:]]
        if shared:
            yield _batch(MET, carry[0], carry[2], carry[1], carry[3])

    return run


def _expanded(at: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (at[k], first[k] + 0 .. count[k] - 1), about ``TOGETHER`` of them at a time."""
    upto = np.cumsum(count)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TOGETHER, "right")))
        n = count[lo:hi]
        yield np.repeat(at[lo:hi], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[lo:hi], n)
        lo = hi


def _group_numbers(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _likely(percent: int, tries: int):
    """Pairs (a, b, times) of a node outside an n-gram's largest component with ``tries`` of its members, those of least
    node number: the same few in all n-grams, so that how often a pair comes tells how alike the two are."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())])

    def pairs(group, n, node, pos, root, role, few):
        minor = role & MINOR > 0
        order = np.lexsort((node, minor, group))
        group, n, node, minor = (x[order] for x in (group, n, node, minor))
        start = np.searchsorted(group, group)  # where a row's group starts: with its largest component
        majors = np.bincount(group, ~minor).astype(np.int64)[group]
        i = np.flatnonzero(minor)
        found = []
        for i, j in _expanded(i, start[i], np.minimum(tries, majors[i])):
            ok = _could_link(n[i], n[i] * 0, n[j], n[j] * 0, percent)
            found.append((node[i[ok]], node[j[ok]]))
        x, y = (np.concatenate([f[k] for f in found] or [node[:0]]) for k in (0, 1))
        at = _firsts(x, y)
        return x[at], y[at], np.diff(np.append(np.flatnonzero(_is_first(x, y)), len(x)))

    return _by_gram(schema, pairs)


def _is_first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return new


def _firsts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where each distinct pair is found, in order of the pairs."""
    return np.lexsort((y, x))[_is_first(x, y)]


def _across(percent: int):
    """Pairs (a, b) of nodes in different components that pass the length, positional and part filters, all of them.

    Members of an n-gram's largest component aren't paired with each other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(group, n, node, pos, root, role, few):
        order = np.lexsort((n, group))
        group, n, node, pos, root, role = (x[order] for x in (group, n, node, pos, root, role))
        minor, asks, stays = (role & bit > 0 for bit in (MINOR, ASKS, STAYS))
        sums, key, i = _PartSums(n, few.take(pa.array(order))), group << 32 | n, np.flatnonzero(asks)
        least, most = -(-percent * n[i].astype(np.int64) // 100), np.minimum(100 * n[i].astype(np.int64) // percent, (1 << 32) - 1)
        first = np.searchsorted(key, group[i] << 32 | least, "left")
        count = np.searchsorted(key, group[i] << 32 | most, "right") - first
        found = [(node[:0], node[:0])]
        for i, j in _expanded(i, first, count):
            ok = stays[j] & (root[i] != root[j]) & (node[i] != node[j]) & (~minor[j] | (node[j] > node[i]))  # two minor ones once, where the greater stays
            i, j = i[ok], j[ok]
            ok = _could_link(n[i], pos[i], n[j], pos[j], percent)
            i, j = i[ok], j[ok]
            at = _firsts(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))
            i, j = i[at], j[at]
            ok = (100 + percent) * sums.bounds(i, j) >= percent * (n[i].astype(np.int64) + n[j])
            i, j = i[ok], j[ok]
            found.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
        x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        at = _firsts(x, y)
        return x[at], y[at]

    return _by_gram(schema, pairs)


def _by_gram(schema: pa.Schema, pairs):
    """From rows (h, block, n, node, pos, root, role, few) in order of h and block: what ``pairs`` finds in whole groups of (h, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            h, block, *rows = (table.column(i).to_numpy() for i in range(7))
            out = _batch(schema, *pairs(_group_numbers(h, block), *rows, table.column(7).combine_chunks()))
            for at in range(0, len(out), 50_000):
                yield out.slice(at, 50_000)

        def key(row: pa.RecordBatch, at: int) -> tuple:
            return row.column(0)[at].as_py(), row.column(1)[at].as_py()

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if key(held[0], 0) != (last := key(batch, len(batch) - 1)):
                table = pa.Table.from_batches(held).combine_chunks()
                h, block = table.column(0).to_numpy(), table.column(1).to_numpy()
                other = np.flatnonzero((h[::-1] != last[0]) | (block[::-1] != last[1]))
                cut = len(h) - int(other[0])
                yield from found(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which cells of the text filter this task's text hashes fall in, as slices to be summed."""
    cells = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        cells[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    part = TaskContext.get().partitionId()
    for i, s in enumerate(np.split(cells, SLICES)):
        if s.any():
            yield _batch(SLICE, [i], [part], [zlib.compress(s.astype(np.uint32).tobytes(), 1)])


def _sets(wanted):
    """The complete sets of the texts that the filter lets through, as bytes."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cells = np.unpackbits(wanted.value).view(bool)

        def through():
            for batch in batches:
                hashes = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                yield batch.filter(pa.array(cells[hashes >> np.uint64(64 - FILTER_BITS)]))

        for batch in _in_chunks(through()):
            nodes, data = [], []
            for s in shingle_sets(batch.column(1)):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                nodes.append(node)
                data.append(s.tobytes())
                if len(nodes) >= 500:
                    yield _batch(schema, nodes, data)
                    nodes, data = [], []
            if nodes:
                yield _batch(schema, nodes, data)

    return run


def _need(n1: int, n2: int, percent: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (n1 + n2) // (100 + percent))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= _need(len(a), len(b), percent)


def _could_overlap(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, x, n2, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = pa.array([_overlap_bound(*z) >= _need(z[0], z[2], percent) for z in zip(n1, x, n2, y)], pa.bool_())
            yield _batch(schema, batch.column(0).filter(keep), batch.column(1).filter(keep))

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array(ok, pa.bool_())
            yield _batch(schema, batch.column(0).filter(keep), batch.column(1).filter(keep))

    return run


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose complete sets meet the threshold."""
    spark = docs.sparkSession
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("parts").alias("x"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("parts").alias("y"))
    bounded = pairs.join(a, "a").join(b, "b").select("a", "b", "n1", "x", "n2", "y").mapInArrow(_could_overlap(percent), "a long, b long")
    pairs = materialize(bounded, "candidates")
    ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    hashes = nodes.join(ends, "node", "left_semi").select("text_hash")
    cells = _summed(hashes.mapInArrow(_flags, "slice int, part int, counts binary"), FILTER_BITS)
    wanted = spark.sparkContext.broadcast(np.packbits(cells > 0))
    sets = docs.mapInArrow(_sets(wanted), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(_verify(percent), "a long, b long")


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of n-grams that nodes of several components share, with their components, the n-gram's count of rows (c) and its largest component."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = rows.join(roots.join(sizes, "root"), "node", "left").select("h", "n", "node", "pos", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    placed = materialize(placed, "placed")
    grams = placed.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", "size").alias("largest"))
    return materialize(placed.join(grams.filter("low <> high").select("h", "c", "largest"), "h"), "mixed")


def _numbers(n) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def _dealt(n, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), n)


def _in_blocks(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``_mixed`` dealt by n-gram and in its order.

    All rows of an n-gram are cut into blocks of about ``BLOCK`` rows to stay in, and those outside its largest component (minor), which
    ask, into blocks of as many; each block of the one kind meets each of the other, so that no task holds more than two
    blocks, whatever the components are, and no two rows meet twice. Rows of n-grams of more than ``CROWD`` rows carry parts of their sets.
    """
    minor = F.col("root") != F.col("largest")
    large = materialize(mixed.filter((F.col("c") > BLOCK) & minor).groupBy("h").agg(F.count(F.lit(1)).alias("m")), "large")  # few, so a table of its own whose size Spark knows
    wide = mixed.join(large, "h", "left").withColumns({"wide": F.ceil(F.col("c") / BLOCK), "high": F.ceil(F.coalesce("m", F.lit(1)) / BLOCK)})
    whole, own, bits = F.col("wide") == 1, lambda block, role: F.struct(block.alias("block"), role.alias("role")), F.when(minor, MINOR).otherwise(0)
    # in one block a row may ask and stay at once
    stays = F.transform(_numbers(F.col("high")), lambda k: own(k * F.col("wide") + _dealt(F.col("wide"), 2), bits + F.when(whole & minor, ASKS + STAYS).otherwise(STAYS)))
    asks = F.when(minor & ~whole, F.transform(_numbers(F.col("wide")), lambda k: own(_dealt(F.col("high"), 3) * F.col("wide") + k, bits + ASKS)))
    dealt = wide.select("c", "h", F.explode(F.concat(stays, F.coalesce(asks, F.slice(stays, 1, 0)))).alias("at"), "n", "node", "pos", "root")
    columns = ("h", "at.block", "n", "node", "pos", "root", "at.role")
    crowds = dealt.filter(F.col("c") > CROWD).join(nodes.select("node", "few"), "node").select(*columns, "few")
    dealt = dealt.filter(F.col("c") <= CROWD).select(*columns, F.lit(b"").alias("few")).union(crowds)
    return dealt.repartition("h", "block").sortWithinPartitions("h", "block")


def _sampled(mixed: DataFrame, sample: int) -> DataFrame:
    """Rows of ``_mixed`` dealt by n-gram and in its order: about ``sample`` members of its largest component, the same in all n-grams,
    stand for it, in each block of about ``BLOCK`` rows of the others."""
    minor, blocks = F.col("root") != F.col("largest"), F.ceil(F.col("c") / BLOCK)
    few = mixed.filter(minor | (F.pmod(F.xxhash64("node"), F.col("size")) < sample))
    block = F.explode(F.when(minor, F.array(_dealt(blocks, 1))).otherwise(_numbers(blocks)))
    few = few.select("h", block.alias("block"), "n", "node", "pos", "root", F.when(minor, MINOR).otherwise(0).alias("role"), F.lit(b"").alias("few"))
    return few.repartition("h", "block").sortWithinPartitions("h", "block")


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: id, text, text_hash. (profile: doc_id, text_hash, n, node; nodes: node, first_id, root)."""
    spark = docs.sparkSession
    profile = materialize(docs.mapInArrow(_profile, "doc_id long, text_hash long, n long, node long, parts binary, few binary, slice int, part int, counts binary"), "profile")
    counts = _summed(profile.filter("slice is not null").select("slice", "part", "counts"), SKETCH_BITS)
    ranks = spark.sparkContext.broadcast(np.minimum(255, 8 * np.log2(1.0 + counts)).astype(np.uint8))
    profile = profile.filter("slice is null")
    nodes = profile.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.min("text_hash").alias("text_hash"), F.first("parts").alias("parts"), F.first("few").alias("few"))
    nodes = materialize(nodes, "nodes")
    prefixes, gram = docs.mapInArrow(_prefixes(ranks, percent), "key long, n int, node long"), F.shiftright("key", PLACE_BITS)
    met = prefixes.repartition(gram).sortWithinPartitions(gram, "n", "node", "key").mapInArrow(_meet(percent), "x long, y long, n int, pos int")
    met = materialize(met, "met")
    proposed = met.filter("n < 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum(-F.col("n")).alias("times"))
    closest = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    near = materialize(proposed.withColumn("place", F.row_number().over(closest)).filter(F.col("place") <= FIRST_PARTNERS).select("a", "b", "place"), "near")
    links = materialize(_links(docs, near.select("a", "b"), nodes, percent).join(near, ["a", "b"]), "links")
    roots = component_labels(links.filter("place = 1").select("a", "b"))  # a forest; the other links then join its few trees
    roots = joined_labels(roots, links.filter("place > 1").select("a", "b"))
    rows = met.filter("n > 0").select(F.col("x").alias("h"), F.col("y").alias("node"), "n", "pos")

    mixed = _mixed(rows, roots)
    tried = _sampled(mixed, SAMPLE).mapInArrow(_likely(percent, TRIES), "a long, b long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"))
    tried = tried.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))).filter(F.col("place") <= TRIES)
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = materialize(tried.join(near, ["a", "b"], "left_anti"), "tried")
    roots = joined_labels(roots, _links(docs, tried, nodes, percent))
    mixed = _mixed(mixed.select("h", "n", "node", "pos"), roots)  # components only grow, so no other n-gram is mixed now
    across = _in_blocks(mixed, nodes).mapInArrow(_across(percent), "a long, b long").distinct()
    across = materialize(across.join(near.select("a", "b").union(tried), ["a", "b"], "left_anti"), "across")
    labels = joined_labels(roots, _links(docs, across, nodes, percent))
    return profile.select("doc_id", "text_hash", "n", "node"), nodes.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))


def similar_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_shingles, component_id."""
    profile, nodes = _grouped(docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")), percent)
    named = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = nodes.join(named, "root").select("node", "component_id")
    return profile.join(members, "node", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``: of each component the row of least id, then least text hash, once.

    Rows without words all stay. A null id ranks after every id.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    id_ = F.coalesce(F.col(id_col).cast("long"), text_hash.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    profile, nodes = _grouped(docs.select(id_.alias("id"), F.col(text_col).alias("text"), text_hash.alias("text_hash")), percent)
    rows = profile.filter("node is not null").select("node", F.struct("doc_id", "text_hash").alias("key"))
    kept = rows.groupBy("node").agg(F.min("key").alias("key")).join(nodes, "node").groupBy("root").agg(F.min("key").alias("key"))
    dropped = rows.select("key").distinct().join(kept.select("key"), "key", "left_anti").select("key.*")
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = F.when(has_words, F.lit(-1)).otherwise(F.monotonically_increasing_id())  # rows without words aren't repeats of each other
    keyed = docs.select(F.struct("*").alias("row"), id_.alias("doc_id"), text_hash.alias("text_hash"), own.alias("own"))
    left = keyed.join(dropped, ["doc_id", "text_hash"], "left_anti")
    return left.dropDuplicates(["doc_id", "text_hash", "own"]).select("row.*")
