"""Exact deduplication with a Grace hash table.

Map side: every task groups the rows of a bounded window by complete content and keeps one
representative, so that a group holding a third of all rows shrinks to a few rows per task before
anything is shuffled. Reduce side: representatives are dealt by content digest; each task feeds an
open-addressing table that compares complete content, and when the contents outgrow the task's
memory it partitions them recursively into spill files by further digest bytes until each part fits.

Defined results: null text counts as empty, so all null and empty texts form one group; of equal
texts the row with the largest id stays, a null id ranks lowest, and of rows that tie (the same id
repeated) exactly one stays. An empty table gives an empty result. Other columns, whatever their
names, ride along unseen.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import as_bytes, materialize

#: Bytes of a map-side window, and of distinct contents in a reduce-side table before it spills.
WINDOW_BYTES = 32 << 20
TABLE_BYTES = 64 << 20
FANOUT = 16
#: What one member of a group takes in memory, about.
MEMBER_BYTES = 120
MAX_LEVEL = 20
NO_ID = -(1 << 63)


class ContentTable:
    """Open addressing with linear probing; a hit needs an equal digest prefix and equal complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.keys: list[int] = []
        self.contents: list[bytes] = []

    def add(self, digest: bytes, content: bytes) -> int:
        key = int.from_bytes(digest[:8], "little")
        slots, mask = self.slots, len(self.slots) - 1
        i = key & mask
        while (entry := slots[i]) >= 0:
            if self.keys[entry] == key and self.contents[entry] == content:
                return entry
            i = (i + 1) & mask
        slots[i] = entry = len(self.keys)
        self.keys.append(key)
        self.contents.append(content)
        if 2 * len(self.keys) > len(slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.keys):
            i = key & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = entry


def _windows(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _combine(text_at: int, id_at: int, schema: pa.Schema, window_bytes: int):
    """Map side: a row per input row with its local group; the group's representative carries the whole input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for window in _windows(batches, window_bytes):
            rows = window.column(0).combine_chunks()
            texts = as_bytes(rows.field(text_at))
            ids = rows.field(id_at).cast(pa.int64()).to_pylist()
            groups, digests = ContentTable(), []
            member = array("q")
            best: list[int] = []
            count: list[int] = []
            for at, text in enumerate(texts):
                content = text.lower()
                digest = hashlib.sha256(content).digest()
                entry = groups.add(digest, content)
                member.append(entry)
                if entry == len(best):
                    best.append(at)
                    count.append(0)
                    digests.append(digest)
                count[entry] += 1
                if _rank(ids[at]) > _rank(ids[best[entry]]):
                    best[entry] = at
            is_best = [best[e] == at for at, e in enumerate(member)]
            take = pa.array([at if b else None for at, b in enumerate(is_best)], pa.int64())
            out = pa.table(
                [
                    pa.array([first + e for e in member], pa.int64()),
                    pa.array(is_best),
                    pa.array([count[e] if b else None for b, e in zip(is_best, member)], pa.int64()),
                    pa.array([digests[e] if b else None for b, e in zip(is_best, member)], pa.binary()),
                    pa.array(ids, pa.int64()),
                    rows.take(take),
                ],
                schema=schema,
            )
            first += len(best)
            yield from out.to_batches(max_chunksize=2000)

    return run


def _rank(x: int | None) -> int:
    return NO_ID if x is None else x


def grace_groups(records: Iterable[tuple], budget: int, level: int, folder: str) -> Iterator[tuple[list[bytes], list[list[tuple]]]]:
    """records: (digest, content, members). Yields, a part at a time, the digests of its distinct contents and each one's members."""
    held, digests = ContentTable(), []
    members: list[list[tuple]] = []
    used, records = 0, iter(records)
    for digest, content, more in records:
        entry = held.add(digest, content)
        if entry == len(members):
            members.append([])
            digests.append(digest)
            used += len(content) + 200
        members[entry].extend(more)
        used += MEMBER_BYTES * len(more)
        if used > budget and level < MAX_LEVEL and len(members) > 1:
            break
    else:
        if digests:
            yield digests, members
        return
    spills = [tempfile.TemporaryFile(dir=folder) for _ in range(FANOUT)]
    for d, c, m in zip(digests, held.contents, members):
        pickle.dump((d, c, m), spills[d[8 + level] % FANOUT], pickle.HIGHEST_PROTOCOL)
    del held, members, digests
    for record in records:
        pickle.dump(record, spills[record[0][8 + level] % FANOUT], pickle.HIGHEST_PROTOCOL)
    for spill in spills:
        spill.seek(0)
        yield from grace_groups(_unspill(spill), budget, level + 1, folder)
        spill.close()


def _unspill(spill) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(spill)
        except EOFError:
            return


def _resolve(schema: pa.Schema, table_bytes: int):
    """Reduce side: for each local group its final group's kept local group, kept id and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                gids, ids, sizes, digests = (batch.column(i).to_pylist() for i in range(4))
                for gid, id_, n, digest, text in zip(gids, ids, sizes, digests, as_bytes(batch.column(4))):
                    yield digest, text.lower(), [(gid, id_, n)]

        with tempfile.TemporaryDirectory() as folder:
            for digests, groups in grace_groups(records(), table_bytes, 0, folder):
                out: list[tuple] = []
                for digest, members in zip(digests, groups):
                    keep = max(members, key=lambda m: (_rank(m[1]), -m[0]))
                    total = sum(m[2] for m in members)
                    out += [(m[0], keep[0], keep[1], total, digest) for m in members]
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[at : at + 10_000]), schema)], schema=schema)

    return run


RESOLVED = pa.schema([("gid", pa.int64()), ("keep_gid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha", pa.binary())])


def _groups(docs: DataFrame, id_col: str, text_col: str, window_bytes: int, table_bytes: int) -> tuple[DataFrame, DataFrame]:
    kind = T.StructType(
        [T.StructField("gid", T.LongType()), T.StructField("best", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("row", docs.schema)]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.struct("*").alias("row"))
    local = rows.mapInArrow(_combine(docs.columns.index(text_col), docs.columns.index(id_col), to_arrow_schema(kind), window_bytes), kind)
    local = materialize(local, "dedup-local")
    heads = local.filter("best").select("gid", "id", "n", "sha", F.col("row")[text_col].alias("text"))
    final = heads.repartition("sha").mapInArrow(_resolve(RESOLVED, table_bytes), "gid long, keep_gid long, keep_id long, group_size long, sha binary")
    return local, final


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = WINDOW_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256 of the text with A-Z lower-cased."""
    local, final = _groups(docs.select(id_col, text_col), id_col, text_col, window_bytes, table_bytes)
    return (
        local.select("gid", "best", "id")
        .join(final, "gid")
        .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("best") & (F.col("gid") == F.col("keep_gid"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = WINDOW_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    local, final = _groups(docs, id_col, text_col, window_bytes, table_bytes)
    kept = final.filter("gid = keep_gid").select("gid")
    return local.filter("best").join(kept, "gid", "left_semi").select("row.*")
