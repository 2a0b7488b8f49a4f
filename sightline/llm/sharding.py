"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters whole records by a seeded hash, written once to the shared folder, so that whatever is
run again reads the same records with the same hashes. Pass two deals them out in buckets sized to fit a
task's memory, gathers each bucket, puts it in canonical order, applies Spark's ``shuffle`` (a seeded
Fisher-Yates) and lays the buckets end to end. The shards are equal cuts of that order, so row counts
differ by one at most, whatever the sizes, sources or copies are. The number of tasks grows with the
bytes, and the hash takes the number of the task that read a record, so that a record repeated in every
part of the table is spread over the buckets too; one bucket gets more than its share only of what one
task read.

Defined results: null text has no bytes; null and repeated ids are records like any other; a text larger
than a bucket makes its bucket that much larger; an empty table gives no rows; other columns ride along, whatever
their names. ``shuffle`` draws from the seed and the task, so the order is fixed by seed, data and
partitioning; every run is a valid permutation, and what is dealt again after it is written first.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize

#: Bytes of a bucket, and of the buckets that one task is dealt, about.
BUCKET_BYTES, TASK_BYTES = 4 << 20, 64 << 20
SEED = 2026


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: row (the whole record), size, shard, slot."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    of = lambda k: F.xxhash64(F.lit(seed + k), F.spark_partition_id(), F.col(id_col), F.col(text_col))
    scattered = materialize(docs.select(of(0).alias("hash"), of(1).alias("key"), size.alias("size"), F.struct("*").alias("row")), "scattered")
    total = scattered.select(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets, tasks = (max(1, ceil((total.b or 0) / b)) for b in (bucket_bytes, task_bytes))
    scattered = scattered.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("start"))
    gathered = scattered.repartition(tasks, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "size", "row"))).alias("records"))
    placed = gathered.join(starts, "bucket").select("start", F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    short, longer = total.n // n_shards, total.n % n_shards
    cut = longer * (short + 1)
    position = F.col("start") + F.col("at")
    shard = F.when(F.col("p") < cut, F.floor(F.col("p") / (short + 1))).otherwise(longer + F.floor((F.col("p") - cut) / max(short, 1)))
    start = F.when(F.col("shard") <= longer, F.col("shard") * (short + 1)).otherwise(cut + (F.col("shard") - longer) * short)
    return (
        placed.select(position.alias("p"), F.col("record.row").alias("row"), F.col("record.size").alias("size"))
        .withColumn("shard", shard.cast("int"))
        .select("row", "size", "shard", (F.col("p") - start).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **options) -> None:
    """One folder a shard, the records in slot order inside each file."""
    placed = materialize(shuffle_into_shards(docs, n_shards, **options), "placed").select("shard", "slot", "row.*")
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
