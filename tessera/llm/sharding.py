"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a
seeded hash; pass two Fisher-Yates shuffles each bucket in memory.  Buckets in
order are a uniform random permutation of the table, and the shards are its
equal cuts: counts differ by at most one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import packed, row_hash, unpacked

#: Text bytes of a bucket (the records one task holds at a time).
BUCKET_BYTES = 32 << 20
MIN_BUCKETS = 1024


def _shuffled(seed: int):
    def shuffle(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row_key", "ascending")])  # fetch order varies; equal keys are equal rows
        bucket = group.column("bucket")[0].as_py()
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(group.num_rows)  # Fisher-Yates
        group = group.take(pa.array(order))
        return group.append_column("place", pa.array(np.arange(group.num_rows, dtype=np.int64))).drop_columns(["row_key"])
    return shuffle


def _placed(seed: int):
    shuffle = _shuffled(seed)

    def place(group: pa.Table, start: pa.Table) -> pa.Table:
        group = shuffle(group)
        return group.select(["row"]).append_column("at", pc.add(group.column("place"), start.column("before")[0]))
    return place


def external_shuffle(docs: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
                     text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot`` (the row's place in
    its shard, gapless from 0).

    Deterministic in the rows and the seed.  Rows that are equal in every
    column share a bucket, which is the one case where a bucket can outgrow
    ``bucket_bytes``.  Null columns are values like any other; an empty table
    gives no rows; a column of ``docs`` named shard or slot is replaced."""
    totals = docs.agg(F.sum(F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0))), F.count("*")).first()
    n = totals[1]
    buckets = max(MIN_BUCKETS, -(-int(totals[0] or 0) // bucket_bytes))
    key = row_hash(docs, seed)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", before.alias("before"))  # one row per bucket
    rows = docs.select(packed(docs), key.alias("row_key"), bucket.alias("bucket"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("at", T.LongType())])
    # a bucket meets its start where it is shuffled: a join after that could move every record once more
    dealt = rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(_placed(seed), schema)
    # shard s holds positions [ceil(s * n / shards), ceil((s + 1) * n / shards))
    shard = F.expr(f"cast((at * {shards}) div {max(n, 1)} as int)")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    placed = dealt.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    return unpacked(placed, docs.schema, shard=F.col("shard"), slot=F.col("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a shard's files hold consecutive slots in order."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
