"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass one scatters the records by seeded hashes into buckets that fit in a task's memory; pass two puts each bucket in
order, runs Spark's shuffle() over it (a Fisher-Yates pass with a seed) and lays the buckets of a shard end to end.
Whole records go through both passes; the query writes them to the shared folder by (shard, bucket) and takes its
digests from what was written.

The law is `key`: a record's shard is the one of n whose seeded hash of (id, shard) is highest, so id and shard count
decide alone, and one more shard takes records only into itself.

Defined cases: a null id is an id like any other; null text has size 8; rows that repeat an id share its shard but not
its bucket, unless they are equal throughout, and each gets a slot of its own; an empty table gives an empty result;
input columns named shard, bucket, grown_shard, slot or law are replaced.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import DOCUMENT_COLUMNS, shared_folder

OUTPUTS = ("shard", "bucket", "grown_shard", "slot", "law")


def highest_hash(key: Column, n_shards: int, seed: int) -> tuple[Column, Column]:
    """The shard among n_shards, and the shard if there were one more."""
    hashes = F.array(*[F.xxhash64(key, F.lit(s), F.lit(seed)) for s in range(n_shards)])
    shard = (F.array_position(hashes, F.array_max(hashes)) - 1).cast("int")
    grown = F.when(F.xxhash64(key, F.lit(n_shards), F.lit(seed)) > F.array_max(hashes), F.lit(n_shards)).otherwise(shard)
    return shard, grown.cast("int")


def two_pass_shuffle(records: DataFrame, id_col: str, size_col: str, n_shards: int = 24, bucket_bytes: int = 32 << 20, seed: int = 29) -> DataFrame:
    """records -> records + shard, bucket, grown_shard, slot (from 0 in each shard), law.

    bucket_bytes bounds what one bucket holds on average. The order inside a bucket depends on the records and the
    seed only: buckets are sorted before they are shuffled, and the number of partitions that deals them out follows from
    the number of buckets, not from the session.
    """
    records = records.drop(*OUTPUTS)
    total = records.agg(F.sum(F.col(size_col))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / n_shards / bucket_bytes))
    shard, grown = highest_hash(F.col(id_col), n_shards, seed)
    bucket = F.pmod(F.xxhash64(*records.columns, F.lit(seed + 1)), F.lit(n_buckets)).cast("int")
    placed = records.select(F.struct(F.xxhash64(*records.columns, F.lit(seed + 2)).alias("mark"), F.struct(*records.columns).alias("record"), grown.alias("grown")).alias("one"), shard.alias("shard"), bucket.alias("bucket"))

    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("of_shard"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    if n_shards * n_buckets <= 10_000:  # a row of 24 bytes each
        starts = F.broadcast(starts)

    partitions = min(n_shards * n_buckets, 100_000)
    buckets = (
        placed.repartition(partitions, "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.array_sort(F.collect_list("one")).alias("all"))
        .sortWithinPartitions("shard", "bucket")
        .withColumn("all", F.shuffle("all", F.lit(seed)))
    )
    dealt = buckets.select("shard", "bucket", F.posexplode("all").alias("place", "one")).join(starts, (F.col("shard") == F.col("of_shard")) & (F.col("bucket") == F.col("of_bucket")))
    return dealt.select("one.record.*", "shard", "bucket", F.col("one.grown").alias("grown_shard"), (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit("key").alias("law"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, in it one a bucket, whose records are in the order of their slots. A bucket is in one task
    already, so nothing is shuffled again."""
    sharded.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard", "bucket").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).cast("long")
    sharded = two_pass_shuffle(docs.select(*DOCUMENT_COLUMNS, size.alias("size")), "doc_id", "size").drop("size")
    path = f"{shared_folder(spark)}/fieldsense/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path)
    written = spark.read.schema(sharded.schema).parquet(path)
    crc32 = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return written.select("doc_id", size.alias("size"), crc32.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
