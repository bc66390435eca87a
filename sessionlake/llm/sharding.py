"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the rows by a seeded hash of the whole row into buckets of about ``bucket_bytes``, all columns and
``ROW_BYTES`` for each row counted.
Pass two puts each bucket's rows in a fixed order, shuffles them (``shuffle`` is a seeded Fisher-Yates) and
writes them: the place of a row is its bucket's offset plus its place in the bucket, and the row of places is
cut into shards. The law is ``rows``: shard sizes differ by one row at most, slots run from 0 without gaps.

A bucket fits a task's memory by construction, whatever source or text is frequent, because the hash covers
every column; only rows that agree in all columns share a bucket always. The written table is the result, so a
task that is run again cannot mix two shuffles.

Defined cases: null ids and texts are values like others; repeated rows all get slots of their own; an empty
table gives empty shards; further columns are written along, and names are lengthened where they clash.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import free_name
from sessionlake.plans.joins import broadcast_if_small
from sessionlake.plans.staging import shared_folder

BUCKET_BYTES = 8_000_000
ROW_BYTES = 64


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, str]:
    """Write ``docs`` below ``path``, one folder per shard, and return the names of the shard and slot columns."""
    taken = list(docs.columns)
    shard, slot = free_name(taken, "shard"), free_name(taken, "slot")
    whole = [F.col(f"`{name}`") for name in taken]
    held = lambda field: F.coalesce(F.octet_length(F.col(f"`{field.name}`") if isinstance(field.dataType, T.BinaryType) else F.col(f"`{field.name}`").cast("string")), F.lit(0))
    wide = [held(field) for field in docs.schema.fields if not isinstance(field.dataType, T.NumericType)]  # numbers are within ROW_BYTES
    size, rows = docs.agg(F.coalesce(F.sum(sum(wide, F.lit(ROW_BYTES).cast("long"))), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(size / bucket_bytes))
    row = F.struct(*whole)
    keyed = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), *whole), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(seed + 1), *whole).alias("order"),
        row.alias("row"),
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = keyed.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = (
        keyed.repartition(buckets, "bucket")
        .groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("order", "row"))).alias("rows"))
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
        .select("bucket", F.posexplode("rows").alias("at", "item"))
        .join(broadcast_if_small(offsets), "bucket")
        .select((F.col("offset") + F.col("at")).alias("place"), F.col("item.row").alias("row"))
    )
    cut = F.expr(f"CAST((place * {shards}) DIV {max(rows, 1)} AS INT)")
    start = F.expr(f"(shard * {rows} + {shards - 1}) DIV {shards}")
    numbered = placed.withColumn("shard", cut).select(
        F.col("shard").alias(shard), (F.col("place") - start).alias(slot), *[F.col("row").getField(name).alias(name) for name in taken])
    numbered.write.partitionBy(shard).parquet(path)
    return shard, slot


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Shuffle all documents into 16 shards, and describe the written rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shard, slot = write_shards(docs, path, shards=16)
    schema = T.StructType([*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    text = F.coalesce(F.col("text"), F.lit(""))
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).cast("int").alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
