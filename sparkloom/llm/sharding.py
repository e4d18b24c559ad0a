"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

common.ship(__name__)

ROWS_A_RUN, COPIES = 50_000, 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all at once: each key jumps ahead until it would pass `shards`."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key, spread first by XXH64 so that neighbouring ids do not share their high bits."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign(docs: DataFrame, shards: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) for every row.

    The id and the shard count alone decide the shard; a null id hashes as null and has a shard like any other. A
    null text has size 1 and the CRC of no bytes. slot is gapless from 0 in each shard, in hash order of the rows:
    a shard is cut into runs of about ROWS_A_RUN distinct rows, counted first and numbered apart, so no task holds
    a whole shard. Repeated rows are counted once and opened again at the end. Empty input gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = rows.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1), "spot": F.xxhash64("doc_id", "size", "text_crc32")})
    placed = common.save(placed, "shard-rows")
    runs = max(1, placed.count() // (shards * ROWS_A_RUN) + 1)
    run = F.pmod("spot", F.lit(runs)).cast("int")
    placed = placed.withColumn("run", run)
    heads = placed.groupBy("shard", "run").agg(F.sum("copies").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = common.save(heads.select("shard", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "shard-heads")
    inside = Window.partitionBy("shard", "run").orderBy("spot", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(heads, ["shard", "run"])
    # Two generators, so that the copies of one row never stand in one array.
    out = out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    start = F.col("base") + F.col("before")
    out = out.withColumn("slot", F.explode(F.sequence(start + F.col("from"), start + F.least(F.col("from") + COPIES, F.col("copies")) - 1)))
    return out.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "slot")


def write(docs: DataFrame, path: str, shards: int, id_: str = "doc_id", partitions: int | None = None) -> None:
    """docs as one folder per shard under path. A shard is written by several tasks, whatever its size."""
    placed = docs.withColumn("_shard", jump_shard(F.col(id_), shards))
    placed.repartition(partitions or max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_shard", F.xxhash64(id_)).write.partitionBy("_shard").parquet(path)


def op3(spark, sf_dir: str) -> DataFrame:
    out = assign(common.load(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
