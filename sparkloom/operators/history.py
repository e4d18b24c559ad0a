"""Versioned tables: change scan, node diff in rounds, changelog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_scan(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "hash") -> DataFrame:
    """(key, change): added, deleted, modified or unchanged, by one full outer join. A hash missing on one side only is a change."""
    a, b = old.select(key, F.col(digest).alias("h_old"), F.lit(1).alias("in_old")), new.select(key, F.col(digest).alias("h_new"), F.lit(1).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("h_old").eqNullSafe(F.col("h_new")), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def reuse(files: DataFrame, kept: DataFrame, build, now=None, ttl_days: int | None = None) -> DataFrame:
    """Rows of build over files (path, hash, variant), taken from kept (the same, built_at, and build's columns) where a file is as it was.

    Content hash and variant must agree; rows older than ttl_days at `now` do not count. build takes the other files
    alone and returns path, hash, variant and its columns. A file that gave no rows before is built again.
    """
    key = ["path", "hash", "variant"]
    if ttl_days is not None:
        kept = kept.where(F.col("built_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {ttl_days} days"))
    known = kept.join(files.select(key).distinct(), key, "left_semi")
    fresh = build(files.join(kept.select(key).distinct(), key, "left_anti"))
    return known.drop("built_at").withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def _kth(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, id, old_id, change) of the differing nodes of two versions with (file_id, id, name, start_line, hash).

    Rounds, each on what the one before left over: same id; same hash (renamed); same name (modified); rest. Equal
    keys pair first with first by id.
    """
    o = old.select(F.col("file_id").alias("old_file"), F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("hash").alias("old_hash"), F.col("start_line").alias("old_line"))
    n = new.select("file_id", "id", "name", "hash", "start_line")
    both = o.join(n, F.expr("old_file = file_id and old_id = id"), "full_outer").withColumn("f", F.coalesce("old_file", "file_id"))
    out = both.where("old_id is not null and id is not null and (old_hash <> hash or old_line <> start_line)").select(F.col("f").alias("file_id"), "id", "old_id", F.lit("modified").alias("change"))
    gone = both.where("id is null").select("f", "old_id", "old_name", "old_hash")
    come = both.where("old_id is null").select("f", "id", "name", "hash")
    for left, right, change in (("old_hash", "hash", "renamed"), ("old_name", "name", "modified")):
        a = _kth(gone, ["f", left], "old_id").select("f", F.col(left).alias("same"), "k", "old_id")
        b = _kth(come, ["f", right], "id").select("f", F.col(right).alias("same"), "k", "id")
        met = a.join(b, ["f", "same", "k"]).select("f", "id", "old_id")
        out = out.unionByName(met.select(F.col("f").alias("file_id"), "id", "old_id", F.lit(change).alias("change")))
        gone = gone.join(met.select("f", "old_id"), ["f", "old_id"], "left_anti")
        come = come.join(met.select("f", "id"), ["f", "id"], "left_anti")
    none = F.lit(None).cast("string")
    return out.unionByName(come.select(F.col("f").alias("file_id"), "id", none.alias("old_id"), F.lit("added").alias("change"))).unionByName(gone.select(F.col("f").alias("file_id"), none.alias("id"), "old_id", F.lit("removed").alias("change")))


def latest_runs(changelog: DataFrame, keep: int) -> DataFrame:
    """Changes of the newest `keep` runs of each file."""
    w = Window.partitionBy("file_id").orderBy(F.desc("run_uuid"))
    runs = changelog.select("file_id", "run_uuid").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")
    return changelog.join(runs, ["file_id", "run_uuid"], "left_semi")


def bursts(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Debounced flushes: sessions of each key, closed by a silence of `gap`. Works on batch and streaming frames."""
    s = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "n")
