"""Change streams: file events are dropped, classified and flushed in debounced bursts with bounded staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Silence that ends a burst, and the longest wait of a pending change.
DEBOUNCE, STALENESS = "2 seconds", "60 seconds"


def relevant(path: str = "path", size: str = "size", most: int = 500_000) -> Column:
    """Not hidden, not oversize."""
    return ~F.rlike(path, F.lit(r"(^|/)\.")) & (F.coalesce(size, F.lit(0)) <= most)


def flushes(events: DataFrame, key: str = "repo", ts: str = "ts", path: str = "path", late: str = "10 seconds", gap: str = DEBOUNCE, staleness: str = STALENESS) -> DataFrame:
    """(key, first_at, last_at, n, paths) of each burst; the same plan for batch and streaming frames.

    A burst ends with a silence of `gap`; a tumbling window of `staleness` bounds the wait in a stream without
    silence, so state for a key never holds more than one such window. The watermark drops later events' state.
    """
    e = events.withWatermark(ts, late).withColumn("_slot", F.window(ts, staleness).start)
    burst = e.groupBy(F.session_window(ts, gap).alias("w"), key, "_slot").agg(F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.array_sort(F.collect_set(path)).alias("paths"))
    return burst.select(key, "first_at", "last_at", "n", "paths")


# Files of a repository's own folder whose change ends an operation, folders of a running one, folders that never tell.
BOUNDARY = ("index", "HEAD", "MERGE_HEAD", "CHERRY_PICK_HEAD", "REVERT_HEAD", "AUTO_MERGE", "ORIG_HEAD", "COMMIT_EDITMSG", "MERGE_MSG")
RUNNING = ("rebase-merge", "rebase-apply", "sequencer")
SILENT = ("fsmonitor--daemon", "objects", "logs", "hooks", "info", "lfs", "worktrees", "modules")


def boundary(path: Column, event: Column, folder: Column, own: tuple[str, ...] = ()) -> Column:
    """boundary, lock, in_progress or ignore for an event on a path of the repository's own folder; `own` folders never tell either."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    first, name, one = F.get(p, F.lit(0)), F.element_at(p, -1), F.size(p) == 1
    silent = F.arrays_overlap(p, F.array(*[F.lit(x) for x in (*SILENT, *own)])) | F.contains(path, F.lit(".watchman-cookie-"))
    running = F.when((event == "deleted") & (folder | one), "boundary").otherwise("in_progress")
    return (
        F.when((F.size(p) < 1) | silent, "ignore").when(F.endswith(name, F.lit(".lock")), "lock").when(first.isin(*RUNNING), running)
        .when((first == "refs") & F.coalesce(F.get(p, F.lit(1)) == "remotes", F.lit(False)), "ignore").when(first == "refs", "boundary").when(one & first.isin(*BOUNDARY), "boundary").otherwise("ignore")
    )


def scan_mode(pending: Column, most: int = 10_000, least: int = 300) -> Column:
    """full_scan above the cap of pending files, flush from the threshold on, else wait."""
    return F.when(pending > most, "full_scan").when(pending >= least, "flush").otherwise("wait")


def banner(patching: Column, held: Column, file_pending: Column, pending: Column, failed: Column) -> Column:
    """What a reader is told about staleness, the most pressing first; null where all is current."""
    return F.when(patching, "patching").when(held, "held").when(file_pending, "file_pending").when(pending > 0, F.concat(pending.cast("string"), F.lit(" pending"))).when(failed, "failed")


def threshold(order: list[str], key: str, most: int) -> Column:
    """Number of the flush an event falls in when `most` pending events of a key flush at once."""
    return F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / most)


# Longest hold during an operation of the version control, time between looks at it (milliseconds).
HOLD_MS, LOOK_MS = 30_000, 500


def release_at(first: Column, ended: Column, most: int = HOLD_MS, every: int = LOOK_MS) -> Column:
    """Milliseconds at which a hold begun at `first` lets go: the first look after the operation ended, or the longest hold; null `ended`: never ended."""
    looks = F.when(ended.isNotNull(), F.ceil(F.greatest(ended - first, F.lit(0)) / every) * every)
    return first + F.least(looks, F.lit(most))


def pending(events: DataFrame, flushes_done: DataFrame, key: str = "path", at: str = "ts") -> DataFrame:
    """(key, at): the last event of each key that no successful flush (key, started) took after it; a failed flush takes nothing.

    A flush takes what arrived before it started, so events during a flush stay, and none is lost: at least once.
    """
    last = events.groupBy(key).agg(F.max(at).alias(at))
    taken = flushes_done.groupBy(key).agg(F.max("started").alias("started"))
    return last.join(taken, key, "left").where(F.col("started").isNull() | (F.col(at) >= F.col("started"))).select(key, at)


def catch_up(queue: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    """(key): what to process after events may have been lost: the queue, and all that a full scan (key, change) finds changed."""
    return queue.select(key).unionByName(scan.where("change <> 'unchanged'").select(key)).distinct()
