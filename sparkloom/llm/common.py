"""Shared pieces of the training-data operators: words, scratch tables, let-bindings, components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, the word pattern made from it, and the edges up to which
# components() works in one task.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_EDGES = 10_000

_scopes: list[dict[str, DataFrame]] = []


def ship(module: str) -> None:
    """Let Python functions of a module travel by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one is set only in local mode where none is configured (tests)."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loom-"))
        have = sc.getCheckpointDir()
    return have


def save(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Files survive lost executors and carry real statistics."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1][path] = out
    return out


def drop(*saved: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in saved:
        if path := getattr(df, "_scratch_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope():
    """Deletes on leaving what was saved inside, except the tables given to the function that it yields."""
    held, kept = {}, set()
    _scopes.append(held)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].update({path: df for path, df in held.items() if path in kept})
        drop(*[df for path, df in held.items() if path not in kept])


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that shuffles. Spark guesses sizes from compressed files, before rows are multiplied, and would
    collect tables that grow with the corpus on the driver to broadcast them; tables of a checked count are exempt."""
    return df.hint("merge")


def let(value: Column, body) -> Column:
    """Bind value once for use inside lambdas; a plain reference would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges saved, with their number and a sum of hashes, both taken by the job that writes them."""
    seen = Observation()
    out = save(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])


def _together(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), all in one task, by union-find; the smaller root stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.setdefault(x, x)) != x:
                top[x] = x = top.setdefault(up, up)
            return x

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
                a, b = find(u), find(v)
                top[max(a, b)] = min(a, b)
        yield pd.DataFrame([(x, find(x)) for x in list(top)], columns=["node", "root"], dtype="int64")

    return edges.coalesce(1).mapInPandas(run, "node long, root long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node reached.

    Alternating large-star and small-star steps: each is a partial aggregate and one equi-join that AQE can
    split, so a star with any number of leaves stays distributed. Edges never multiply beyond twice the input.
    Up to BROADCAST_EDGES edges, counted, are joined in one task instead, without the rounds' exchanges.
    Empty edges give no rows; self-loops and repeated edges are dropped.
    """
    e, now = _counted(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct())
    if now[0] <= BROADCAST_EDGES:
        return _together(e)
    for _ in range(rounds):
        if now[0] == 0:
            break
        kept = []

        def side(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if now[0] <= BROADCAST_EDGES else spread(held(df))

        def held(df: DataFrame) -> DataFrame:
            """df, written where it is large: AQE splits a hub's partition only between plain exchanges."""
            if now[0] > BROADCAST_EDGES:
                kept.append(df := save(df, "cc-side"))
            return df

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = held(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = side(big.groupBy("u").agg(F.min("v").alias("m")))
        star = big.join(low, "u").select("v", "m", "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new, then = _counted(small.distinct())
        drop(e, *kept)
        e, now, mark = new, then, now
        if now == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
