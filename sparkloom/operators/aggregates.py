"""Aggregates over entities and relationships. All keep partial aggregation; ranked ones use top-k or windows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import is_stub
from .graph import cut


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def entities_per_file(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Every tracked file with its number of entities, 0 included."""
    n = count_by(entities, "file_path")
    return files.select("file_path").join(n, "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def dangling(rels: DataFrame) -> DataFrame:
    return rels.agg(F.sum(F.when(is_stub("target_id"), 1).otherwise(0)).alias("dangling"), F.count("*").alias("edges"))


def degrees(rels: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree); a self-loop counts in both."""
    ends = rels.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(rels.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_histogram(rels: DataFrame, percents=(50, 95, 99)) -> DataFrame:
    """Max, mean and rank percentiles of in-degree over all end points.

    Degrees are counted first; a percentile is then the least degree whose running count passes its rank, so one
    row a distinct degree is ordered, not one a node.
    """
    hist = degrees(rels).groupBy("in_degree").agg(F.count("*").alias("c"))
    w = Window.orderBy("in_degree").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy())})
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col("in_degree"))).alias(f"p{p}") for p in percents]
    return run.agg(F.max("in_degree").alias("max_degree"), F.bround(F.sum(F.col("in_degree") * F.col("c")) / F.sum("c"), 2).alias("mean_degree"), *picks)


def top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def top_per_group(df: DataFrame, group: list[str], by: str, tie: str, n: int) -> DataFrame:
    """n best rows of each group; Spark's window group limit cuts each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def coupling(rels: DataFrame, of: str = "source_id", to: str = "target_id") -> DataFrame:
    """(file, n): edges between two files, counted for both."""
    across = rels.where(F.col(of) != F.col(to))
    return across.select(F.explode(F.array(of, to)).alias("file")).groupBy("file").agg(F.count("*").alias("n"))


def connectivity(rels: DataFrame) -> DataFrame:
    """(source_id, relation_type, n, max_confidence, via): cells of a file's connections; via in line order, distinct."""
    cells = rels.groupBy("source_id", "relation_type").agg(F.count("*").alias("n"), F.max(F.coalesce("confidence", F.lit(1.0).cast("float"))).alias("c"), F.array_sort(F.collect_set("line")).alias("v"))
    return cells.select("source_id", "relation_type", "n", F.bround(F.col("c").cast("double"), 4).alias("max_confidence"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("via"))


def share(df: DataFrame, **flags) -> DataFrame:
    """Percentages of rows for which each flag holds, one decimal."""
    return df.agg(*[F.bround(100 * F.avg(F.coalesce(f, F.lit(False)).cast("double")), 1).alias(k) for k, f in flags.items()])


def size_buckets(sizes: DataFrame, col: str = "n") -> DataFrame:
    c = F.col(col)
    b = F.when(c == 1, "1").when(c <= 3, "2-3").when(c <= 10, "4-10").when(c <= 100, "11-100").otherwise(">100")
    return sizes.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def trend(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rising, falling, stable or zero by first and last value of each key's ordered series."""
    s = series.groupBy(key).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"), F.max(value).alias("m"), F.count("*").alias("c"))
    kind = F.when(F.col("m") == 0, "zero").when((F.col("c") >= 2) & (F.col("b") > 1.25 * F.col("a")), "rising").when((F.col("c") >= 2) & (F.col("b") < 0.75 * F.col("a")), "falling").otherwise("stable")
    return s.select(key, kind.alias("trend"))


def budget_prefix(df: DataFrame, cost: str, budget: int, order: list[str], group: list[str]) -> DataFrame:
    """Rows in order until the first that does not fit the budget, for each group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def strided(df: DataFrame, key: str, group: list[str], step: int, n: int) -> DataFrame:
    """Every step-th row of each group in key order, n at most."""
    w = Window.partitionBy(*group).orderBy(key)
    return df.withColumn("rn", F.row_number().over(w) - 1).where((F.col("rn") % step == 0) & (F.col("rn") < step * n)).drop("rn")


def running(df: DataFrame, cost: Column, order: list[str], name: str = "spent") -> DataFrame:
    """df with the sum of cost over all rows up to each in one global order.

    Two levels: range partitions are saved, their sums are added up (a row a partition), and rows are summed within
    their own partition. Equal orders fall in one partition, in no fixed sequence: order should be a key.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    d = cut(df.withColumn("_cost", cost).repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id()))
    before = d.groupBy("_part").agg(F.sum("_cost").alias("_sum"))
    before = before.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.sum("_cost").over(w)).drop("_part", "_base", "_cost")


def budget_cut(df: DataFrame, cost: str, budget: int, order: list[str]) -> DataFrame:
    """Rows in one global order until the first that does not fit the budget; costs are not negative."""
    return running(df, F.coalesce(F.col(cost), F.lit(0)), order).where(F.col("spent") <= budget).drop("spent")


def strided_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at most at even strides of the global key order: every max(1, rows // n)-th, from the first on."""
    step = df.agg(F.greatest(F.lit(1), F.expr(f"count(*) div {max(n, 1)}")).alias("_step"))
    d = running(df, F.lit(1), [key], "_rn").crossJoin(F.broadcast(step))  # one row
    return d.where("(_rn - 1) % _step = 0").where(F.expr(f"(_rn - 1) div _step < {n}")).drop("_rn", "_step")


def stub_states(stubs: DataFrame, meta: str = "metadata_json") -> DataFrame:
    """(state, n): stubs by the resolution state in their metadata; without one, or without readable metadata, `unknown`."""
    state = F.coalesce(F.get_json_object(meta, "$.stub_resolution_state"), F.lit("unknown"))
    return stubs.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def ambiguous(rels: DataFrame, meta: str = "metadata_json") -> DataFrame:
    """(ambiguous): edges whose metadata marks them ambiguous, in the loose sense of truth."""
    from .filters import truthy

    return rels.agg(F.count(F.when(truthy(meta, "ambiguous"), 1)).alias("ambiguous"))
