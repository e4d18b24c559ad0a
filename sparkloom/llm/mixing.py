"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is -ln(u) / quality with u from MD5 of its id and text (so documents without an id draw apart): sorted ascending within a source this is weighted
sampling without replacement, the same on every run. A source's target is met by complete epochs first; the rest
takes documents in key order while their prefix sum of words stays within it (the one that crosses goes to the
nearer side).

No source is gathered in one task: keys fall into BUCKETS equal steps of 1 - exp(-key); sums of each (source,
bucket) decide all buckets but the one that crosses the target, and only that bucket's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import SYMBOLS, _chars_in

BUCKETS = 4096
# Weights of the sources in code-point order, repeating; the mix over all sizes; the most epochs of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def quality(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: lower the more markup symbols a word there are."""
    return F.lit(1.0) / (F.lit(1.0) + _chars_in(F.coalesce(text, F.lit("")), SYMBOLS) / F.greatest(size, F.lit(1)))


def keyed(docs: DataFrame, size: Column, weight: Column, text: Column | None = None, seed: str = "mix") -> DataFrame:
    """docs with _size, _key and _bucket, added or replaced. Null ids and texts hash as the empty string; ties go by id and size."""
    body = F.md5(F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    made = docs.withColumn("_size", size).withColumn("_key", -F.log(u) / weight)
    return made.withColumn("_bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS)).cast("int"))


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the share of all words, split by weight.

    A target stops at `most` times its source; the excess goes to the others by weight until none is above. Solved
    in closed form: sources saturate in order of size over weight. One row per source is ranked here, not documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    t = sums.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "all_": F.lit(float(share)) * F.sum("source_size").over(every), "w_all": F.sum("w").over(every),
        "c_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(order), F.lit(0.0)),
    })
    t = t.withColumn("full", (F.col("all_") - F.col("c_before")) * F.col("w") >= F.col("cap") * (F.col("w_all") - F.col("w_before")))
    t = t.withColumns({"c_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), "w_full": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every)})
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise((F.col("all_") - F.col("c_full")) / (F.col("w_all") - F.col("w_full")) * F.col("w")).alias("target"))


def mix(made: DataFrame, **how) -> DataFrame:
    """Rows of keyed() with source_size, target and _times, how often the mix takes each; columns of these names are replaced.

    Sources without words get target 0 and take nothing. Null sources are one source. Repeated rows count one by
    one. Empty input gives no rows. `made` is read three times; pass a saved table where its columns are dear.
    """
    own = [c for c in made.columns if c not in ("source_size", "target", "_times")]
    made = made.select(F.struct(*[made[c] for c in own]).alias("_r"), *[made[c] for c in ("doc_id", "source", "_size", "_key", "_bucket")])
    sums = common.save(made.groupBy("source", "_bucket").agg(F.sum("_size").alias("n")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("n").cast("long").alias("source_size")), **how)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = common.save(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goal")
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    steps = sums.withColumn("upto", F.sum("n").over(run)).alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    cross = steps.where("upto - n < rest and upto > rest").select(F.col("s.source").alias("source"), F.col("_bucket").alias("cut"), (F.col("upto") - F.col("n")).alias("cut_from"))
    done = steps.where("upto <= rest").groupBy(F.col("s.source").alias("source")).agg(F.max("_bucket").alias("done"))
    plan = goal.alias("g").join(cross.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").join(done.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")), "left")
    plan = common.save(plan.select(F.col("g.source").alias("_src"), "source_size", "target", "epochs", "rest", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("cut_from", F.lit(0)).alias("cut_from"), F.coalesce("done", F.lit(-1)).alias("done")), "mix-plan")
    rows = made.join(plan, F.col("source").eqNullSafe(F.col("_src")))
    keep = ["_r", "source_size", "target"]
    sure = rows.where("_bucket <> cut").select(*keep, (F.col("epochs") + F.when(F.col("_bucket") <= F.col("done"), 1).otherwise(0)).alias("_times"))
    before = F.col("cut_from") + F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where("_bucket = cut").withColumn("_before", before)
    edge = edge.select(*keep, (F.col("epochs") + F.when(F.col("_before") + F.col("_size") / 2 <= F.col("rest"), 1).otherwise(0)).alias("_times"))
    return sure.unionByName(edge).select(*[F.col(f"_r.`{c}`").alias(c) for c in own], "source_size", "target", "_times")


def sample(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as its _times says, all columns as they were, extra ones of any name included.

    Null and blank texts have no words and are taken as often as their source's complete epochs say. Very long texts
    are taken whole. Ties go by id and size, repeated rows count one by one. Empty input gives no rows.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"))
    text = F.col("r.text")
    size = common.n_words(text)
    mixed = mix(keyed(packed, size, quality(text, size), text))
    return mixed.where("_times > 0").select(F.explode(F.array_repeat("r", F.col("_times"))).alias("r")).select("r.*")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "source").withColumn("n", common.n_words(F.col("text")))
    made = keyed(docs, F.col("n"), quality(F.col("text"), F.col("n"))).drop("text", "n")
    mixed = mix(common.save(made, "mix-keyed"))
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_times") * F.col("_size")).alias("taken"))


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as sym,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 1) / 4503599627370496.0::double as u
  from documents
), s as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source
), c as (select *, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as all_, sum(w) over () as w_all from s
), b as (
  select *, coalesce(sum(cap) over o, 0) as c_before, coalesce(sum(w) over o, 0) as w_before from c
  window o as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), f as (select *, (all_ - c_before) * w >= cap * (w_all - w_before) as full_ from b
), z as (select *, sum(case when full_ then cap else 0 end) over () as c_full, sum(case when full_ then w else 0 end) over () as w_full from f
), g as (select source, source_size, case when full_ then cap else (all_ - c_full) / (w_all - w_full) * w end as target from z
), e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from g
), r as (
  select d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
         coalesce(sum(size) over (partition by d.source order by -ln(u) / (1.0::double / (1.0::double + sym / greatest(size, 1))), doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from d join e on d.source is not distinct from e.source
)
select doc_id, size, source_size, target, (size * (epochs + case when before + size / 2.0::double <= rest then 1 else 0 end))::bigint as taken from r
"""
