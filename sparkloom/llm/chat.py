"""Chat formatting with cumulative-snapshot collapse.

A conversation logged after every turn leaves one copy per turn. Every turn gets a rolling hash of its prefix (two
XORs of hashes tagged with the turn's place); a conversation whose whole hash is a proper prefix of another, or the
whole of one with a smaller id, is dropped by anti-join; the rest are rendered.

Turns are laid out in range partitions of (conversation, turn, role, start of the text); places and prefixes are built
inside the part of a conversation that lies in one partition and then over those parts, so a conversation with a third
of all rows, numbered or not, is not gathered in one task. It is rendered in parts of BLOCK turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, START = 512, 64


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, ord, role, text, a, b): each distinct turn with its place and the hashes of the prefix it ends.

    Order is by turn (nulls last), role and text. Rows repeated in full are one turn. Null ids are one conversation.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.substring("text", 1, START))
    rows = common.save(laid.withColumn("block", F.spark_partition_id()), "chat-rows")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & F.col("l.block").eqNullSafe(F.col("r.block"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    # A conversation within one partition needs no second level.
    several = common.save(heads.where("base > 0"), "chat-heads")
    placed = rows.withColumn("ord", F.row_number().over(inside) - 1).alias("l").join(several.alias("r"), same, "left")
    placed = placed.select("l.conv_id", "l.block", "role", "text", (F.coalesce("base", F.lit(0)) + F.col("ord")).alias("ord"))
    hashed = placed.withColumns({k: F.xxhash64(F.lit(s), "ord", F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))) for k, s in (("a", 1), ("b", 2))})
    hashed = common.save(hashed, "chat-hashed")
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.min("ord").alias("o"))
    by_place = Window.partitionBy("conv_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("conv_id", "block", "o", *[F.coalesce(F.bit_xor(k).over(by_place), F.lit(0).cast("long")).alias(f"{k}0") for k in "ab"]).where("o > 0")
    ahead = common.save(ahead, "chat-ahead")
    run = Window.partitionBy("conv_id", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = hashed.withColumns({k: F.bit_xor(k).over(run) for k in "ab"}).alias("l").join(ahead.alias("r"), same, "left")
    zero = F.lit(0).cast("long")
    return out.select("l.conv_id", "ord", "role", "text", *[F.col(k).bitwiseXOR(F.coalesce(f"{k}0", zero)).alias(k) for k in "ab"])


def maximal(made: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another and first among equals.

    Of equal conversations the smallest id stays, a null id only where all are null. Empty input gives no rows.
    """
    ends = made.groupBy("conv_id").agg(F.max("ord").alias("ord"))
    last = made.alias("m").join(ends.alias("e"), F.col("m.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("m.ord") == F.col("e.ord")))
    whole = common.save(last.select(F.col("m.conv_id").alias("conv_id"), F.col("m.ord").alias("ord"), "a", "b"), "chat-whole")
    one = whole.groupBy("ord", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = made.alias("m").join(ends.alias("e"), F.col("m.conv_id").eqNullSafe(F.col("e.conv_id"))).where("m.ord < e.ord").select("m.ord", "m.a", "m.b").distinct()
    return one.join(inner, ["ord", "a", "b"], "left_anti").select("conv_id", (F.col("ord") + 1).alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text) of the maximal conversations.

    A turn is <|im_start|>role, a line break, the text, <|im_end|> and a line break; null roles and texts are
    empty. A conversation up to BLOCK turns has the single part 0; a longer one has a row for every BLOCK turns, whose
    texts joined in order of part are the whole. Rows repeated in full are one turn; other columns are not read. Very
    long turns are rendered whole. Empty input gives no rows.
    """
    made = common.save(prefixes(turns), "chat-prefixes")
    kept = common.save(maximal(made), "chat-kept")
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = made.alias("m").join(kept.alias("k"), F.col("m.conv_id").eqNullSafe(F.col("k.conv_id"))).select("k.conv_id", "n_turns", "ord", F.expr(f"cast(ord div {BLOCK} as int)").alias("part"), said.alias("said"))
    parts = rows.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "said"))).alias("t"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("t.said"), "").alias("text"))


def op8(spark, sf_dir: str) -> DataFrame:
    return render(common.load(spark, sf_dir, "conversations"))


OP8_SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations),
s as (
  select conv_id, row_number() over w as n, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as said
  from t window w as (partition by conv_id order by turn nulls last, role nulls first, text nulls first)
), p as (select conv_id, n, md5(string_agg(said, '') over (partition by conv_id order by n)) as h from s),
c as (select conv_id, max(n) as n from p group by conv_id),
w as (select p.h, c.n, min(c.conv_id) as conv_id from p join c on p.conv_id is not distinct from c.conv_id and p.n = c.n group by p.h, c.n),
i as (select distinct p.h, p.n from p join c on p.conv_id is not distinct from c.conv_id and p.n < c.n),
k as (select conv_id, n from w where not exists (select 1 from i where i.h = w.h and i.n = w.n))
select k.conv_id, ((s.n - 1) // 512)::int as part, k.n::bigint as n_turns, string_agg(s.said, '' order by s.n) as text
from s join k on s.conv_id is not distinct from k.conv_id group by k.conv_id, k.n, 2
"""
