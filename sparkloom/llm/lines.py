"""Line dedup over suffix ranks built by distributed prefix doubling, in DataFrame operations only.

Every document is a sequence of line ids (XXH64 of the lines that hold a word). Only ids found twice in the corpus
can lie in a repeated run, so all else drops out after one aggregate. Suffixes of the rest are ranked by prefix
doubling: round k ranks prefixes of 2^k lines by the pair of ranks 2^(k-1) lines apart; classes of one member
drop out; classes are numbered in sort order by range partitions, so ranks are those of the suffix array.

Suffixes that share a prefix form one interval of the suffix array, named by two overlapping ranks. A run repeats
with at least MIN_WORDS words exactly if it is a union of shortest windows of that many words (taken from each
start and back from each end), so these windows are looked up; a window that is not the first of its interval, in
order of (doc_id, text hash, line), is a later copy and its lines go. A shortest window has at most MIN_WORDS lines,
so log2(MIN_WORDS) rounds decide runs of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """(d, s, i, id, w): one row a line with words; d orders documents (null ids last), s names (doc_id, text)."""
    split = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    d = F.coalesce(F.col("doc_id"), F.lit(9223372036854775807))
    rows = docs.select(d.alias("d"), F.xxhash64("doc_id", F.xxhash64("text")).alias("s"), split.alias("i", "line"))
    return rows.select("d", "s", "i", F.xxhash64("line").alias("id"), common.n_words(F.col("line")).cast("int").alias("w")).where("w > 0")


def _numbered(classes: DataFrame, keys: list[str]) -> DataFrame:
    """classes with a number r that grows in the order of keys: suffix-array order over range partitions."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.save(classes.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id()), "lines-class")


def ranks(active: DataFrame, rounds: int) -> DataFrame:
    """(k, s, j, r) for rounds 0..rounds: rank of the 2^k lines from place j, where that prefix is found twice.

    active has (s, j, id), j numbering the lines with words of a document.
    """
    classes = _numbered(active.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), ["id"])
    level = common.save(active.join(classes, "id").select(F.lit(0).alias("k"), "s", "j", "r"), "lines-rank")
    out = level
    for k in range(1, rounds + 1):
        ahead = level.select("s", (F.col("j") - (1 << (k - 1))).alias("j"), F.col("r").alias("r2"))
        pairs = common.save(level.select("s", "j", F.col("r").alias("r1")).join(ahead, ["s", "j"]), "lines-pair")
        classes = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2")
        classes = _numbered(classes, ["r1", "r2"])
        if classes.isEmpty():
            break
        level = common.save(pairs.join(classes, ["r1", "r2"]).select(F.lit(k).alias("k"), "s", "j", "r"), "lines-rank")
        out = out.unionByName(level)
    return out


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """(d, s, j, n): shortest windows of at least min_words words from each start and back from each end.

    Windows lie in unbroken stretches of active lines. Each frame grows from the stretch's one side, so the cost of
    a stretch is linear after its sort; a stretch lies in one document.
    """
    by_place = Window.partitionBy("s").orderBy("j")
    a = active.withColumn("g", F.col("j") - F.row_number().over(by_place))
    run = Window.partitionBy("s", "g").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("s", "g")
    a = a.withColumn("upto", F.sum("w").over(run)).withColumn("at", F.col("upto") - F.col("w"))
    a = a.withColumns({"all": F.sum("w").over(whole), "first": F.min("j").over(whole), "last": F.max("j").over(whole)})
    from_start = F.min("j").over(Window.partitionBy("s", "g").orderBy(-F.col("at")).rangeBetween(Window.unboundedPreceding, -min_words))
    to_end = F.max("j").over(Window.partitionBy("s", "g").orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    a = a.withColumns({"e": from_start, "b": to_end})
    end = F.when(F.col("all") - F.col("at") >= min_words, F.coalesce("e", F.col("last") + 1))
    begin = F.when(F.col("upto") >= min_words, F.coalesce(F.col("b") + 1, "first"))
    starts = a.select("d", "s", "j", (end - F.col("j")).alias("n"))
    ends = a.select("d", "s", begin.alias("j"), (F.col("j") + 1 - begin).alias("n"))
    return starts.unionByName(ends).where("n is not null").distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(s, i): the lines, by place in the split text, that lie in a later copy of a repeated run."""
    lines = common.save(_lines(docs).distinct(), "lines")
    # Saved before its join: AQE can split a hot line's rows only where both sides are plain shuffles.
    twice = common.save(lines.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "lines-twice")
    place = F.row_number().over(Window.partitionBy("s").orderBy("i")) - 1
    active = common.save(lines.withColumn("j", place).join(twice, "id", "left_semi"), "lines-active")
    rounds = max(0, min_words.bit_length() - 1)
    named = common.save(ranks(active, rounds), "lines-ranks")
    wins = _windows(active, min_words).withColumn("k", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    left = named.select("k", "s", "j", F.col("r").alias("r1"))
    right = named.select("k", "s", F.col("j").alias("j2"), F.col("r").alias("r2"))
    wins = wins.withColumn("j2", F.expr("j + n - cast(shiftleft(1, k) as int)"))
    wins = common.save(wins.join(left, ["k", "s", "j"]).join(right, ["k", "s", "j2"]).select("d", "s", "j", "n", "r1", "r2"), "lines-windows")
    first = wins.groupBy("n", "r1", "r2").agg(F.count("*").alias("c"), F.min(F.struct("d", "s", "j")).alias("f")).where("c > 1")
    first = common.save(first, "lines-first")
    late = wins.alias("w").join(first.alias("f"), ["n", "r1", "r2"]).where(F.struct("w.d", "w.s", "w.j") > F.col("f.f"))
    gone = late.select("s", F.explode(F.sequence("j", F.col("j") + F.col("n") - 1)).alias("j")).distinct()
    return gone.join(active.select("s", "j", "i"), ["s", "j"]).select("s", "i")


def spans(gone: DataFrame) -> DataFrame:
    """(s, spans): the removed lines of a document as sorted [from, to] places."""
    g = gone.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("s").orderBy("i")))
    each = g.groupBy("s", "g").agg(F.struct(F.min("i").alias("from"), F.max("i").alias("to")).alias("x"))
    return each.groupBy("s").agg(F.array_sort(F.collect_list("x")).alias("spans"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text replaced, and removed_spans and n_removed added or replaced (line places from 0, both ends included).

    The first copy of a run stays. Blank lines never count and stay. Null and empty texts stay as they are. Rows
    with equal doc_id and text are one document and get the same result. Empty input gives no rows.
    """
    found = common.save(spans(later_copies(docs, min_words)), "lines-spans")
    docs = docs.drop("removed_spans", "n_removed")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), F.xxhash64("doc_id", F.xxhash64("text")).alias("s"))
    # One plan at every size: spans grow with the corpus, so they are hashed by partition and never broadcast; texts are not sorted.
    out = packed.join(found.hint("shuffle_hash"), "s", "left")

    def kept(ss):
        lines = F.split(F.col("r.text"), "\n", -1)
        inside = F.filter(lines, lambda x, i: ~F.exists(ss, lambda p: (p["from"] <= i) & (i <= p["to"])))
        return F.array_join(inside, "\n")

    text = F.when(F.col("spans").isNull(), F.col("r.text")).otherwise(kept(F.col("spans")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    n = F.aggregate(F.coalesce("spans", none), F.lit(0), lambda a, p: a + p["to"] - p["from"] + 1)
    return out.select(*[text.alias(c) if c == "text" else F.col(f"r.`{c}`").alias(c) for c in docs.columns], F.coalesce("spans", none).alias("removed_spans"), n.alias("n_removed"))


def op6(spark, sf_dir: str) -> DataFrame:
    return dedup(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
