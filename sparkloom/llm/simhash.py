"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are made per document in Arrow batches (Python; bounded by one batch). All else is joins on integers.

Linking at Hamming distance 3, exact and without emitting the pairs of a group:
1. Every distinct fingerprint emits its 65 variants within half the radius (1 bit). Two that meet on a variant
   differ in at most 2 bits, so they are linked with no further check; at most 65 fingerprints meet on a variant.
2. Distance 3 asks for variants at 2 bits on one side, 2,081 rows a fingerprint. Instead the ball is taken on
   each 32-bit half: of 3 differing bits one half holds at most 1, so the half-balls (33 variants) meet the other
   side's plain half, and colliding pairs are verified by bit count. Halves shared by more than HOT fingerprints
   go on to agree on a 16-bit quarter and an 8-bit eighth as well, which bounds what meets there by 256.
3. Links are reduced to components by large-star/small-star.

Distance 3 misses most copies below a similarity of 0.9, so deduplication adds texts whose sets of five-word shingles
have a Jaccard similarity of SIMILAR or more: MinHash bands propose, the exact similarity of the sets decides. A band
held by one component proposes nothing. Every text first meets the leader of each of its bands: the member that shares
bands with most texts, so that edited copies of one text meet that text. What is then left in different components
meets in pairs in bands of up to CROWD texts; in larger ones every text meets LEADERS members drawn by hash. Texts of
larger bands that are then still apart meet by their rarest shingles: of two texts as similar as asked, each has one of
the other's among its rarest 1 - SIMILAR. That finds all their links, whatever bands they share. No pair is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import common

common.ship(__name__)

HOT = 512
BROADCAST_ROWS = 10_000
# Least similarity of near copies, MinHash bands and rows of a band (at 0.8 all bands fail once in 2e7).
SIMILAR, BANDS, ROWS = 0.8, 32, 4
CROWD, LEADERS = 64, 3
# Slots that count shared shingles; pairs of texts on rare shingles above which more leaders are met first.
SLOTS, MANY_PAIRS = 1 << 22, 200_000_000
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: str | None) -> np.ndarray:
    """XXH64 of every three words, or of all words of a shorter text; none for null, empty and blank texts."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < 3:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist(), strict=True)), np.uint64, n - 2)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; 0 for null, empty and blank texts."""
    return _folded(_hashes(text))


def _folded(hashes: np.ndarray) -> int:
    return int(hashes[0]) if len(hashes) == 1 else _majority(hashes) if len(hashes) else 0


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of every five words, from those of its first and last three; a text under five words is one shingle."""
    if len(hashes) < 3:
        return _stirred(np.bitwise_xor.reduce(hashes * np.arange(3, 3 + 2 * len(hashes), 2, np.uint64), keepdims=True)) if len(hashes) else hashes
    return _stirred(hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + _stirred(hashes[2:]))


def _bands(shingles: np.ndarray) -> list[int]:
    """BANDS signed keys, each a hash of ROWS least values under their own factor; 1,024 shingles are held at once."""
    if not len(shingles):
        return []
    low = np.min([(shingles[a : a + 1024, None] * _FACTORS).min(axis=0) for a in range(0, len(shingles), 1024)], axis=0)
    low = low.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _stirred(out * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
    return out.view(np.int64).tolist()


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes. Eight passes sum one bit of each byte; 255 rows fit a byte lane."""
    cuts = np.arange(0, len(hashes), 255)
    out = 0
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * sums > len(hashes)).tolist():
            out |= 1 << (8 * byte + k)
    return out


@F.pandas_udf(LongType())
def simhash(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint, text), np.uint64, len(text)).view(np.int64))


@F.pandas_udf(StructType().add("fp", LongType()).add("bands", ArrayType(LongType())))
def signed(text: pd.Series) -> pd.DataFrame:
    hashes = [_hashes(t) for t in text]
    fps = np.fromiter(map(_folded, hashes), np.uint64, len(hashes)).view(np.int64)
    return pd.DataFrame({"fp": fps, "bands": [_bands(_shingles(h)) for h in hashes]})


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(text: pd.Series) -> pd.Series:
    return pd.Series([np.unique(_shingles(_hashes(t))).view(np.int64) for t in text])


def _masks(bits) -> list[int]:
    return [0] + [1 << b if b < 63 else -(1 << 63) for b in bits]


def _ball(df: DataFrame, width: int, name: str, value: str) -> DataFrame:
    """One row per variant of the integer column value within 1 bit."""
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(range(width))]))
    return df.withColumn("_m", masks).withColumn(name, F.col(value).bitwiseXOR(F.col("_m"))).drop("_m")


def _parts(df: DataFrame, source: str, width: int, name: str) -> DataFrame:
    """Both halves of the low `2 * width` bits of source, tagged by which half: (name_h, name_v, name_rest)."""
    mask = (1 << width) - 1
    low = F.col(source).bitwiseAND(F.lit(mask).cast("long"))
    high = F.shiftrightunsigned(source, width).bitwiseAND(F.lit(mask).cast("long"))
    pair = F.array(F.struct(F.lit(0).alias("h"), low.alias("v"), high.alias("rest")), F.struct(F.lit(1).alias("h"), high.alias("v"), low.alias("rest")))
    return df.withColumn("_p", F.explode(pair)).select(*df.columns, *[F.col(f"_p.{c}").alias(f"{name}_{c}") for c in ("h", "v", "rest")])


def _verified(targets: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different components that meet on keys and differ in exactly 3 bits."""
    a, b = targets.alias("a"), probes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) == 3
    return a.join(common.spread(b), [*on, F.col("a.comp") != F.col("b.comp"), near]).select(F.col("a.comp").alias("u"), F.col("b.comp").alias("v"))


def link(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints `fp` that have a link; root is one fingerprint of the component."""
    from pyspark.sql import Window

    variants = _ball(fps.select("fp"), 64, "x", "fp")
    least = F.min("fp").over(Window.partitionBy("x"))
    near = variants.select("fp", least.alias("low")).where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    first = common.save(common.components(near), "simhash-near")

    rep = fps.select("fp").join(common.spread(first.select(F.col("node").alias("fp"), "root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp"))
    halves = common.save(_parts(rep, "fp", 32, "a"), "simhash-halves")
    hot = common.save(halves.groupBy("a_h", "a_v").agg(F.count("*").alias("n")).where(F.col("n") > HOT).drop("n"), "simhash-hot")
    any_hot = hot.count()
    hot = F.broadcast(hot) if any_hot <= BROADCAST_ROWS else common.spread(hot)
    cold = halves.join(hot, ["a_h", "a_v"], "left_anti") if any_hot else halves
    slim = cold.select("fp", "comp", "a_h", "a_v")
    probes = _ball(slim, 32, "k", "a_v").select("fp", "comp", "a_h", F.col("k").alias("a_v"))
    links = _verified(slim, probes, ["a_h", "a_v"])
    if any_hot:
        around = _ball(halves, 32, "k", "a_v").drop("a_v").withColumnRenamed("k", "a_v").join(hot, ["a_h", "a_v"], "left_semi")
        held = halves.join(hot, ["a_h", "a_v"], "left_semi")
        fine = ["a_h", "a_v", "b_h", "b_v", "c_h", "c_v"]

        def deeper(df: DataFrame, ball: bool) -> DataFrame:
            df = _parts(df, "a_rest", 16, "b")
            if ball:
                df = _ball(df, 16, "k", "b_v").drop("b_v").withColumnRenamed("k", "b_v")
            df = _parts(df, "b_rest", 8, "c")
            if ball:
                df = _ball(df, 8, "k", "c_v").drop("c_v").withColumnRenamed("k", "c_v")
            return df.select("fp", "comp", *fine)

        links = links.unionByName(_verified(deeper(held, False), deeper(around, True), fine))
    second = common.components(links)
    joined = rep.join(common.spread(second.select(F.col("node").alias("comp"), F.col("root").alias("top"))), "comp", "left")
    return joined.select("fp", F.coalesce("top", "comp").alias("root"))


def _open(members: DataFrame) -> DataFrame:
    """The members (key, th, comp) of keys that several components hold."""
    several = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return members.join(common.spread(common.save(several, "similar-keys")), "key", "left_semi")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): components of those pairs (ta, tb, u, v) whose shingle sets are as similar as asked, exactly."""
    pairs = common.save(pairs, "similar-pairs")
    n = pairs.count()
    if n == 0:
        return pairs.select("u", "v")
    if n <= BROADCAST_ROWS:  # then only the sets that they name are shuffled
        named = pairs.select(F.explode(F.array("ta", "tb")).alias("th")).distinct()
        sets = common.save(sets.join(F.broadcast(named), "th", "left_semi"), "similar-named")
    a, b = sets.select(F.col("th").alias("ta"), F.col("set").alias("sa")), sets.select(F.col("th").alias("tb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - F.lit(1e-9)
    sizes = F.least(F.size("sa"), F.size("sb")) >= F.lit(similarity) * F.greatest(F.size("sa"), F.size("sb")) - F.lit(1e-9)
    return pairs.join(common.spread(a), "ta").join(common.spread(b), "tb").where(F.when(sizes, near).otherwise(F.lit(False))).select("u", "v").distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs of members (key, th, comp) of different components that meet on a key; callers bound a key's members."""
    a, b = members.alias("a"), members.alias("b")
    met = a.join(common.spread(b), [F.col("a.key") == F.col("b.key"), F.col("a.th") < F.col("b.th"), F.col("a.comp") != F.col("b.comp")])
    return met.select(F.col("a.th").alias("ta"), F.col("b.th").alias("tb"), F.col("a.comp").alias("u"), F.col("b.comp").alias("v")).distinct()


def _coarse(n):
    """Sizes rounded down to their ten highest bits, so that few differ."""
    cut = np.maximum(np.frexp(n)[1] - 10, 0)
    return n >> cut << cut


def _shared(live: DataFrame, similarity: float):
    """Of the texts (th, comp, set) still in question: a function of sets to how many shingles other components may hold
    too and must hold at least, and one to the shingles that a similar text must share one of, with their places.

    Shingles that several components hold are counted in SLOTS slots by their low bits, a table of bounded size. A
    shingle that shares another's slot counts as held too, so too many are kept and none is missed.
    """
    rows = live.select("comp", F.explode("set").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("d"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    table = held.groupBy(F.col("key").bitwiseAND(F.lit(SLOTS - 1).cast("long")).alias("slot")).agg(F.sum("d").alias("d")).toPandas().sort_values("slot")
    sizes = live.select(F.size("set").alias("n")).selectExpr("n", "greatest(0, length(bin(n)) - 10) AS cut").selectExpr("shiftleft(shiftright(n, cut), cut) AS n").distinct()
    sizes = np.unique(_coarse(np.array([r.n for r in sizes.collect()], np.int64)))
    sent = live.sparkSession.sparkContext.broadcast((np.append(table["slot"].to_numpy(np.int64), SLOTS), np.append(table["d"].to_numpy(np.int64), 0), sizes))

    def often(keys: np.ndarray) -> np.ndarray:
        slots, d, _ = sent.value
        at = np.searchsorted(slots, keys & (SLOTS - 1))
        return np.where(slots[at] == keys & (SLOTS - 1), d[at], 0)

    def least(n: int) -> float:
        """What a text of n shingles shares at least with a similar text of any size that there is."""
        low = int(np.ceil(similarity * n - 1e-6))
        known = sent.value[2]
        at = min(np.searchsorted(known, _coarse(np.int64(low))), len(known) - 1)
        return similarity / (1 + similarity) * (n + max(low, int(known[at]))) - 1e-6

    @F.pandas_udf("c int, need double")
    def counts(sets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(int(np.count_nonzero(often(s))), least(len(s))) for s in sets], columns=["c", "need"])

    @F.pandas_udf("array<struct<key:long,i:int,c:int>>")
    def places(sets: pd.Series) -> pd.Series:
        def rows(s):
            d = often(s)
            keys, d, n, c = s[d > 0], d[d > 0], len(s), int(np.count_nonzero(d))
            keys = keys[np.lexsort((keys, d))][: max(0, c - int(np.ceil(similarity * n - 1e-6)) + 1)]
            return [{"key": int(k), "i": n - c + 1 + at, "c": c} for at, k in enumerate(keys)]

        return pd.Series([rows(s) for s in sets])

    return counts, places


def _rarest(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, th, comp, n, c, i): the shingles, rarest first and i-th of n, that two texts (th, comp) must share one of.

    Sets with a similarity of s share s / (1 + s) of their sizes' sum, so at least s of each. Shingles that no other
    component holds come first and give no row; c are left. A text with too few left for any size of partner goes.
    """
    live = common.save(sets.join(common.spread(texts), "th").select("th", "comp", "set"), "similar-live")
    counts, places = _shared(live, similarity)
    live = live.withColumn("s", counts("set")).where("s.c >= s.need")
    ranked = live.select("th", "comp", F.size("set").alias("n"), F.explode(places("set")).alias("p"))
    return ranked.select("p.key", "th", "comp", "n", "p.c", "p.i")


def _close(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows (key, th, comp, n, c, i) of _rarest() that may be as similar as asked.

    Such texts share `need` shingles: each has as many that other components hold, and the first in common is early
    enough in both to leave as many. What two texts share up to their last common key is counted; beyond it they share
    at most what the shorter has left.
    """
    a, b = rows.alias("a"), rows.alias("b")
    need = F.lit(similarity / (1 + similarity)) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-6)
    early = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) + 1 >= need
    met = a.join(common.spread(b), [F.col("a.key") == F.col("b.key"), F.col("a.th") < F.col("b.th"), F.col("a.comp") != F.col("b.comp"), F.least("a.c", "b.c") >= need, early])
    met = met.groupBy(F.col("a.th").alias("ta"), F.col("b.th").alias("tb"), F.col("a.comp").alias("u"), F.col("b.comp").alias("v"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    met = met.agg(F.count("*").alias("c"), F.max("a.i").alias("ia"), F.max("b.i").alias("ib"))
    most = F.col("c") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return met.where(most >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)).select("ta", "tb", "u", "v")


def _led(members: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs of each member with the leaders b of its keys, where their components differ."""
    met = members.join(common.spread(leads), "key").where("comp <> b.comp")
    return met.select(F.col("th").alias("ta"), F.col("b.th").alias("tb"), F.col("comp").alias("u"), F.col("b.comp").alias("v")).distinct()


def resemble(texts: DataFrame, keyed: DataFrame, roots: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(node, top): the roots that similar texts link, with one root of each such group.

    texts: (th, text); keyed: (th, fp, bands); roots: (fp, root) of every fingerprint.
    """
    rows = keyed.select("th", "fp", "bands").join(common.spread(roots), "fp").select("th", F.col("root").alias("comp"), F.explode("bands").alias("key")).distinct()
    first = common.save(_open(rows), "similar-members")
    none = first.select(F.col("comp").alias("u"), F.col("comp").alias("v")).limit(0)
    if first.isEmpty():
        return none.toDF("node", "top")
    held = common.save(texts.join(common.spread(first.select("th").distinct()), "th", "left_semi"), "similar-texts")
    sets = common.save(held.groupBy("th").agg(F.first("text").alias("text")).select("th", shingle_set("text").alias("set")), "similar-sets")
    sizes = common.save(first.groupBy("key").agg(F.count("*").alias("n")), "similar-sizes")
    degree = common.save(first.join(common.spread(sizes), "key").groupBy("th").agg(F.sum("n").alias("d")), "similar-degree")
    lead = F.min(F.struct((-F.col("d")).alias("x"), "th", "comp")).alias("b")
    leads = common.save(first.join(common.spread(degree), "th").groupBy("key").agg(lead), "similar-leads")
    links = common.save(_alike(_led(first, leads), sets, similarity), "similar-links")

    def merged() -> DataFrame:
        return common.save(common.components(links).toDF("node", "top"), "similar-top")

    top = merged()

    def moved(rows: DataFrame) -> DataFrame:
        """rows of the keys that several components still hold."""
        now = rows.join(common.spread(top), rows["comp"] == top["node"], "left").select(*[F.coalesce("top", "comp").alias(c) if c == "comp" else c for c in rows.columns])
        return common.save(_open(common.save(now, "similar-moved")), "similar-members")

    def drawn(rows: DataFrame, seed: int) -> DataFrame:
        """One row a key: its member b drawn by hash."""
        return rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("th", F.lit(seed)).alias("x"), "th", "comp")).alias("b"))

    members = moved(first)
    sizes = common.save(members.groupBy("key").agg(F.count("*").alias("n")), "similar-sizes")
    crowds = sizes.where(F.col("n") > CROWD).select("key")
    pairs = _pairs(members.join(common.spread(crowds), "key", "left_anti"))
    crowded = common.save(members.join(common.spread(crowds), "key", "left_semi"), "similar-crowded")
    if crowded.isEmpty():
        links = common.save(links.unionByName(_alike(pairs, sets, similarity)), "similar-links")
        return merged()
    for seed in range(LEADERS):
        pairs = pairs.unionByName(_led(crowded, common.save(drawn(crowded, seed), "similar-leads")))
    links = common.save(links.unionByName(_alike(pairs.distinct(), sets, similarity)), "similar-links")
    top = merged()
    rest = moved(crowded)
    if rest.isEmpty():
        return top
    keys = common.save(_open(common.save(_rarest(rest.select("th", "comp").distinct(), sets, similarity), "similar-rarest")), "similar-members")
    for seed in range(LEADERS):  # merges most of what a frequent shingle holds; the rest meets in pairs
        sizes = common.save(keys.groupBy("key").agg(F.count("*").alias("n")), "similar-sizes")
        if (sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) <= MANY_PAIRS:
            break
        often = common.save(keys.join(common.spread(sizes.where(F.col("n") > CROWD).select("key")), "key", "left_semi"), "similar-crowded")
        links = common.save(links.unionByName(_alike(_led(often, common.save(drawn(often, seed), "similar-leads")), sets, similarity)), "similar-links")
        top = merged()
        keys = moved(keys)
    links = common.save(links.unionByName(_alike(_close(keys, similarity), sets, similarity)), "similar-links")
    return merged()


def near_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row of docs; th is XXH64 of the text and tells texts of one id apart.

    root is one fingerprint of the component and alone identifies it: a component of null ids has a null
    component_id, and an id of several texts may be the smallest of several components. Null and blank texts have
    fingerprint 0 and link like any other. Repeated rows stay repeated. Empty input gives no rows. With a similarity,
    texts whose five-word shingles are at least that similar are linked as well.
    """
    made = [simhash(F.col(text)).alias("fp")] if similarity is None else [signed(F.col(text)).alias("s")]
    keyed = docs.select(F.col(id_).alias("doc_id"), F.xxhash64(text).alias("th"), *made)
    with common.scope() as keep:
        keyed = keep(common.save(keyed if similarity is None else keyed.select("doc_id", "th", "s.fp", "s.bands"), "simhash"))
        least = common.save(keyed.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-fps")
        roots = common.save(link(least), "simhash-roots")
        if similarity is not None:
            tops = resemble(docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("text")), keyed, roots, similarity)
            roots = roots.join(common.spread(tops), roots["root"] == tops["node"], "left").select("fp", F.coalesce("top", "root").alias("root"))
            roots = common.save(roots, "simhash-tops")
        rooted = least.join(common.spread(roots), "fp")
        # Saved before the join: a component of a third of all texts is then split over tasks.
        lows = common.save(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
        table = keep(common.save(rooted.join(common.spread(lows), "root").select("fp", "root", "component_id"), "simhash-table"))
    return keyed.join(common.spread(table), "fp").select("doc_id", "th", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, similarity: float | None = SIMILAR) -> DataFrame:
    """docs with one row of each component: its smallest doc_id (then smallest text hash); all columns kept."""
    with common.scope() as keep:
        found = common.save(near_duplicates(docs, similarity=similarity), "simhash-found")
        rows = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
        rows = common.save(rows, "simhash-rows")
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("f"))
        kept = first.select(F.col("f.doc_id").alias("doc_id"), F.col("f.th").alias("th"), F.lit(True).alias("keep"))
        judged = keep(common.save(rows.join(common.spread(kept), rows.doc_id.eqNullSafe(kept.doc_id) & (rows.th == kept.th), "left").select(rows.doc_id, rows.th, "n", F.coalesce("keep", F.lit(False)).alias("keep")), "simhash-judged"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), F.xxhash64("text").alias("th"))

    def on(which: DataFrame):
        return F.col("r.doc_id").eqNullSafe(which["doc_id"]) & (packed["th"] == which["th"])

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else common.spread(df)

    gone = judged.where("not keep or n > 1").select("doc_id", "th")
    out = packed.join(side(gone), on(gone), "left_anti").select("r.*")
    again = judged.where("keep and n > 1").select("doc_id", "th")
    if not again.isEmpty():
        some = packed.join(side(again), on(again), "left_semi").groupBy("r.doc_id", "th").agg(F.first("r").alias("r"))
        out = out.unionByName(some.select("r.*"))
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
