"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be up to k = `rate` * n edits away. It is cut into one piece more than that (rounded up
to pairs of neighbours), so some pair has at most one edit and one of its pieces stands in the document as it is. An
Aho-Corasick automaton finds all piece hits in one pass over the whole text; a hit stays only if its neighbour has a
half standing beside it, which one edit cannot avoid; the place is then verified with Myers' bit-parallel distance
(item anywhere in the window). Texts are compared lower-cased with white space collapsed to one blank.

Items are taken in blocks of BLOCK_CHARS characters, a broadcast of bounded size; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

common.ship(__name__)

RATE, BLOCK_CHARS = 0.1, 4_000_000
HITS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, rate: float = RATE) -> int:
    """Edits allowed for an item of n characters."""
    return int(n * rate)


def pieces(item: str, k: int) -> list[tuple[int, str, str, bool]]:
    """(place, piece, neighbour, neighbour follows) for k // 2 + 1 pairs that cover the item; the whole item if k is 0.

    k edits over k // 2 + 1 pairs leave one pair with at most one edit, so one of its two pieces is whole.
    """
    if k == 0:
        return [(0, item, "", True)]
    n = 2 * (k // 2 + 1)
    cuts = [i * len(item) // n for i in range(n + 1)]
    parts = [item[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(cuts[i], parts[i], parts[i ^ 1], i % 2 == 0) for i in range(n)]


def beside(text: str, start: int, end: int, other: str, follows: bool) -> bool:
    """Whether a half of the neighbour stands next to text[start:end]; true of any neighbour within one edit."""
    area = text[end : end + len(other) + 1] if follows else text[max(0, start - len(other) - 1) : start]
    half = len(other) // 2
    return other[:half] in area or other[half:] in area


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """Least edit distance of the item to any substring of window, and where the first such substring ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(window, 1):
        e = eq.get(c, 0)
        diagonal = (((e & up) + up) ^ up) | e | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(e | down | plus))
        down = plus & (e | down)
    return best, end


class Matcher:
    """All items of one block, compiled."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, where = [], {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text), rate)
            n = len(self.items)
            self.items.append((item_id, text, k, masks(text)))
            for at, piece, other, follows in pieces(text, k):
                where.setdefault(piece, []).append((n, at, other, follows))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of every item within its budget: its nearest place, the first of equals.

        start and end count characters of the normalised text; start is exact for distance 0, else end less the
        item's length.
        """
        if not self.items or not (text := normal(text)):
            return []
        seen, best = set(), {}
        for last, (size, uses) in self.automaton.iter(text):
            start = last - size + 1
            for n, at, other, follows in uses:
                if not beside(text, start, last + 1, other, follows):
                    continue
                item_id, item, k, eq = self.items[n]
                step = max(1, k)
                cell = (start - at) // step
                if (n, cell) in seen:
                    continue
                seen.add((n, cell))
                low = max(0, cell * step - k)
                window = text[low : cell * step + step + len(item) + k]
                if (exact := window.find(item)) >= 0:
                    found = (0, low + exact + len(item))
                else:
                    distance, end = myers(eq, len(item), window)
                    if distance > k:
                        continue
                    found = (distance, low + end)
                if n not in best or found < best[n]:
                    best[n] = found
        found = ((self.items[n][0], d, max(0, e - len(self.items[n][1])), e) for n, (d, e) in best.items())
        return sorted(found, key=lambda h: (h[0] is None, h[0] or 0, *h[1:]))


def matchers(benchmark: DataFrame, rate: float = RATE) -> list[Column]:
    """For each block of items, a function Column(text) -> HITS. Null and blank texts match nothing; an item without an id does.

    Items are dealt to blocks of about BLOCK_CHARS characters by a hash of id and text, so each broadcast is bounded
    whatever the size of the benchmark; more items mean more blocks. Equal rows are one item.
    """
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    return [_matcher(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), rate) for b in range(blocks)]


def _matcher(items: DataFrame, rate: float):
    rows = sorted(((r[0], normal(r[1])) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shared = items.sparkSession.sparkContext.broadcast((rows, rate))

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)  # once a task, not once a batch
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "start": a, "end": b} for i, d, a, b in matcher.search(t)] for t in texts])

    return find


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for every document and every item in it, one row a pair and row of docs.

    Null and blank texts hold no item. Equal items with other ids are reported each, an item without an id with a null
    item_id. Of equally near places the first counts. Very long texts are searched whole. Repeated rows are reported one
    by one. Empty tables give no rows.
    """
    out = None
    for find in matchers(benchmark, rate):
        part = docs.select("doc_id", F.explode(find(F.col("text"))).alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were, extra ones of any name included.

    Null and blank texts stay. An item counts whether it has an id or not. Repeated rows stay or go together. An empty
    benchmark keeps every row; empty docs give no rows.
    """
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"))
    for find in matchers(benchmark, rate):
        out = out.where(F.size(find(F.col("r.text"))) == 0)
    return out.select("r.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return hits(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))
