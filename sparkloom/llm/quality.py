"""Quality rules as a short-circuit cascade, in SQL expressions only.

Every rule is a Column over the text. On a bounded sample (the first SAMPLE_ROWS rows that a task reads) each rule is
evaluated by itself between two readings of the clock: that gives its share of rejected rows and its cost a row. Rules
run in order of rejections per cost inside one CASE; the order is a plan choice alone: which rows are kept does not
depend on it. keep() makes each rule's inputs inside its branch, so a row stops at its first failing rule and later
rules cost it nothing. judge() returns the inputs of all rules, so there is little to skip there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

SAMPLE_ROWS = 500
SYMBOLS = "#*$%&|<>"


def _chars_in(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _word_chars(text: Column) -> Column:
    return (F.char_length(text) - _chars_in(text, common.SPACE_CHARS)).cast("long")


def _line_stats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.translate(x, common.SPACE_CHARS, "")) > 0)
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))


def _repeated(words: Column) -> Column:
    """Words of an array that lie in a 3-word window found at least twice in it.

    Windows are XXH64 of their words. Arrays without a repeated window stop after one pass; the others sort
    (window, place) pairs and compare neighbours, so cost is n log n for any text.
    """
    n = F.size(words)
    none = F.lit(0).cast("long")

    def windows(w: Column) -> Column:
        def of(h: Column) -> Column:
            pairs = F.zip_with(F.slice(h, 1, F.size(h) - 2), F.slice(h, 2, F.size(h) - 2), lambda a, b: F.xxhash64(a, b))
            return F.zip_with(pairs, F.slice(h, 3, F.size(h) - 2), lambda a, b: F.xxhash64(a, b))

        return let(F.transform(w, lambda x: F.xxhash64(x)), of)

    def covered(g: Column) -> Column:
        placed = F.zip_with(g, F.sequence(F.lit(0), F.size(g) - 1), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        return let(F.sort_array(placed), lambda s: let(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a.v == b.v, F.lit(False))), lambda same: _spans(s, same)))

    def _spans(s: Column, same: Column) -> Column:
        before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.size(same) - 1))
        marks = F.zip_with(same, before, lambda a, b: a | b)
        at = F.sort_array(F.filter(F.zip_with(s, marks, lambda x, m: F.when(m, x.i)), lambda i: i.isNotNull()))
        return let(at, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), none, lambda x, y: x + y))

    def judged(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(covered(g))

    return F.when(n < 4, none).otherwise(let(windows(words), judged))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns NAMES (long) added or replaced; a null text has no words, symbols or lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    stats = let(common.words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    row = F.struct(
        stats.alias("s"), _line_stats(t).alias("l"), _word_chars(t).alias("q_word_chars"), _chars_in(t, SYMBOLS).alias("q_symbols"),
    )
    # A generator of one row: what reads the features cannot be pushed below it, so each text is scanned once.
    made = docs.drop(*NAMES).select("*", F.explode(F.array(row)).alias("q_row"))
    return made.withColumns({"q_words": F.col("q_row.s.n"), "q_word_chars": F.col("q_row.q_word_chars"), "q_symbols": F.col("q_row.q_symbols"), "q_dup_lines": F.col("q_row.l.d"), "q_lines": F.col("q_row.l.n"), "q_repeat_words": F.col("q_row.s.r")}).drop("q_row")


NAMES = ("q_row", "q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_lines", "q_repeat_words")

# The two base rules, then lenient limits that only plain junk passes.
BASE = {
    "few_words": "q_words < 50",
    "repeated_windows": "100 * q_repeat_words > 50 * q_words",
}
RULES = {
    "symbols": "10 * q_symbols > 3 * q_words",
    "short_words": "q_word_chars < 2 * q_words",
    "long_words": "q_word_chars > 25 * q_words",
    "repeated_lines": "q_lines >= 4 and 2 * q_dup_lines > q_lines",
}


def _fails(rule: str, t: Column, w: Column | None = None) -> Column:
    """Whether the text t fails a rule; w is its array of words where that is made already."""
    used = sorted(set(re.findall(r"q_\w+", rule)))
    python = "(" + rule.replace(" and ", ") & (") + ")"
    of_lines = {"q_lines": "n", "q_dup_lines": "d"}
    if set(used) & set(of_lines):
        if not set(used) <= set(of_lines):
            raise ValueError(f"a rule over lines and words: {rule}")
        return let(_line_stats(t), lambda q: eval(python, {}, {k: q[f] for k, f in of_lines.items()}))
    words = common.words(t) if w is None else w
    make: dict[str, Callable[[], Column]] = {
        "q_words": lambda: F.size(words).cast("long"), "q_word_chars": lambda: _word_chars(t), "q_symbols": lambda: _chars_in(t, SYMBOLS), "q_repeat_words": lambda: _repeated(words),
    }
    return let(F.struct(*[make[k]().alias(k) for k in used]), lambda q: eval(python, {}, {k: q[k] for k in used}))


def measured(docs: DataFrame, rules: dict[str, str], text: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Share of rejected rows and nanoseconds a row of each rule, over at most `rows` rows; zeros without rows.

    The limit is met where the rows are read, and only verdicts and times leave the tasks, whatever the texts' size.
    """
    t = F.coalesce(docs[text], F.lit(""))

    def clock() -> Column:
        return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")

    def timed(rule: str) -> Column:
        return let(clock(), lambda a: let(_fails(rule, t), lambda r: F.struct(r.alias("r"), (clock() - a).alias("ns"))))

    seen = docs.select(*[timed(rules[k]).alias(k) for k in rules]).limit(rows).collect()
    return {k: (sum(bool(x[k].r) for x in seen) / max(1, len(seen)), sum(x[k].ns for x in seen) / max(1, len(seen))) for k in rules}


def order(facts: dict[str, tuple[float, float]]) -> list[str]:
    """Rule names by rejections per cost, most first; ties by name."""
    return sorted(facts, key=lambda k: (-facts[k][0] / (1.0 + facts[k][1]), k))


def cascade(rules: dict[str, str], names: list[str]) -> Column:
    """Name of the first failing rule in the given order, null for rows that pass all; over the columns of features()."""
    return F.coalesce(*[F.when(F.expr(rules[k]), F.lit(k)) for k in names], F.lit(None).cast("string"))


def passes(rules: dict[str, str], names: list[str], text: Column) -> Column:
    """Whether text fails none of the rules, tried in the given order; words are made once, at the first rule in need."""
    t = F.coalesce(text, F.lit(""))

    def chain(rest: list[str], w: Column | None) -> Column:
        if not rest:
            return F.lit(True)
        rule = rules[rest[0]]
        if w is None and re.search("q_words|q_repeat_words", rule):
            return let(common.words(t), lambda w: chain(rest, w))
        return F.when(_fails(rule, t, w), F.lit(False)).otherwise(chain(rest[1:], w))

    return chain(names, None)


def judge(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the q_ features, base_failed, kept and rejected_by, added or replaced.

    rejected_by names the failing rule that is declared first, whatever the cascade's order. Null, empty and blank
    texts have no words, fail few_words and are not kept. Very long texts are judged whole. Ties and repeated rows are
    judged alike. Other columns, of any name, stay. Empty input gives no rows.
    """
    rules = {**BASE, **RULES}
    names = order(measured(docs, rules, text, sample_rows))
    made = features(docs, text)
    base = reduce(lambda a, b: a | b, [F.expr(x) for x in BASE.values()])
    return made.withColumns({"base_failed": base, "kept": cascade(rules, names).isNull(), "rejected_by": cascade(rules, list(rules))})


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass every rule, all columns as they were, extra ones of any name included.

    Null, empty and blank texts fail few_words and go. Repeated rows are kept or go together. Empty input gives no rows.
    """
    rules = {**BASE, **RULES}
    return docs.where(passes(rules, order(measured(docs, rules)), docs["text"]))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), "base_failed", "kept",
    )


OP5_SQL = r"""
with w as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as a,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), g as (
  select rid, i, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] as v from (select rid, a, unnest(range(1, len(a) - 1)) as i from w)
), d as (
  select rid, i from g qualify count(*) over (partition by rid, v) > 1
), r as (
  select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from d) group by rid
), s as (
  select doc_id, len(a)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from w left join r using (rid)
), j as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 25 * n_words or (n_lines >= 4 and 2 * n_dup_lines > n_lines)) as kept
from j
"""
