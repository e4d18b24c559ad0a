import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import chat, common, decontaminate, lines, mixing, pii, quality, sharding, simhash, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, r string, th string, _size string, q_words string, fp string"


def docs_of(spark, rows):
    """rows of (doc_id, text, source); with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "q", "f") for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(120):
        out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 140))), f"s{rng.choice('AABBC')}"))
    for i in range(120, 150):  # near and exact copies
        words = rng.choice(out[:40])[1].split()
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "sA"))
    out += [(150, None, None), (151, "", "sB"), (152, " \n\t ", None), (153, "one", "sC"), (154, "two words", "sC"), (150, None, None), (None, "a text without id", "sA"), (3, out[3][1], out[3][2])]
    return out


def test_simhash_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 300, 1000):
        words = [rng.choice(["Aa", "bB", "c", "é", "d\u00a0d"]) for _ in range(n)]
        low = [w.replace("A", "a").replace("B", "b") for w in words]
        grams = [" ".join(low[i : i + 3]) for i in range(len(low) - 2)] or [" ".join(low)]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(" \t".join(words)) == want
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def roots_by_brute_force(fps):
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for f in fps:
        groups[find(f)].add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("hot", [512, 2])
def test_simhash_links_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(6):
            fps.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 3, 4])):
                at ^= 1 << b
    fps |= {f ^ 0b111 for f in list(fps)[:10]} | {0, 1 << 63, (1 << 63) | 3}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = defaultdict(set)
    for r in simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long")).collect():
        got[r.root].add(r.fp)
    assert {frozenset(g) for g in got.values()} == roots_by_brute_force(signed)


def test_simhash_components_and_dedup(spark, rows):
    docs = docs_of(spark, rows)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert len({r.component_id for r in found if r.fp == 0}) == 1
    by = defaultdict(list)
    for r in found:
        by[r.component_id].append(r.doc_id)
    for low, ids in by.items():
        assert low == min(i for i in ids if i is not None) if any(i is not None for i in ids) else low is None
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert Counter(r.doc_id for r in out) == Counter(by.keys()) or None in by
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_dedup_keeps_unrelated_texts_of_null_and_reused_ids(spark):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)) for _ in range(6)]
    made = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[2], "b"), (None, texts[2], "b"), (1, texts[3], "a"), (1, texts[4], "a"), (2, texts[4], "a"), (3, texts[5], "a")]
    got = simhash.deduplicate(docs_of(spark, made)).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (1, texts[4]), (3, texts[5])]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def plans_saved(monkeypatch):
    """The plans of all tables saved from here on."""
    plans, save = [], common.save

    def noted(df, label, *args):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return save(df, label, *args)

    monkeypatch.setattr(common, "save", noted)
    monkeypatch.setattr(common, "BROADCAST_EDGES", 0, raising=False)
    return plans


def test_simhash_joins_send_no_table_of_fingerprints_to_the_driver(spark, rows, monkeypatch):
    plans = plans_saved(monkeypatch)
    found = simhash.near_duplicates(docs_of(spark, rows))
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert len(found.collect()) == len(rows) and any("SortMergeJoin" in p for _, p in plans)
    assert [label for label, p in plans if "Broadcast" in p] == []


def test_dedup_joins_send_no_table_of_texts_to_the_driver(spark, rows, monkeypatch):
    plans = plans_saved(monkeypatch)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    edited = [(1000 + i, t + " " + " ".join(rng.choice("abcdef") for _ in range(9)), s) for i, t, s in rows[:30]]  # linked by similarity
    found = simhash.deduplicate(docs_of(spark, rows + edited))
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert found.count() > 0 and any(label == "similar-links" for label, _ in plans)
    assert [label for label, p in plans if "Broadcast" in p] == []


def similarity_of(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_dedup_finds_copies_of_similarity_080(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    rng = random.Random(5)
    texts = []
    for _ in range(8):
        base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 8, 12):
            words = base[:]
            for at in rng.sample(range(200), changes):
                words[at] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    parent = list(range(len(texts)))

    def find(a):
        return a if parent[a] == a else find(parent[a])

    bits = [simhash.fingerprint(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if similarity_of(texts[a], texts[b]) >= 0.8 or (bits[a] ^ bits[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    lows = {}
    for i in range(len(texts)):
        lows.setdefault(find(i), i)
    got = simhash.deduplicate(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in got) == sorted(lows.values())


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_similar_texts_of_one_large_band_are_all_linked(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(6)

    def made(n):
        return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]

    form, texts = made(60), ["one", "two words"]  # a form that all share, filled in twice nearly alike, and cut short
    for i in range(40):
        filled = form + made(120)
        texts += [" ".join(filled), " ".join(f"w{rng.randrange(10**6)}" if at in (70, 100, 130, 160)[: 1 + i % 4] else w for at, w in enumerate(filled)), " ".join(filled[: 100 + i])]
    parent = list(range(len(texts)))

    def find(a):
        return a if parent[a] == a else find(parent[a])

    for a in range(len(texts)):
        for b in range(a):
            if similarity_of(texts[a], texts[b]) >= 0.8:
                parent[find(a)] = find(b)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    rows = [(i, i, [7], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "th long, fp long, bands array<long>, text string")
    tops = {r.node: r.top for r in simhash.resemble(frame.select("th", "text"), frame.drop("text"), frame.select("fp", F.col("fp").alias("root"))).collect()}
    got = defaultdict(set)
    for i in range(len(texts)):
        got[tops.get(i, i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 42 < len(want) < 122


def made_by_joins(df):
    """Rows that the joins of df's plan made, as it ran."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.finalPhysicalPlan())
        below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return sum(map(walk, below)) + (node.metrics().apply("numOutputRows").value() if "Join" in kind else 0)

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_rare_shingles_pair_few_texts_of_a_large_group(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(150)]
    texts = []
    for i in range(300):  # copies of one text with one to eight words changed
        words = base[:]
        for at in rng.sample(range(150), 1 + i % 8):
            words[at] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    near = {(a, b) for b in range(300) for a in range(b) if similarity_of(texts[a], texts[b]) >= 0.8}
    first = {a: a if 1 + a % 8 > 2 else 0 for a in range(300)}  # those with one or two changes are one component
    frame = spark.createDataFrame([(i, first[i], t) for i, t in enumerate(texts)], "th long, comp long, text string")
    sets = common.save(frame.select("th", simhash.shingle_set("text").alias("set")), "sets")
    rows = common.save(simhash._rarest(frame.select("th", "comp"), sets, 0.8), "rarest")
    pairs = simhash._close(rows, 0.8)
    found = {(r.ta, r.tb) for r in pairs.collect()}
    apart = {(a, b) for a, b in near if first[a] != first[b]}
    assert apart and apart <= found and made_by_joins(pairs) < 40 * len(apart)


def test_small_components_need_no_rounds_and_dedup_leaves_one_table(spark, rows, monkeypatch):
    saved, save = [], common.save

    def noted(df, label, *args):
        saved.append((label, out := save(df, label, *args)))
        return out

    monkeypatch.setattr(common, "save", noted)
    edges = [(i, i + 1) for i in range(3000)] + [(-5, -9), (-9, 7000), (1 << 62, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(3001)}, -5: -9, -9: -9, 7000: -9, 1 << 62: 0} and [x for x, _ in saved] == ["cc"]
    saved.clear()
    assert simhash.deduplicate(docs_of(spark, rows)).count() > 0
    there = [label for label, df in saved if os.path.exists(df._scratch_path.removeprefix("file:"))]
    assert there == ["simhash-judged"] and len(saved) > 9


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 301)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def naive_quality(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {p for i, g in enumerate(grams) if many[g] > 1 for p in (i, i + 1, i + 2)}
    held = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(held) - len(set(held)), len(covered)


def test_quality_features_and_cascade(spark, rows):
    more = [(900, "a b c " * 30, "x"), (901, "a a a a a", "x"), (902, "# % one\n\n# % one\n \nlast", "x"), (903, "w\u00a0x y\x0bz \U0001f600 ñ", "x"), (904, "the cat sat on the cat sat", "x"), (905, "a " * 20001, "x"), (906, "### ok " * 60, "x")]
    docs = docs_of(spark, rows + more)
    for r in quality.judge(docs).collect():
        n, chars, symbols, dup, rep = naive_quality(r.text)
        assert (int(r.q_words), r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(100))
    assert quality.keep(docs.limit(0)).count() == 0


def test_keep_skips_the_rules_after_the_first_failing_one(spark, rows, monkeypatch):
    more = [(900, "a b c " * 30, "x"), (902, "# % one\n\n# % one\n \nlast", "x"), (906, "### ok " * 60, "x"), (907, "a b\n" * 40, "x"), (908, "i " * 70, "x"), (909, "x" * 30 + " " + "y " * 60, "x")]
    docs = docs_of(spark, rows + more)
    want = Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert Counter(r.doc_id for r in quality.keep(docs).collect()) == want
    rules = {**quality.BASE, **quality.RULES}
    for names in (list(rules), list(rules)[::-1]):
        assert Counter(r.doc_id for r in docs.where(quality.passes(rules, names, F.col("text"))).collect()) == want
    monkeypatch.setattr(quality, "order", lambda facts: list(rules))
    monkeypatch.setattr(quality, "measured", lambda *a: {})
    monkeypatch.setattr(quality, "_repeated", lambda words: F.raise_error(F.lit("made")).cast("long"))
    assert quality.keep(docs_of(spark, [(i, "few words " * i, "x") for i in range(20)])).count() == 0


def test_cascade_orders_rules_by_rejection_per_cost(spark):
    docs = docs_of(spark, [(i, "word " * 10, "x") for i in range(9)] + [(9, "word " * 80, "x")])
    facts = quality.measured(docs, {"never": "q_words < 0", "few_words": "q_words < 50"})
    assert facts["never"][0] == 0 and facts["few_words"][0] == 0.9 and min(facts["never"][1], facts["few_words"][1]) > 0
    assert quality.order(facts) == ["few_words", "never"]
    assert quality.order({"dear": (0.9, 9000.0), "cheap": (0.5, 10.0), "b": (0.0, 1.0), "a": (0.0, 5.0)}) == ["cheap", "dear", "a", "b"]
    assert quality.measured(docs.limit(0), quality.BASE) == dict.fromkeys(quality.BASE, (0.0, 0.0))
    assert quality.measured(docs, quality.RULES, rows=3).keys() == quality.RULES.keys()


def test_mix_takes_words_near_targets(spark, rows):
    docs = docs_of(spark, rows)
    size = common.n_words(F.col("text"))
    made = mixing.keyed(docs.select("doc_id", "text", "source"), size, mixing.quality(F.col("text"), size))
    got = mixing.mix(made).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = 0
    for rs in by.values():
        whole, target = sum(r._size for r in rs), rs[0].target
        total += target
        assert whole == rs[0].source_size and target <= 2 * whole + 1e-9
        assert abs(sum(r._times * r._size for r in rs) - target) <= max(r._size for r in rs)
        assert all(r._times <= 2 for r in rs)
        order = sorted(rs, key=lambda r: (r._key, r.doc_id is not None, r.doc_id, r._size))
        times = [r._times for r in order if r._size]
        assert times == sorted(times, reverse=True)
    assert abs(total - 1.5 * sum(r._size for r in got)) < 1e-6
    out = mixing.sample(docs)
    assert out.columns == docs.columns and out.count() == sum(r._times for r in got)
    assert mixing.sample(docs.limit(0)).count() == 0


def test_mix_bucket_edges_do_not_matter(spark, rows, monkeypatch):
    docs = docs_of(spark, rows).select("doc_id", "text", "source")
    size = common.n_words(F.col("text"))
    taken = []
    for n in (1, 7, 4096):
        monkeypatch.setattr(mixing, "BUCKETS", n)
        taken.append(Counter((r.doc_id, r._size, r._times) for r in mixing.mix(mixing.keyed(docs, size, F.lit(0.7))).collect()))
    assert taken[0] == taken[1] == taken[2]


def test_jump_hash_moves_rows_only_into_the_new_shard(spark, rows):
    docs = docs_of(spark, rows)
    got = sharding.assign(docs, 16).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want

    def one(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rng = random.Random(2)
    keys = [rng.getrandbits(64) for _ in range(500)]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [one(k, n) for k in keys]
    assert sharding.assign(docs.limit(0), 16).count() == 0


def test_sharding_runs_are_gapless(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RUN", 3)
    slots = defaultdict(list)
    for r in sharding.assign(docs_of(spark, rows), 4).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_writes_each_row_once(spark, rows, tmp_path):
    docs = docs_of(spark, rows)
    sharding.write(docs, str(tmp_path / "out"), 4, partitions=8)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(tokens.permute(np.arange(n), n, 7)) == list(range(n))
    assert tokens.permute(np.arange(500), 500, 1).tolist() != tokens.permute(np.arange(500), 500, 2).tolist()


def test_tokens_round_trip_and_resume(spark, rows, tmp_path):
    docs = docs_of(spark, rows + [(800, "long " * 3000 + "end\n\n  x ", "s"), (801, "<|endoftext|> é\u2003ñ", "s")])
    length = 64
    ordered = common.save(tokens.training_order(tokens.pack(docs, length=length), per_shard=16, length=length), "t")
    got = ordered.collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and sorted(r["index"] for r in got) == list(range(len(got)))
    enc = tokens.encoder(open(tokens.TOKENIZER, "rb").read())
    ids = np.concatenate([np.frombuffer(r.tokens, np.uint16)[: r.n_tokens] for r in sorted(got, key=lambda r: r["index"])])
    ends = np.flatnonzero(ids == tokens.END)
    texts = [enc.decode(ids[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)]
    assert Counter(texts) == Counter(r.text or "" for r in docs.collect())
    tokens.write_shards(ordered, str(tmp_path)).collect()
    by_slot = [r.tokens for r in sorted(got, key=lambda r: r.slot)]
    for start in (0, 5, 16, 31, len(got) - 1):
        assert [x.tobytes() for x in tokens.read_sequences(str(tmp_path), start, length, 16)] == by_slot[start:]
    assert tokens.materialise(docs.limit(0)).count() == 0


def naive_lines(rows, least):
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seqs = [[(i, x, len(WORD.findall(x))) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in docs]
    first, gone = set(), [set() for _ in docs]
    for a, seq in enumerate(seqs):
        for j in range(len(seq)):
            key, words = (), 0
            for n in range(j, len(seq)):
                key, words = (*key, seq[n][1]), words + seq[n][2]
                if key in first and words >= least:
                    gone[a].update(x[0] for x in seq[j : n + 1])
                first.add(key)
    return {d: None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in g) for d, g in zip(docs, gone, strict=True)}


@pytest.mark.parametrize("least", [1, 7, 12, 50])
def test_line_dedup_matches_brute_force(spark, least):
    rng = random.Random(least)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(25)] + ["", "  "]
    made = []
    for i in range(50):
        t = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if made and rng.random() < 0.6:
            s = rng.choice(made)[1].split("\n")
            a = rng.randint(0, len(s))
            t[3:3] = s[a : a + rng.randint(1, 12)]
        made.append((i, "\n".join(t)))
    made += [(100, None), (101, ""), made[5], (None, made[6][1])]
    want = naive_lines(made, least)
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in made], "doc_id long, text string, s string, i string, spans string")
    out = lines.dedup(docs, least)
    assert out.columns == [*docs.columns, "removed_spans", "n_removed"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, want[(d, t)]) for d, t in made)
    assert lines.dedup(docs.limit(0)).count() == 0


def edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return min(row)


def test_decontamination_matches_brute_force(spark, rows):
    rng = random.Random(4)
    items = [(i, rows[i][1][20:140]) for i in range(12)] + [(50, ""), (51, None), (52, "tiny"), (None, rows[20][1][10:120])]
    docs = []
    for n in range(80):
        text, (_, item) = rows[40 + n % 60][1], items[n % 12]
        x = list(item)
        for _ in range(rng.randint(0, 16)):
            at, what = rng.randrange(len(x)), rng.random()
            if what < 0.4:
                x[at] = rng.choice("xyz")
            elif what < 0.7:
                x.insert(at, "q")
            else:
                del x[at]
        docs.append((n, text[:60] + " " + "".join(x).upper() + "\n" + text[60:], "s"))
    docs += [(200, None, "s"), (201, "", "s"), docs[0], (202, f"found {items[-1][1]} here", "s"), (203, "x " * 30_000 + items[0][1] + " y" * 30_000, "s")]
    frame, bench = docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.hits(frame, bench).collect()}
    want = {}
    for i, text, _ in docs:
        for k, item in items[:1] if i == 203 else items:
            norm, body = decontaminate.normal(item), decontaminate.normal(text)
            if norm and body and (d := edits(norm, body)) <= decontaminate.budget(len(norm)):
                want[(i, k)] = d
    assert got == want and len(want) > 20 and (202, None) in want and (203, 0) in want
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in docs if i not in {d for d, _ in want})
    assert decontaminate.hits(frame, bench.limit(0)).count() == 0 and decontaminate.clean(frame.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, rows, monkeypatch):
    frame = docs_of(spark, rows)
    bench = spark.createDataFrame([(i, rows[i][1][:90]) for i in range(10)], "item_id long, text string")
    whole = Counter(map(tuple, decontaminate.hits(frame, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert Counter(map(tuple, decontaminate.hits(frame, bench).collect())) == whole and whole


@pytest.mark.parametrize("block", [512, 2])
def test_chat_keeps_maximal_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(3)
    talks = {}
    for c in range(30):
        if c % 3 and talks:
            base = rng.choice(list(talks.values()))
            talks[c] = base[: rng.randint(1, len(base))] + [("user", f"t{rng.randint(0, 3)}")] * rng.randint(0, 1)
        else:
            talks[c] = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", f"t{rng.randint(0, 4)}"])) for _ in range(rng.randint(1, 7))]
    turns = [(c, 3 * n, r, t, "x") for c, talk in talks.items() for n, (r, t) in enumerate(talk)]
    turns += turns[:5] + [(None, 0, "user", "no id", "x"), (99, None, "user", "no turn", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, ord string")
    talks |= {None: [("user", "no id")], 99: [("user", "no turn")]}
    keep = {}
    for c, talk in talks.items():
        longer = any(o != c and other[: len(talk)] == talk and (len(other) > len(talk) or (o is not None and c is not None and o < c)) for o, other in talks.items())
        if not longer:
            keep[c] = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in talk)
    got = defaultdict(str)
    for r in sorted(chat.render(frame).collect(), key=lambda r: r.part):
        got[r.conv_id] += r.text
        assert r.n_turns == len(talks[r.conv_id])
    assert dict(got) == keep
    assert chat.render(frame.limit(0)).count() == 0


def test_url_rules_of_many_shapes_and_clashing_columns(spark):
    rules = [(f"h{n}.org", "/" + "p" * n, "block") for n in range(300)] + [("a.b.c.org", "", "block"), ("org", "/q", "allow")]
    made = [(n, f"http://x.h{n}.org/" + "p" * (n + 1)) for n in range(300)] + [(300, "http://z.a.b.c.org"), (301, "http://org/q"), (302, None), (303, "http://h7.org/pp")] + [(304, "http://h9.org/" + "p" * 9)] * 200
    names = "page_id long, url string, b string, p string, s string, r string, digest string, host string, b_host string, labels string"
    pages = spark.createDataFrame([(*m, *"12345678") for m in made], names)
    got = urls.judge(pages, urls.rule_table(spark, rules))
    assert got.columns == ["page_id", "url", "b", "p", "s", "r", "digest", "b_host", "labels", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(made) and all((r.b, r.p, r.labels) == ("1", "2", "8") for r in rows)
    want = {n: (f"h{n}.org/" + "p" * n, "block") for n in range(300)} | {300: ("a.b.c.org", "block"), 301: ("org/q", "allow"), 302: (None, "allow"), 303: (None, "allow"), 304: ("h9.org/" + "p" * 9, "block")}
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == want


def test_mix_with_clashing_columns_and_null_ids(spark):
    names = "doc_id long, text string, source string, target string, done string, cut string, epochs string, source_size string, b string, _r string, r string"
    docs = spark.createDataFrame([(None, f"w{i} " * (1 + i % 7), "ab"[i % 2], *"1234567" , "8") for i in range(60)], names)
    out = mixing.sample(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {tuple("12345678")}
    size = common.n_words(F.col("text"))
    made = mixing.mix(mixing.keyed(docs, size, F.lit(1.0)))
    assert made.columns[:3] == ["doc_id", "text", "source"] and made.count() == 60
    assert made.select("_key").distinct().count() > 50


def test_sharding_opens_a_row_of_many_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 4)
    docs = spark.createDataFrame([(1, "x")] * 23 + [(None, None)] * 9, "doc_id long, text string")
    got = sharding.assign(docs, 3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 32 and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    return duckdb.connect()


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_quality_rules", "op8_chat", "op9_url_filter"])
def test_queries_match_their_sql(spark, duck, tmp_path, name, rows):
    from sparkloom.llm import queries

    long = [(1000, n, "user" if n % 2 else None, f"t{n}") for n in range(1200)] + [(1001, n, "user" if n % 2 else None, f"t{n}") for n in range(700)]
    ties = [(1002, None, "a", f"u{n}") for n in range(600)] + [(None, 1, "x", None), (None, None, None, "")]
    tables = {
        "documents": docs_of(spark, rows + [(None, None, None), (None, "a b c " * 40, "sA"), (700, "one\n" * 60, "sB")]).select("doc_id", "text", "lang", "source", "n_chars"),
        "pages": spark.createDataFrame([(i, u, "") for i, u in enumerate(["http://A.example.com/en/77?x", "http://com/en/", "http://x.org/es", "http://d.example.net/de/8/1", None, "", "x://a.com/en/b://c.org/es/"] * 3)] + [(None, "http://net/de/9", "")], "page_id long, url string, html string"),
        "conversations": spark.createDataFrame(long + ties + long[:9], "conv_id long, turn long, role string, text string"),
    }
    for k, df in tables.items():
        df.write.parquet(str(tmp_path / f"{k}.parquet"))
        duck.execute(f"create or replace view {k} as select * from read_parquet('{tmp_path}/{k}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(queries.ORACLES[name]).fetchall()
    columns = [d[0] for d in duck.description]
    key = repr
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key) and want


def test_url_rules(spark):
    made = ["http://A.example.com/en/77?x=/de/", "https://example.com/en/7", "http://com/en/", "http://notcom/en/", "http://x.org/es", "http://x.org/es/#q", "http://d.example.net/de/8/1", "http://net/de/9", None, "", "no scheme/en/", "ftp://", "http://h.com:80/en/", "x://a.com/en/b://c.org/es/", "http://" + "a." * 3000 + "com/en/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*made, made[0]])] + [(None, made[1], "h", "p")], "page_id long, url string, host string, path string")
    got = urls.judge(pages, urls.rule_table(spark)).collect()
    assert len(got) == len(made) + 2
    for r in got:
        tail = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        host = re.split(r"[/?#]", tail)[0]
        path = re.split(r"[?#]", tail[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (max(fit)[1:] if fit else (None, "allow"))
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark, urls.RULES).limit(0)).collect()} == {"allow"}


def test_pii_surrogates(spark):
    rows = [
        (1, "Write to Jane.Doe@mail.example.com or jane.doe@MAIL.example.com, call +1 (499) 555-6503 now."),
        (2, 'ip 8.196.197.208 and 233.233.171.252, card 4111 1111 1111 1111; token = "1eb9c654e721b4f812088970e66a6345cee33dd6"###'),
        (3, "Mr. John Smith met Frau Müller and Mr John Smith. Госпожа Иванова ssn 123-45-6789 call 555-123-4567."),
        (4, None), (5, ""), (6, "clean text 12 3.4.5 2024-01-02 v1.2.3 and 999.1.1.1"), (7, "call +1 (499) 555-6503"), (7, "call +1 (499) 555-6503"), (8, "card 4111111111111111"),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, m string, th string")
    out = pii.replace(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].n_entities for i in range(1, 9)] == [3, 4, 6, 0, 0, 0, 1, 1]
    mails = re.findall(r"\S+@example\.org", got[1].text)
    assert len(mails) == 2 and mails[0] == mails[1].rstrip(",") and "Doe" not in got[1].text
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)[0]
    assert phone in got[7].text and "499" not in phone
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", got[2].text)
    assert len(set(ips)) == 2 and all(0 <= int(p) <= 255 for ip in ips for p in ip.split("."))
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", got[2].text)[1].replace(" ", "")
    assert f"card {card}" == got[8].text and card != "4111111111111111"
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert re.search(r'"[0-9a-f]{40}"###', got[2].text) and "1eb9c654" not in got[2].text
    men = re.findall(r"Mr\.? (\w+ \w+)", got[3].text)
    assert men[0] == men[1] and men[0].split()[0] in pii.GIVEN["m"]
    assert re.search(r"Госпожа [А-Я][а-я]+ ssn \d{3}-\d{2}-\d{4} call \d{3}-\d{3}-\d{4}\.", got[3].text) and "Müller" not in got[3].text
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1]
    assert pii.replace(docs.limit(0)).count() == 0


def test_pii_screen_finds_what_the_whole_pattern_finds(spark):
    rng = random.Random(6)
    bits = ["a.b@c.org", "@", "x@y", "Mr. Adam Smith", "Frau Ëva", "Mrs", "Госпожа Иванова", "10.0.0.1", "999.1.1.1", "+1 555 123 4567", "555-123-4567", "123-45-6789", "4111 1111 1111 1111", "deadbeef" * 4, "abcdef12" * 5, "plain", "\u0663\u0664", "7", "\n", "é"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pii.ALL), F.lit(0))
    rows = df.select("text", pii.matches(F.col("text")).alias("got"), whole.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(len(r.want) for r in rows) > 400


def test_pii_collisions_are_drawn_again(spark, monkeypatch):
    kinds, draw = pii.surrogate, F.col("draw")
    monkeypatch.setattr(pii, "surrogate", lambda k, c, d, key=pii.KEY: F.when(d == 0, F.lit("same")).when((d == 1) & (c == "b"), F.lit("a")).otherwise(F.concat(c, d.cast("string"))))
    found = spark.createDataFrame([("x", c) for c in "abcd"], "kind string, canon string")
    odd = {r.canon: r.draw for r in pii.exceptions(found).collect()}
    assert odd == {"b": 2, "c": 1, "d": 1}
    assert kinds is not pii.surrogate and draw is not None


def test_pii_full_domains_are_permuted(spark, monkeypatch):
    monkeypatch.setattr(pii, "DRAWS", 2)
    docs = spark.range(1001).select(F.col("id").alias("doc_id"))
    dense = docs.withColumn("text", F.when(F.col("doc_id") < 1000, F.format_string("call +1 %d %02d now", F.expr("cast(doc_id div 100 as int)"), F.expr("cast(doc_id % 100 as int)"))))
    got = {r.doc_id: r.text for r in pii.replace(dense).collect()}
    was = {r.doc_id: r.text for r in dense.collect()}
    assert got[1000] is None and len({got[i] for i in range(1000)}) == 1000
    assert all(re.fullmatch(r"call \+1 \d \d\d now", got[i]) for i in range(1000)) and not any(got[i] == was[i] for i in range(1000))


def test_pii_names_grow_with_draws(spark):
    names = spark.createDataFrame([("name", "f:Anna Smith", d) for d in range(9)] + [("name", "mc:Петров", d) for d in range(9)], "kind string, canon string, draw int")
    got = [r.s for r in names.select(pii.surrogate(F.col("kind"), F.col("canon"), F.col("draw")).alias("s")).collect()]
    assert len(set(got)) == 18 and len(got[8]) > len(got[0]) and len(got[17]) > len(got[9])


def test_pii_exceptions_reach_the_text(spark, monkeypatch):
    real = spark.createDataFrame([("ipv4", "1.2.3.4", 1)], "kind string, canon string, draw int")
    docs = spark.createDataFrame([(1, "at 1.2.3.4 now"), (2, "at 1.2.3.5 now"), (3, None)], "doc_id long, text string")
    plain = {r.doc_id: r.text for r in pii.replace(docs).collect()}
    assert plain == {r.doc_id: r.text for r in pii.replace(docs).collect()}
    monkeypatch.setattr(pii, "exceptions", lambda *a: real)
    moved = {r.doc_id: r.text for r in pii.replace(docs).collect()}
    assert plain[2] == moved[2] and plain[1] != moved[1] and plain[3] is moved[3] is None


def test_pii_distinct_numbers_stay_distinct(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("call 555-%03d-%04d ip 10.0.%d.%d", F.expr("cast(id div 100 as int)"), F.col("id"), F.expr("cast(id div 200 as int)"), F.expr("cast(id % 200 as int)")).alias("text"))
    texts = [r.text for r in pii.replace(docs).collect()]
    assert len({t.split()[1] for t in texts}) == len({t.split()[3] for t in texts}) == 3000


def test_pipeline_against_plain_python(spark, rows, tmp_path):
    import corpus_pipeline

    body = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    bench = [(1, rows[10][1][30:130])]
    spark.createDataFrame(body, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in body if (q := naive_quality(r[1]))[0] >= 50 and 100 * q[4] <= 50 * q[0] and 10 * q[2] <= 3 * q[0] and 2 * q[0] <= q[1] <= 25 * q[0]]
    texts = sorted({r[1] for r in kept})
    bits, top = {t: simhash.fingerprint(t) for t in texts}, {t: t for t in texts}
    for n, t in enumerate(texts):  # the stage links at 3 bits or at a similarity of 0.8
        for u in texts[:n]:
            if top[t] != top[u] and ((bits[t] ^ bits[u]).bit_count() <= 3 or similarity_of(t, u) >= 0.8):
                top = {x: top[u] if y == top[t] else y for x, y in top.items()}
    best = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0])):
        best.setdefault(top[r[1]], r)
    clean = [r for r in best.values() if edits(decontaminate.normal(bench[0][1]), decontaminate.normal(r[1])) > 10]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, str(tmp_path)), name)
        seen.append(Counter((r.doc_id, r.text) for r in docs.collect()) if "text" in docs.columns else docs.collect())
    assert seen[0] == Counter((r[0], r[1]) for r in kept)
    assert seen[1] == Counter((r[0], r[1]) for r in best.values())
    assert seen[2] == Counter((r[0], r[1]) for r in clean) and len(clean) < len(best)
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 2
    enc = tokens.encoder(open(tokens.TOKENIZER, "rb").read())
    ids = np.concatenate([np.frombuffer(r.tokens, np.uint16)[: r.n_tokens] for r in sorted(seen[4], key=lambda r: r["index"])])
    ends = np.flatnonzero(ids == tokens.END)
    texts = Counter(enc.decode(ids[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True))
    assert texts == Counter(t for (_, t), n in seen[3].items() for _ in range(n))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
