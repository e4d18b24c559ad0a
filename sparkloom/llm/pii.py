"""PII surrogates, in SQL expressions only.

One pattern finds all entities; a text is split at its matches, every match is replaced by a surrogate of its own
type and put back, so surrogates are never searched again. Digit entities go through a keyed Feistel network on
their digits (a permutation, so other numbers get other surrogates) and keep their layout; IPv4 addresses permute
32 bits; cards keep whether their check digit holds; e-mails, secrets and names come from a keyed hash. Names keep
their title, its gender and their script.

Collision checks: over the distinct entities of the whole corpus, a surrogate that is also a real entity, or that two
entities share, is drawn again (all but the first owner) until none is left; domains too full for that are permuted as
a whole. Only these exceptions are joined back, by text; the rest needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

KEY, DRAWS, DENSE, BROADCAST_TEXTS = "surrogates", 20, 8, 10_000

# Entity patterns (Java), titles by gender and script, given names and name syllables.
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z][A-Za-z0-9-]*+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|(?<![\d(+])\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
CARD = r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])"
TITLES = {"m": ["Mr", "Herr", "Señor", "Monsieur"], "f": ["Mrs", "Ms", "Frau", "Señora", "Madame"], "mc": ["Господин"], "fc": ["Госпожа"]}
NAME = r"(?<![\p{L}])(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? \p{Lu}[\p{Ll}'-]++(?: \p{Lu}[\p{Ll}'-]++)?"
GIVEN = {"m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo"], "f": ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga"], "mc": ["Антон", "Борис", "Виктор", "Денис"], "fc": ["Анна", "Вера", "Дарья", "Елена"]}
SYLLABLES = {"m": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu", "han"], "mc": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "зу", "хан"]}

ALL = "|".join(f"(?:{x})" for x in (EMAIL, NAME, IPV4, SECRET, PHONE, SSN, CARD))
NO_EMAIL = "|".join(f"(?:{x})" for x in (NAME, IPV4, SECRET, PHONE, SSN, CARD))


def kind_of(m: Column) -> Column:
    """Type of a match of ALL."""
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(r"^\p{L}+\.? \p{Lu}"), "name").when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ipv4")
        .when(m.rlike(r"^(?=.*[a-f])[0-9a-f]{32,64}$"), "secret").when(m.rlike(rf"^(?:{PHONE})$"), "phone").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").otherwise("card")
    )


def canon_of(kind: Column, m: Column) -> Column:
    """What two mentions of one entity share: e-mails without case, numbers and addresses by their value, names without title."""
    octets = F.array_join(F.transform(F.split(m, r"\."), lambda x: x.cast("int").cast("string")), ".")
    return (
        F.when(kind == "email", F.lower(m)).when(kind == "ipv4", octets).when(kind == "secret", m)
        .when(kind == "name", F.concat(gender_of(m), F.lit(":"), F.regexp_replace(m, r"^\p{L}+\.? ", "")))
        .when(kind == "phone", F.concat(F.regexp_extract(m, r"^(\+\d{1,3})?", 0), F.lit("|"), F.regexp_replace(F.regexp_replace(m, r"^\+\d{1,3}", ""), r"\D", "")))
        .otherwise(F.regexp_replace(m, r"\D", ""))
    )


def gender_of(m: Column) -> Column:
    title = F.regexp_extract(m, r"^\p{L}+", 0)
    return reduce(lambda acc, g: acc.when(title.isin(TITLES[g]), g), ("f", "mc", "fc"), F.when(title.isin(TITLES["m"]), "m"))


def _number(*parts: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _feistel(digits: Column, salt: Column) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 34): four rounds on two halves."""

    def step(r: int):
        def run(p: Column) -> Column:
            size = F.length(p.a)
            moved = F.lpad(F.pmod(p.a.cast("long") + F.pmod(_number(salt, F.lit(str(r)), p.b), _power(size)), _power(size)).cast("string"), size, "0")
            return F.struct(p.b.alias("a"), moved.alias("b"))

        return run

    half = F.floor(F.length(digits) / 2).cast("int")
    state = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, F.length(digits)).alias("b"))
    for r in range(4):
        state = let(state, step(r))
    return let(state, lambda p: F.concat(p.a, p.b))


def _ip(canon: Column, salt: Column) -> Column:
    parts = F.transform(F.split(canon, r"\."), lambda x: x.cast("long"))
    state = let(parts, lambda p: F.struct((p[0] * 256 + p[1]).alias("a"), (p[2] * 256 + p[3]).alias("b")))

    def step(r: int):
        return lambda p: F.struct(p.b.alias("a"), F.pmod(p.a + F.pmod(_number(salt, F.lit(str(r)), p.b.cast("string")), F.lit(65536)), F.lit(65536)).alias("b"))

    for r in range(4):
        state = let(state, step(r))
    return let(state, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p.a / 256), F.pmod(p.a, F.lit(256)), F.floor(p.b / 256), F.pmod(p.b, F.lit(256)))]))


def luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule over digits, the last one counted once."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x)


def _card(canon: Column, salt: Column) -> Column:
    """All but the last digit permuted; the last set so that the check sum's remainder stays as it was."""
    head = F.substring(canon, F.lit(1), F.length(canon) - 1)
    new = let(_feistel(head, salt), lambda h: F.struct(h.alias("h"), F.pmod(luhn_sum(canon) - luhn_sum(F.concat(h, F.lit("0"))), F.lit(10)).alias("d")))
    return let(new, lambda x: F.concat(x.h, x.d.cast("string")))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _person(canon: Column, salt: Column, draw: Column) -> Column:
    """A surname of six syllables and one more a draw, up to twelve, after a given name of the gender where the name has two words."""

    def made(g: str, n: Column) -> Column:
        syl = SYLLABLES["mc" if g.endswith("c") else "m"]
        more = [F.when(draw > k - 6, _pick(syl, F.shiftrightunsigned(n, 8 + 4 * k))).otherwise("") for k in range(6, 12)]
        sur = F.initcap(F.concat(*[_pick(syl, F.shiftrightunsigned(n, 8 + 4 * k)) for k in range(6)], F.when(draw == 0, "").otherwise(F.concat(*more))))
        return F.when(F.contains(canon, F.lit(" ")), F.concat(_pick(GIVEN[g], n), F.lit(" "), sur)).otherwise(sur)

    g = F.substring_index(canon, ":", 1)
    return let(_number(salt, canon), lambda n: F.concat(g, F.lit(":"), reduce(lambda acc, x: acc.when(g == x, made(x, n)), ("f", "mc", "fc"), F.when(g == "m", made("m", n)))))


def surrogate(kind: Column, canon: Column, draw: Column, key: str = KEY) -> Column:
    """Surrogate of an entity in canonical form; draw 0 unless the collision check asked for another."""
    salt = F.concat(F.lit(key + "/"), kind, F.lit("/"), draw.cast("string"))
    mail = F.concat(F.lit("user"), F.substring(F.sha2(F.concat(salt, canon), 256), 1, 12), F.lit("@example.org"))
    prefix, rest = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
    return (
        F.when(kind == "email", mail).when(kind == "secret", F.substring(F.sha2(F.concat(salt, canon), 256), F.lit(1), F.length(canon)))
        .when(kind == "ipv4", _ip(canon, salt)).when(kind == "name", _person(canon, salt, draw))
        .when(kind == "phone", F.concat(prefix, F.lit("|"), _feistel(rest, salt))).when(kind == "ssn", _feistel(canon, salt)).otherwise(_card(canon, salt))
    )


def layout(kind: Column, m: Column, made: Column) -> Column:
    """The surrogate in the layout of the mention: its separators, prefix and title."""

    def fill(body: Column, digits: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        done = F.aggregate(F.split(body, ""), start, lambda acc, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(acc.out, F.substring(digits, acc.at, F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc.out, c).alias("out"), acc["at"].alias("at"))))
        return done.out

    phone = F.concat(F.substring_index(made, "|", 1), fill(F.regexp_replace(m, r"^\+\d{1,3}", ""), F.substring_index(made, "|", -1)))
    name = F.concat(F.regexp_extract(m, r"^\p{L}+\.? ", 0), F.substring_index(made, ":", -1))
    return F.when(kind.isin("email", "secret", "ipv4"), made).when(kind == "name", name).when(kind == "phone", phone).otherwise(fill(m, made))


def _screened(text: Column, with_pattern, none: Column) -> Column:
    """with_pattern(the alternatives that can match at all): an e-mail has an @, every other kind but a name an ASCII digit, a
    name a title. These signs are looked for by plain search, so most texts never meet a pattern; the matches are those of ALL.
    """
    titled = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for ts in TITLES.values() for t in ts])
    return F.when(F.contains(text, F.lit("@")), with_pattern(ALL)).when(F.rlike(text, F.lit("[0-9]")), with_pattern(NO_EMAIL)).when(titled, with_pattern(NAME)).otherwise(none)


def matches(text: Column) -> Column:
    return _screened(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.array().cast("array<string>"))


def entities(docs: DataFrame) -> DataFrame:
    """(kind, canon): distinct entities of the corpus."""
    m = docs.select(F.explode(matches(F.col("text"))).alias("m")).distinct().withColumn("kind", kind_of(F.col("m")))
    return m.select("kind", canon_of(F.col("kind"), F.col("m")).alias("canon")).distinct()


def domain_of(kind: Column, canon: Column) -> Column:
    """What the permutation of a kind maps onto itself: prefix and number of digits; null for surrogates drawn from a hash."""
    rest = F.concat(F.substring_index(canon, "|", 1), F.lit("|"), F.length(F.substring_index(canon, "|", -1)).cast("string"))
    return F.when(kind == "phone", rest).when(kind == "ipv4", F.lit("all")).when(kind.isin("ssn", "card"), F.length(canon).cast("string"))


def exceptions(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, draw) of the entities whose first surrogate is a real entity or another one's surrogate.

    A domain so full of real entities that DRAWS draws leave some on one of them (say all numbers of three digits) cannot
    avoid them. All its entities then take one common draw, a permutation of the domain, so they stay distinct; of
    DENSE such draws it is the first that leaves none in its place, else the last. Names get longer with later draws.
    """
    kind, canon, domain = F.col("kind"), F.col("canon"), domain_of(F.col("kind"), F.col("canon"))
    now = found.withColumns({"draw": F.lit(0), "made": surrogate(kind, canon, F.lit(0), key), "settled": F.lit(False)})
    now = common.save(now, "pii-made")
    real = found.select("kind", F.col("canon").alias("made"))
    for n in range(10 * DRAWS):
        live = now.where("not settled")
        owner = live.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("draw", "canon")).alias("f")).where("n > 1")
        shared = live.join(owner, ["kind", "made"]).where(F.struct("draw", "canon") > F.col("f")).select("kind", "canon")
        bad = common.save(shared.unionByName(live.join(real, ["kind", "made"], "left_semi").select("kind", "canon")).distinct().withColumn("again", F.lit(1)), "pii-bad")
        if bad.isEmpty():
            return now.where("draw > 0").select("kind", "canon", "draw")
        if n >= DRAWS and not bad.where(domain.isNotNull()).isEmpty():
            full = common.save(bad.where(domain.isNotNull()).select("kind", domain.alias("domain")).distinct(), "pii-full")
            stays = [F.count(F.when(surrogate(kind, canon, F.lit(DRAWS + d), key) == canon, 1)) for d in range(DENSE)]
            pick = F.coalesce(*[F.when(c == 0, F.lit(DRAWS + d)) for d, c in enumerate(stays[:-1])], F.lit(DRAWS + DENSE - 1))
            placed = now.withColumn("domain", domain)
            picks = common.save(placed.join(full, ["kind", "domain"], "left_semi").groupBy("kind", "domain").agg(pick.alias("pick")), "pii-picks")
            nxt = placed.join(picks, ["kind", "domain"], "left")
            now = common.save(nxt.select("kind", "canon", F.coalesce("pick", "draw").alias("draw"), "made", F.col("pick").isNotNull().alias("settled")), "pii-made")
            continue
        nxt = now.join(bad, ["kind", "canon"], "left").withColumn("draw", F.col("draw") + F.coalesce("again", F.lit(0)))
        nxt = nxt.withColumn("made", F.when(F.col("again") == 1, surrogate(kind, canon, F.col("draw"), key)).otherwise(F.col("made")))
        now = common.save(nxt.drop("again"), "pii-made")
    raise RuntimeError("surrogates still collide")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced and n_entities added or replaced.

    Null texts stay null, empty ones empty; both have no entities. Repeated rows, and one entity in many documents,
    get the same surrogates. Very long texts are searched whole. Other columns, of any name, stay. Empty input gives
    no rows.
    """
    docs = docs.drop("n_entities")
    odd = common.save(exceptions(entities(docs), key), "pii-odd")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), F.xxhash64("text").alias("th"))
    none = F.create_map().cast("map<string,int>")
    if not odd.isEmpty():
        each = docs.select(F.xxhash64("text").alias("th"), F.explode(matches(F.col("text"))).alias("m")).withColumn("kind", kind_of(F.col("m")))
        each = each.select("th", "kind", canon_of(F.col("kind"), F.col("m")).alias("canon")).distinct().join(odd, ["kind", "canon"])
        some = common.save(each.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "draw"))).alias("draws")), "pii-draws")
        if some.count() <= BROADCAST_TEXTS:
            some = F.broadcast(some)
        packed = packed.join(some, "th", "left")
    else:
        packed = packed.withColumn("draws", F.lit(None).cast("map<string,int>"))
    draws = F.coalesce("draws", none)

    def one(m: Column) -> Column:
        def typed(x: Column) -> Column:
            made = surrogate(x.k, x.c, F.coalesce(F.try_element_at(draws, F.concat_ws(":", x.k, x.c)), F.lit(0)), key)
            return layout(x.k, m, made)

        return let(let(kind_of(m), lambda k: F.struct(k.alias("k"), canon_of(k, m).alias("c"))), typed)

    text = F.col("r.text")
    found = packed.withColumn("m", matches(text))
    parts = _screened(text, lambda p: F.split(text, p, -1), F.array(text))
    new = F.array_join(F.concat(F.transform(F.arrays_zip(F.slice(parts, F.lit(1), F.size("m")).alias("p"), F.col("m").alias("e")), lambda z: F.concat(z.p, one(z.e))), F.slice(parts, -1, 1)), "")
    text_new = F.when(F.size("m") == 0, text).otherwise(new)
    return found.select(*[text_new.alias(c) if c == "text" else F.col(f"r.`{c}`").alias(c) for c in docs.columns], F.size("m").cast("long").alias("n_entities"))


def op10(spark, sf_dir: str) -> DataFrame:
    return replace(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
