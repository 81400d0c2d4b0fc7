"""Surrogates for personal data and secrets. DataFrame functions only.

Entities are found by one pattern. Each gets a keyed replacement of its own type and format: numbers keep their grouping, card
and account numbers valid check digits, dates stay dates, names keep their title's gender and script, secrets their alphabet. A
surrogate depends on the key and the normal form of the entity alone, so all mentions of one entity agree wherever they stand;
where a text names somebody with a title, the same name without one is replaced too. All distinct entities of the table are
checked against each other: where two would get one surrogate, or a surrogate is an entity itself, all but the first are drawn
again until none are left. Groups of the patterns that repeat are possessive, so texts of any length need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, free

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE = ["Mr", "Herrn?", "Monsieur", "Señor", "Sir", "господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Fräulein", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof", "Professor", "Professeur", "Doctor", "Docteur", "Doktor", "доктор", "профессор"]
TITLE = rf"(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? ){{1,2}}"
#: One part of a name: Smith, O'Neil, Smith-Jones, but not the end of Smith's.
PART = r"(?:\p{Lu}\p{L}*+(?:['’-]\p{L}{2,})++|\p{Lu}\p{L}++)"
BORN = r"(?i:born(?: on)?|date of birth|dob|geboren(?: am)?|geb\.|née? le|nacid[oa] el|fecha de nacimiento)"
SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
#: The entity types with their patterns; where several match, the first wins.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": rf"(?<!\w){SECRET}\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[_/+.~-]*[A-Za-z0-9])[\w/+.~-]{{6,}}[\"']?",
    "key": r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{20,}+-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "jwt": r"(?<!\w)eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+",
    "bearer": r"(?<!\w)(?i:bearer) {1,3}(?=[/+.~_-]*+[A-Za-z]*+\d)[\w/+.~-]{16,}+",
    "born": rf"(?<!\w){BORN}[: ]{{1,3}}(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})(?!\d)",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ip6": r"(?<![\w:])(?=[0-9A-Fa-f:]{2,39}+(?![\w:]))(?=[A-Fa-f:]*+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|0[1-9](?:[ .-]\d{2}){4}|(?:\(0\d{2,4}\) ?|0\d{2,4}[ /-])\d{3,4}[ -]?\d{3,5}|\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<!\w){TITLE}{PART}(?: {PART})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these holds no entity; keys may be letters alone.
HINT = rf"[0-9@]|{SECRET}|{TITLE}|A(?:KIA|SIA)|eyJ|-----BEGIN"
HEX, LETTERS = "0123456789abcdef", "bcdfghjklmnpqrst"
LATIN = [c + v for c in "bdklmnrt" for v in "ae"]
CYRILLIC = [c + v for c in "бдклмнрт" for v in "ае"]
MAX_LITERAL = 5000
#: The attempt from which on a secret's surrogate is longer than the secret, and the one from which on a number has an extension.
GROW, EXTEND = 4, 24


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _chars(s: Column) -> Column:
    return F.sequence(F.lit(1), F.char_length(s))


def _luhn(digits: Column) -> Column:
    """Sum of the digits by Luhn's rule."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    at = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    return F.aggregate(F.transform(_chars(digits), lambda i: F.when(i % 2 == 0, twice(at(i))).otherwise(at(i))), F.lit(0), lambda a, x: a + x)


def _mod97(account: Column) -> Column:
    """The account number modulo 97, its first four characters moved to the end and letters read as 10 to 35; 1 when its check digits are right."""
    moved = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))
    at = lambda i: F.substring(moved, i, F.lit(1))
    step = lambda a, i: F.when(at(i).rlike("[A-Z]"), (a * 100 + F.ascii(at(i)) - 55) % 97).otherwise((a * 10 + at(i).try_cast("int")) % 97)
    return F.aggregate(_chars(moved), F.lit(0), lambda a, i: step(a, i).cast("int"))


def _kind(m: Column) -> Column:
    """The type of a mention; null for what the pattern finds but a check refuses."""
    return (
        F.when(m.rlike(rf"^{SECRET}\s*[=:]"), "secret")
        .when(m.startswith("-----BEGIN"), "pem")
        .when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key")
        .when(m.startswith("eyJ"), "jwt")
        .when(m.rlike("^(?i:bearer) "), "bearer")
        .when(m.rlike(rf"^{BORN}[: ]"), "born")
        .when(m.rlike(rf"^{TITLE}"), "name")
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$") & ~m.rlike(r"^0[1-9]\."), "ip")
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ip6")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d\d"), "iban")
        .when(m.rlike(r"^(?:[+(]|\d{3}-\d{3}-\d{4}$|0\d{1,4}[ ./-])"), "phone")
        .when(_luhn(_digits(m)) % 10 == 0, "card")
    )


#: What stands before a value, the value, and what closes it.
_VALUE = rf"^({SECRET}\s*[=:]\s*[\"']?|(?i:bearer) +|{BORN}[: ]+)(.*?)([\"']?)$"


def _normal(kind: Column, m: Column) -> Column:
    """What all mentions of one entity have in common."""
    said = lambda titles: m.rlike(rf"^(?:\S+ )?(?:{'|'.join(titles)})\.? ")
    gender = F.when(said(MALE), "m:").when(said(FEMALE), "f:").otherwise("n:")
    date = F.regexp_extract(m, _VALUE, 2)
    iso = date.rlike(r"^\d{4}-")
    said_ = lambda i: F.regexp_extract(date, r"^(\d+)[./-](\d+)[./-](\d+)$", i)
    two = lambda i: F.lpad(said_(i), 2, "0")
    return (
        F.when(kind.isin("card", "phone", "ssn"), _digits(m))
        .when(kind.isin("email", "ip6"), F.lower(m))
        .when(kind.isin("secret", "bearer"), F.regexp_extract(m, _VALUE, 2))
        .when(kind == "born", F.when(iso, date).otherwise(F.concat_ws("-", said_(3), two(2), two(1))))
        .when(kind == "iban", F.replace(m, F.lit(" ")))
        .when(kind == "name", F.concat(gender, F.lower(F.regexp_replace(m, rf"^{TITLE}", ""))))
        .otherwise(m)
    )


def _shape(s: Column, stream: Column) -> Column:
    """``s`` with each digit and letter drawn anew; case and all other characters stay."""

    def one(i: Column) -> Column:
        c, h = F.substring(s, i, F.lit(1)), F.substring(stream, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))
        letter = F.translate(h, HEX, LETTERS)
        digit = (F.conv(F.substring(stream, F.pmod((i - 1) * 3, F.lit(125)) + 1, F.lit(4)), 16, 10).cast("int") % 10).cast("string")  # of 65,536 each has its tenth
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _more(stream: Column, attempt: Column, hexadecimal: Column) -> Column:
    """What a secret gains from its GROW-th attempt on, so that a short alphabet doesn't bound the surrogates."""
    extra = F.substring(F.repeat(stream, (attempt / 128).cast("int") + 1), F.lit(1), F.greatest(attempt - (GROW - 1), F.lit(0)))
    return F.when(hexadecimal, extra).otherwise(F.translate(extra, HEX, LETTERS))


def _syllables(stream: Column, table: list[str], start: int, n: int) -> Column:
    """n syllables, each picked by one hex digit."""
    table_ = F.array(*map(F.lit, table))
    return F.concat(*(F.element_at(table_, (F.conv(F.substring(stream, start + i, 1), 16, 10).cast("int") + 1)) for i in range(n)))


def _name(norm: Column, key: str, attempt: Column) -> Column:
    """Each part of a name drawn by itself, so that relatives share what they shared; endings follow gender and script."""
    gender = F.substring(norm, 1, 1)
    male = gender == "m"

    def part(t: Column) -> Column:
        stream = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("name"), t, attempt.cast("string")), 256)
        cyrillic = t.rlike(r"\p{IsCyrillic}")
        ending = F.when(cyrillic, F.when(male, "н").when(gender == "n", "ко").otherwise("на")).otherwise(F.when(male, "n").when(gender == "n", "nis").otherwise("na"))
        # a syllable more for each attempt, so that there is no last name
        longer = F.substring(F.repeat(stream, (attempt / 32).cast("int") + 1), F.lit(6), attempt)
        table = F.when(cyrillic, F.array(*map(F.lit, CYRILLIC))).otherwise(F.array(*map(F.lit, LATIN)))
        pick = lambda i: F.element_at(table, F.conv(F.substring(longer, i, F.lit(1)), 16, 10).cast("int") + 1)
        more = F.when(attempt > 0, F.array_join(F.transform(_chars(longer), pick), "")).otherwise("")
        return F.initcap(F.concat(F.when(cyrillic, _syllables(stream, CYRILLIC, 1, 5)).otherwise(_syllables(stream, LATIN, 1, 5)), more, ending))

    return F.array_join(F.transform(F.split(F.substring(norm, F.lit(3), F.char_length(norm)), " "), part), " ")


def _core(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """The surrogate in normal form."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 512)
    rest = lambda n: F.substring(norm, F.lit(n), F.char_length(norm))
    octet = lambda at: F.conv(F.substring(stream, at, 2), 16, 10)
    card = F.concat(F.substring(norm, 1, 1), _shape(F.substring(norm, F.lit(2), F.char_length(norm) - 2), stream))
    digit = F.pmod(-_luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string")
    tld = F.regexp_extract(norm, r"([^.@]+)$", 1)
    account = F.concat(F.substring(norm, 1, 2), F.lit("00"), _shape(rest(5), stream))
    checked = F.concat(F.substring(account, 1, 2), F.lpad((98 - _mod97(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.char_length(account)))
    unit = lambda at, n: F.conv(F.substring(stream, at, 6), 16, 10).cast("int") % n
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    born = F.concat_ws("-", (F.substring(norm, 1, 3).try_cast("int") * 10 + unit(1, 10)).cast("string"), two(1 + unit(7, 12)), two(1 + unit(13, 28)))
    block = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(stream, i * 4 + 1, F.lit(4))), ":")
    numbers = (
        F.when(kind == "card", F.concat(card, digit))
        .when(kind == "phone", F.concat(F.substring(norm, 1, 1), _shape(rest(2), stream)))
        .when(kind == "ssn", F.concat(F.lit("9"), _shape(rest(2), stream)))
        .when(kind == "iban", F.when(_mod97(norm) == 1, checked).otherwise(F.concat(F.substring(norm, 1, 2), _shape(rest(3), stream))))
        .when(kind == "ip", F.concat_ws(".", (240 + F.conv(F.substring(stream, 9, 1), 16, 10).cast("int")).cast("string"), octet(1), octet(3), octet(5)))
        .when(kind == "ip6", F.concat(F.lit("2001:db8:"), block))
        .when(kind == "born", born)
        .when(kind == "key", F.concat(F.substring(norm, 1, 4), _shape(rest(5), stream)))
    )
    extension = F.substring(F.repeat(stream, (attempt / 128).cast("int") + 1), F.lit(1), F.greatest(attempt - (EXTEND - 1), F.lit(0)))
    pem = F.concat(F.regexp_extract(norm, "^(-----BEGIN [A-Z ]*-----)", 1), _shape(F.regexp_extract(norm, "-----([^-]+)-----", 1), stream), F.regexp_extract(norm, "(-----END [A-Z ]*-----)$", 1))
    return (
        F.when(numbers.isNotNull(), F.when(attempt >= EXTEND, F.concat(numbers, F.lit("-"), extension)).otherwise(numbers))
        .when(kind == "email", F.concat(_shape(F.substring_index(norm, "@", 1), stream), F.lit("@"), F.translate(F.substring(stream, 101, 8), HEX, LETTERS), F.lit(".example."), tld))
        .when(kind == "pem", pem)
        .when(kind == "jwt", F.concat(F.lit("eyJ"), _shape(rest(4), stream)))
        .when(kind == "name", _name(norm, key, attempt))
        .when(norm.rlike("^[0-9a-f]+$"), F.concat(F.rpad(F.substring(stream, F.lit(1), F.char_length(norm)), F.char_length(norm), stream), _more(stream, attempt, F.lit(True))))
        .otherwise(F.concat(_shape(norm, stream), _more(stream, attempt, F.lit(False))))
    )


def _dress(kind: Column, m: Column, core: Column) -> Column:
    """The surrogate in the format of the mention."""
    nth = lambda i: F.char_length(_digits(F.substring(m, F.lit(1), i)))
    grouped = F.array_join(F.transform(_chars(m), lambda i: F.when(F.substring(m, i, F.lit(1)).rlike("[0-9]"), F.substring(core, nth(i), F.lit(1))).otherwise(F.substring(m, i, F.lit(1)))), "")
    shout = m == F.upper(m)
    told = F.regexp_extract(m, _VALUE, 2)
    joint, long = F.regexp_extract(told, "([./-])", 1), told.rlike(r"^\d\d[./-]\d\d[./-]")
    piece = lambda at: F.when(long, F.substring(core, at, 2)).otherwise(F.substring(core, at, 2).try_cast("int").cast("string"))
    date = F.when(told.rlike(r"^\d{4}-"), core).otherwise(F.concat(piece(9), joint, piece(6), joint, F.substring(core, 1, 4), F.substring(core, F.lit(11), F.char_length(core))))
    further = F.substring(core, F.char_length(_digits(m)) + 1, F.char_length(core))
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.concat(grouped, further))
        .when(kind.isin("secret", "bearer"), F.concat(F.regexp_extract(m, _VALUE, 1), core, F.regexp_extract(m, _VALUE, 3)))
        .when(kind == "born", F.concat(F.regexp_extract(m, _VALUE, 1), date))
        .when(kind == "name", F.concat(F.regexp_extract(m, rf"^{TITLE}", 0), F.when(shout, F.upper(core)).otherwise(core)))
        .when(kind == "iban", F.when(m.contains(" "), F.trim(F.regexp_replace(core, "(.{4})", "$1 "))).otherwise(core))
        .when((kind == "email") & shout, F.upper(core))
        .otherwise(core)
    )


def mentions(text: Column) -> Column:
    """array<struct<m, kind, norm>> of the mentions in a text, in order."""
    hits = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform(hits, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x.m.alias("m"), x.kind.alias("kind"), _normal(x.kind, x.m).alias("norm")))


def _pairs(drawn: Column) -> Column:
    """array<struct<len, k, v>> of the names in a text that have a title, without it, and of their parts, with their surrogates; longest first."""
    names = F.filter(drawn, lambda x: x.kind == "name")
    bare = F.transform(names, lambda x: F.struct(F.regexp_replace(x.m, rf"^{TITLE}", "").alias("k"), F.when(x.m == F.upper(x.m), F.upper(x.core)).otherwise(x.core).alias("v")))
    parts = F.flatten(F.transform(bare, lambda x: F.arrays_zip(F.split(x.k, " ").alias("k"), F.split(x.v, " ").alias("v"))))
    return F.array_sort(F.transform(F.concat(bare, parts), lambda x: F.struct((-F.char_length(x.k)).alias("len"), x.k.alias("k"), x.v.alias("v"))))


def _untitled(segment: Column, pairs: Column) -> Column:
    """Text between mentions, with names that the text also has with a title replaced."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(pairs, lambda p: p.k), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    known = lambda hit: F.get(F.filter(pairs, lambda p: p.k == hit), F.lit(0)).v
    new = F.transform(F.regexp_extract_all(segment, pattern, F.lit(0)), known)
    return F.array_join(F.zip_with(F.split(segment, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def collisions(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate isn't theirs alone, with the attempt that is.

    entities: distinct (kind, norm). Of those that meet in one surrogate the first by normal form keeps it. Names and secrets
    get longer with the attempt, and numbers get a growing extension from the EXTEND-th attempt on, so there is always a free
    one, even where a table holds nearly all numbers of a format.
    """
    state = scratch.table(entities.withColumn("attempt", F.lit(0)))
    while True:
        drawn = state.withColumn("core", _core(F.col("kind"), F.col("norm"), key, F.col("attempt")))
        # an entity that already kept its surrogate goes first
        rank = F.row_number().over(W.partitionBy("kind", "core").orderBy("attempt", "norm"))
        real = entities.select("kind", F.when(F.col("kind") == "name", F.initcap(F.substring("norm", 3, 1 << 20))).otherwise(F.col("norm")).alias("core"), F.lit(1).alias("real")).distinct()
        judged = scratch.table(drawn.withColumn("rank", rank).join(real, ["kind", "core"], "left").select("kind", "norm", "attempt", ((F.col("rank") > 1) | F.col("real").isNotNull()).alias("again")))
        if not judged.where("again").limit(1).count():
            return judged.where("attempt > 0").select("kind", "norm", "attempt")
        state = scratch.table(judged.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))


def surrogates(docs: DataFrame, secret: str = "stratum", text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the entities of every whole text replaced, and the columns n_entities and entity_kinds appended.

    Null texts stay null and texts without entities stay as they are; columns named like the appended ones are replaced, other
    columns of any name stay. Repeated rows are rewritten alike, null keys like any others; an empty table gives an empty one.
    Mentions are searched once, and texts written with them to the shared folder. n_entities counts the mentions that the pattern finds; names without a title, of which the same text has one with it, are
    replaced on top. Account numbers with wrong check digits are replaced too and stay wrong. Entities are gathered by an
    aggregation that combines before it shuffles. Attempts that the collision check raised are looked up in a literal up to
    MAX_LITERAL of them, beyond by a join on the text's hash, with the same result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    docs = docs.drop("n_entities", "entity_kinds")
    m_, tries_, hash_, drawn_, pairs_ = (free(c, docs.columns) for c in ("_m", "_tries", "_hash", "_drawn", "_pairs"))
    docs = scratch.table(docs.withColumn(m_, mentions(F.col(text))))
    found = docs.select(F.explode(m_).alias("x")).select("x.kind", "x.norm").where("kind is not null").distinct()
    again = scratch.table(collisions(scratch.table(found), secret, scratch))
    n = again.count()
    name = lambda kind, norm: F.concat_ws("\x1f", kind, norm)
    if not n:
        attempt = lambda x: F.lit(0)
    elif n <= MAX_LITERAL:
        known = F.create_map(*(F.lit(v) for r in again.collect() for v in (f"{r.kind}\x1f{r.norm}", r.attempt)))
        attempt = lambda x: F.coalesce(F.element_at(known, name(x.kind, x.norm)), F.lit(0))
    else:
        same = F.sha2(F.col(text), 256)
        own = docs.select(same.alias("s"), F.explode(F.array_distinct(m_)).alias("x")).select("s", "x.kind", "x.norm").distinct().join(again, ["kind", "norm"])
        tries = own.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("norm")), "attempt"))).alias(tries_))
        docs = docs.withColumn(hash_, same).join(tries.withColumnRenamed("s", hash_), hash_, "left")
        attempt = lambda x: F.coalesce(F.element_at(F.col(tries_), name(x.kind, x.norm)), F.lit(0))
    columns = [c for c in docs.columns if c not in (m_, tries_, hash_)]
    drawn = F.transform(F.col(m_), lambda x: F.struct(x.m.alias("m"), x.kind.alias("kind"), _core(x.kind, x.norm, secret, attempt(x)).alias("core")))
    dressed = F.transform(F.col(drawn_), lambda x: F.when(x.kind.isNull(), x.m).otherwise(_dress(x.kind, x.m, x.core)))
    between = F.split(F.col(text), ANY, -1)
    between = F.when(F.size(pairs_) > 0, F.transform(between, lambda s: _untitled(s, F.col(pairs_)))).otherwise(between)
    parts = F.zip_with(between, dressed, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    kinds = F.filter(F.col(m_), lambda x: x.kind.isNotNull())
    out = docs.withColumn(drawn_, drawn).withColumn(pairs_, _pairs(F.col(drawn_)))
    out = out.withColumn(text, F.when(F.size(m_) > 0, F.array_join(parts, "")).otherwise(F.col(text)))
    out = out.withColumn("n_entities", F.coalesce(F.size(kinds), F.lit(0))).withColumn("entity_kinds", F.array_sort(F.array_distinct(F.transform(kinds, lambda x: x.kind))))
    return out.select(*columns, "n_entities", "entity_kinds")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"))
