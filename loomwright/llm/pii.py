"""Operator 10, PII [native]: keyed surrogates.

Entities are found with one pattern. Each is split into units (a name into its words, an address
into mailbox and domain, anything else is one unit); a unit is brought to a canonical form, so that its
spellings are one, and gets a surrogate from streams of HMAC-SHA-256 under a key: digits for digits, letters for
letters, names of the same gender and script, valid check digits and dates. As a surrogate depends on the canonical unit
alone, all mentions of an entity, in all documents, change alike. The words of a name that is found after a title
are replaced wherever else they stand in that document.

Collision checks: a surrogate that another unit got too, or that is a unit found in the corpus, is drawn
again, round by round, until all units have distinct ones. The entity is then written in the form it was
found in: brackets, spaces, dashes, apostrophes and capitals stay, and so do parts of names of one or two letters.

The key is data of a one-row table and no part of a plan, so that plans and logs don't show it.

Defined cases: a null text stays null with 0 entities; a text without entities is returned unchanged; texts and entities may
have any length; numbers that fail their check digit or range are no entities; each row gets the replacements of its own
text, whatever its key, null keys included; repeated rows change alike; an empty table gives an empty result; columns of
the input that clash with ``n_entities`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm import store

# Titles by the gender they tell, in the languages handled.
_MALE = ["Mr", "Herr", "Sr", "Señor", "Monsieur", "господин", "г-н"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "госпожа", "г-жа"]
_NEUTRAL = ["Dr", "Prof"]
_TITLE = "(?:" + "|".join(_MALE + _FEMALE + _NEUTRAL) + r")\.?"
# Words after which a secret stands.
_SECRET = r"(?:password|passwd|pwd|secret|token|api[_-]?key)"
# Words after which a passport number or a date of birth stands.
_PASSPORT = r"(?i:passport|reisepass|passeport|pasaporte)(?i: (?:no|number|nr|num)\.?)?[:# ]{1,3}"
_BORN = r"(?i:born on|born|date of birth|dob|geboren am|née? le|nacid[oa] el)[: ]{1,3}"
_LED = "^((?i:" + _SECRET + r")\s{0,2}[=:]\s{0,2}[\"']?|" + _PASSPORT + "|" + _BORN + ")(.*)$"
_NAME = r"\p{Lu}[\p{L}'’-]{0,40}\p{L}"

#: Patterns by kind.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?i:" + _SECRET + r")\s{0,2}[=:]\s{0,2}[\"']?[^\s\"',;]{6,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "passport": _PASSPORT + r"[A-Z]{1,2}\d{6,8}(?![0-9A-Za-z])",
    "birth": _BORN + r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)",
    "cloud_key": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\d])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?![\d.]*\d)|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d.-]*\d)",
    "ipv6": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![0-9A-Za-z:])",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "name": _TITLE + " " + _NAME + "(?: " + _NAME + ")?",
}
_ORDER = ["email", "secret", "jwt", "passport", "birth", "cloud_key", "iban", "ipv6", "ip", "ssn", "card", "phone", "name"]
_ANY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS[k] for k in _ORDER) + ")"


def _chars(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(c, i, F.lit(1)))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check modulo 10, for a number with its check digit."""
    value = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


def _mod97(iban: Column) -> Column:
    """Remainder of the IBAN check; letters count as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("long")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0).cast("long"), step)


def kind_of(entity: Column) -> Column:
    """Kind of a found entity; null for numbers that only look like one."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    octets = F.split(entity, r"\.")
    valid = {
        "iban": _mod97(F.regexp_replace(entity, " ", "")) == 1,
        "ip": F.forall(octets, lambda o: o.cast("int") <= 255),
        "card": _luhn(digits) == 0,
        "phone": F.char_length(digits).between(8, 15),
    }
    out = F.lit(None).cast("string")
    for k in reversed(_ORDER):
        out = F.when(entity.rlike("^(?:" + PATTERNS[k] + ")$"), F.when(valid.get(k, F.lit(True)), F.lit(k))).otherwise(out)
    return out


def _units(entity: Column, kind: Column) -> Column:
    """Array of (kind, kept prefix, canonical form, form as found) of an entity's units."""

    def unit(k: Column | str, prefix: Column, found: Column, canonical: Column | None = None) -> Column:
        k = F.lit(k) if isinstance(k, str) else k
        return F.struct(k.alias("kind"), prefix.alias("prefix"), (found if canonical is None else canonical).alias("unit"), found.alias("found"))

    none = F.lit("")
    lead, value = F.regexp_extract(entity, _LED, 1), F.regexp_extract(entity, _LED, 2)
    title = F.regexp_extract(entity, "^(" + _TITLE + " )", 1)
    names = F.split(F.regexp_replace(entity, "^" + _TITLE + " ", ""), " ")
    told = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(told.isin(_MALE), "m").when(told.isin(_FEMALE), "f").otherwise("n")

    def words(name: Column, family: Column, before: Column) -> Column:
        """The runs of letters of a name, each with what stands before it."""

        def one(run: Column, i: Column) -> Column:
            letters = F.regexp_extract(run, r"\p{L}+", 0)
            script = F.when(letters.rlike(r"\p{IsCyrillic}"), "cyrillic").when(letters.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
            sort = F.when(F.char_length(letters) < 3, "kept").when(~family, F.concat(F.lit("given-"), gender, F.lit("-"), script))
            sort = sort.otherwise(F.concat(F.lit("family-"), F.when(script == "cyrillic", gender).otherwise("n"), F.lit("-"), script))
            return unit(sort, F.concat(F.when(i == 0, before).otherwise(none), F.regexp_extract(run, r"^[^\p{L}]*", 0)), letters, F.lower(letters))

        return F.transform(F.regexp_extract_all(name, F.lit(r"[^\p{L}]*\p{L}+"), F.lit(0)), one)

    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(
            kind == "email",
            F.array(
                unit("mailbox", none, F.split_part(entity, F.lit("@"), F.lit(1)), F.lower(entity)),
                unit("domain", F.lit("@"), F.split_part(entity, F.lit("@"), F.lit(2)), F.lower(F.split_part(entity, F.lit("@"), F.lit(2)))),
            ),
        )
        .when(kind.isin("secret", "passport", "birth"), F.array(unit(kind, lead, value)))
        .when(kind == "iban", F.array(unit("iban", none, entity, F.regexp_replace(entity, " ", ""))))
        .when(kind == "ipv6", F.array(unit("ipv6", none, entity, F.lower(entity))))
        .when(kind.isin("card", "phone", "ssn"), F.array(unit(kind, none, entity, digits)))
        .when((kind == "name") & (F.size(names) == 1), words(names[0], F.lit(True), title))
        .when(kind == "name", F.concat(words(names[0], F.lit(False), title), words(names[1], F.lit(True), F.lit(" "))))
        .otherwise(F.array(unit(kind, none, entity)))
    )


def _pads(spark: SparkSession, key: str) -> DataFrame:
    """One row: the inner and outer pad of HMAC-SHA-256 for a key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return spark.createDataFrame([(1, bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw))], "__one int, __ipad binary, __opad binary")


def hmac_sha256(message: Column) -> Column:
    """Hex digits of the HMAC of a string, under the pads in the row."""
    inner = F.unhex(F.sha2(F.concat(F.col("__ipad"), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.col("__opad"), inner), 256)


def _stream(kind: Column, unit: Column, attempt: Column) -> Column:
    """Hex digits of a keyed stream, more than two for each character of the unit."""
    n = F.greatest(F.char_length(unit), F.lit(32))
    seed = F.array(hmac_sha256(F.concat_ws("\u0001", kind, unit, attempt.cast("string"))))
    places = F.sequence(F.lit(0), (n / 16).cast("int"))
    return F.get(F.transform(seed, lambda s: F.array_join(F.transform(places, lambda i: hmac_sha256(F.concat_ws("\u0001", s, i.cast("string")))), "")), F.lit(0))


def _at(stream: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a stream."""
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _like(value: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Digits for digits, letters for letters of the same case; other characters stay."""
    pick = lambda alphabet, i, s: F.substring(F.lit(alphabet), _at(s, i) % len(alphabet) + 1, F.lit(1))
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal
    one = lambda c, i, s: (
        F.when(hexadecimal, pick("0123456789abcdef", i, s))
        .when(c.rlike("[0-9]"), pick(_DIGITS, i, s))
        .when(c.rlike(r"\p{Lu}"), pick(_UP, i, s))
        .when(c.rlike(r"\p{L}"), pick(_LOW, i, s))
        .otherwise(c)
    )
    # In pieces of 256, each with its part of the stream, as a place far into a long string is slow to reach.
    starts = F.sequence(F.lit(0), F.floor((F.char_length(value) - 1) / 256).cast("int"))
    pieces = F.transform(starts, lambda k: F.struct(F.substring(value, 256 * k + 1, F.lit(256)).alias("v"), F.substring(stream, 512 * k + 1, F.lit(512)).alias("s")))
    like = F.transform(pieces, lambda p: F.array_join(F.transform(_chars(p["v"]), lambda c, i: one(c, i, p["s"])), ""))
    return F.when(F.char_length(value) > 0, F.array_join(like, "")).otherwise(value)


# Sounds that invented names are made of, by script.
_SOUNDS = {
    "latin": (["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "dr", "gr", "st"], ["a", "e", "i", "o", "u"], {"m": "n", "f": "a", "n": "l"}),
    "cyrillic": (["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "бр", "др", "гр", "ст"], ["а", "е", "и", "о", "у"], {"m": "н", "f": "а", "n": "ль"}),
    "greek": (["β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "βρ", "δρ", "γρ", "στ"], ["α", "ε", "ι", "ο", "ου"], {"m": "ς", "f": "α", "n": "λ"}),
}


def _invented(kind: Column, stream: Column) -> Column:
    """A lower-case name of the script and gender that the kind ends with."""
    out = F.lit(None).cast("string")
    for script, (consonants, vowels, ends) in _SOUNDS.items():
        for given in (True, False):
            n = 2 if given else 3
            hard, soft = F.array(*map(F.lit, consonants)), F.array(*map(F.lit, vowels))
            sounds = [F.concat(F.get(hard, _at(stream, F.lit(2 * i)) % len(consonants)), F.get(soft, _at(stream, F.lit(2 * i + 1)) % len(vowels))) for i in range(n)]
            for gender, end in ends.items():
                tail = F.get(hard, _at(stream, F.lit(9)) % 14)
                last = F.concat(tail, F.lit(("о" if script == "cyrillic" else "") + {"m": "в", "f": "ва", "n": "в"}[gender])) if script == "cyrillic" and not given else F.concat(tail, F.lit(vowels[0] + end if gender != "f" else end))
                name = f"{'given' if given else 'family'}-{gender}-{script}"
                out = F.when(kind == name, F.concat(*sounds, last)).otherwise(out)
    return out


def surrogate(kind: Column, unit: Column, attempt: Column) -> Column:
    """The attempt's surrogate of a canonical unit, in canonical form."""
    stream = F.col("__stream")
    plain = _like(unit, stream)
    # Short mailboxes and domains run out: from the eighth attempt on they get longer.
    more = _like(F.repeat(F.lit("a"), F.greatest(attempt - 7, F.lit(0))), F.sha2(stream, 256))
    label = F.regexp_extract(unit, r"^(.*)(\.[^.]*)$", 1)
    octet = lambda i, n, base: (_at(stream, F.lit(i)) % n + base).cast("string")
    body = F.concat(F.substring(unit, 1, 1), F.substring(plain, F.lit(2), F.char_length(unit) - 2))
    check = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.struct(_luhn(F.concat(body, d.cast("string"))).alias("r"), d.alias("d")))
    card = F.concat(body, F.array_min(check)["d"].cast("string"))
    tail = F.substring(plain, F.lit(5), F.char_length(unit))
    country = F.substring(unit, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), tail))).cast("string"), 2, "0"), tail)
    # A country code (the digits before the last ten) and the kind of the first local digit stay.
    code = F.greatest(F.char_length(unit) - 10, F.lit(0))
    local = F.when(F.substring(unit, code + 1, F.lit(1)).isin("0", "1"), F.substring(unit, code + 1, F.lit(1))).otherwise((_at(stream, code) % 8 + 2).cast("string"))
    phone = F.concat(F.substring(unit, F.lit(1), code), local, F.substring(plain, code + 2, F.char_length(unit)))
    # Dates: of any day that all months have, in the form as found.
    day, month = (F.lpad((_at(stream, F.lit(i)) % n + 1).cast("string"), 2, "0") for i, n in ((0, 28), (1, 12)))
    year, mark = ((_at(stream, F.lit(2)) % 90) + 1920).cast("string"), F.substring(unit, 3, 1)
    born = F.when(unit.rlike("^[0-9]{4}-"), F.concat_ws("-", year, month, day)).otherwise(F.concat(day, mark, month, mark, year))
    return (
        F.when(kind == "mailbox", F.concat(_like(F.split_part(unit, F.lit("@"), F.lit(1)), stream), more))
        .when(kind == "domain", F.concat(_like(label, stream), more, F.regexp_extract(unit, r"(\.[^.]*)$", 1)))
        .when(kind == "secret", _like(unit, stream, unit.rlike("^[0-9a-f]+$")))
        .when(kind == "ipv6", F.array_join(F.transform(_chars(unit), lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), _at(stream, i) % 16 + 1, F.lit(1)))), ""))
        .when(kind == "jwt", F.concat(F.substring(unit, 1, 3), F.substring(plain, F.lit(4), F.char_length(unit))))
        .when(kind == "birth", born)
        .when(kind == "cloud_key", F.concat(F.substring(unit, 1, 4), F.substring(plain, F.lit(5), F.char_length(unit))))
        .when(kind == "ip", F.concat_ws(".", octet(0, 223, 1), octet(1, 256, 0), octet(2, 256, 0), octet(3, 254, 1)))
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "phone", phone)
        .when(kind.rlike("^(given|family)-"), _invented(kind, stream))
        .otherwise(plain)
    )


def _fill(form: Column, value: Column) -> Column:
    """Writes the letters and digits of a canonical surrogate into the form of the entity as found."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["o"], F.substring(value, a["k"], F.lit(1))).alias("o"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["k"].alias("k")))
    return F.aggregate(_chars(form), start, step, lambda a: a["o"])


def assign(units: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, unit, surrogate) for distinct (kind, unit): surrogates are distinct within a kind and no unit of it.

    Mailboxes are compared within their domain: other domains have other surrogates, so whole addresses are distinct.
    Dates of birth are few, so two may share a surrogate.
    """
    spark = units.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scope = F.when(F.col("kind") == "mailbox", F.split_part("unit", F.lit("@"), F.lit(2))).when(F.col("kind") == "birth", F.col("unit")).otherwise(F.lit(""))
    units = store.materialize(units.distinct().withColumn("scope", scope), "units")
    real = units.select("kind", "scope", F.when(F.col("kind") == "mailbox", F.split_part("unit", F.lit("@"), F.lit(1))).otherwise(F.col("unit")).alias("surrogate"))
    pads = _pads(spark, key)
    taken, todo = real, units.withColumn("attempt", F.lit(0))
    done = None
    for _ in range(rounds):
        # Drawing is dear for each unit, and there are few: all tasks share it. The pads are one row.
        keyed = todo.repartition(tasks, "kind", "unit").withColumn("__one", F.lit(1)).join(F.broadcast(pads), "__one")
        drawn = keyed.withColumn("__stream", _stream(F.col("kind"), F.col("unit"), F.col("attempt")))
        drawn = drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("unit"), F.col("attempt"))).drop("__stream", "__one", "__ipad", "__opad")
        drawn = store.materialize(drawn, "drawn")
        used = taken.select("kind", "scope", "surrogate").distinct().withColumn("used", F.lit(True))
        first = F.row_number().over(Window.partitionBy("kind", "scope", "surrogate").orderBy("unit")) == 1
        judged = store.materialize(drawn.join(used, ["kind", "scope", "surrogate"], "left").withColumn("free", F.col("used").isNull() & first), "surrogates")
        good = judged.where("free").select("kind", "scope", "unit", "surrogate")
        done = good if done is None else done.unionAll(good)
        todo = judged.where("not free").select("kind", "scope", "unit", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done.drop("scope")
        taken = taken.unionAll(good.select("kind", "scope", "surrogate"))
    raise RuntimeError(f"{rounds} rounds left some entities without a distinct surrogate of their form")


def replace_pii(docs: DataFrame, secret_key: str, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns all columns of ``docs`` with entities replaced, and n_entities.

    Texts are scanned twice, the second time only where entities were found, and shuffled once, to meet the
    replacements of their row, which is named by key and a hash of the text.
    """
    row = F.xxhash64(doc_key, text)
    found = docs.select(F.col(doc_key).alias("k"), row.alias("r"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))).alias("entity"))
    found = store.materialize(found, "entities")
    distinct = found.select("entity").distinct().withColumn("kind", kind_of(F.col("entity"))).where("kind is not null")
    parts = distinct.select("entity", F.posexplode(_units(F.col("entity"), F.col("kind"))).alias("place", "u"))
    parts = store.materialize(parts.select("entity", "place", "u.*"), "entity-units")
    given = assign(parts.where("kind != 'kept'").select("kind", "unit"), secret_key)
    shown = parts.join(given, ["kind", "unit"], "left")
    is_word = F.col("kind").rlike("^(given|family)-")
    written = (
        F.when(F.col("kind") == "kept", F.col("found"))
        .when(F.col("kind").isin("card", "phone", "ssn", "iban"), _fill(F.col("found"), F.col("surrogate")))
        .when(F.col("kind").isin("secret", "jwt", "passport", "birth", "cloud_key", "ip"), F.col("surrogate"))
        .when(F.upper("found") == F.col("found"), F.upper("surrogate"))
        .when(is_word, F.initcap("surrogate"))
        .otherwise(F.col("surrogate"))
    )
    shown = store.materialize(shown.select("entity", "place", "prefix", "found", written.alias("w"), is_word.alias("is_word")), "written")
    whole = shown.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("prefix", "w").alias("w")))).alias("ws"))
    whole = whole.select("entity", F.array_join("ws.w", "").alias("new"))
    # What changes in a row: its entities, and the words of its names wherever they stand, as found or in capitals.
    forms = F.explode(F.array(F.struct(F.col("found").alias("f"), F.col("w").alias("n")), F.struct(F.upper("found").alias("f"), F.upper("w").alias("n"))))
    words = shown.where("is_word").select("entity", forms.alias("x")).select("entity", F.col("x.f").alias("f"), F.col("x.n").alias("n"))
    swaps = whole.select("entity", F.col("entity").alias("f"), F.col("new").alias("n"), F.lit(False).alias("word"))
    swaps = swaps.unionAll(words.select("entity", "f", "n", F.lit(True).alias("word")))
    mine = found.hint("merge").join(swaps, "entity").groupBy("k", "r", "f").agg(F.min("n").alias("n"), F.max("word").alias("word"))
    maps = mine.groupBy("k", "r").agg(F.map_from_entries(F.collect_list(F.struct("f", "n"))).alias("__new"), F.array_sort(F.collect_list(F.when(F.col("word"), F.struct((-F.char_length("f")).alias("l"), "f")))).alias("__words"))
    plain = F.concat(F.lit(_ANY + r"|(?<![\p{L}\p{N}_])(?:"), F.array_join("__words.f", "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    maps = maps.select(F.col("k").alias("__k"), F.col("r").alias("__r"), "__new", F.when(F.size("__words") > 0, plain).otherwise(F.lit(_ANY)).alias("__any"))

    joined = docs.withColumn("__row", row).hint("merge").join(maps, F.col(doc_key).eqNullSafe(F.col("__k")) & (F.col("__row") == F.col("__r")), "left")
    # The one-element array binds the pieces and the matches, so they are computed once for a text.
    cut = F.array(F.struct(F.split(text, F.col("__any"), -1).alias("p"), F.regexp_extract_all(text, F.col("__any"), F.lit(0)).alias("m")))
    put = lambda s: F.array_join(F.transform(s["p"], lambda p, i: F.concat(p, F.coalesce(F.col("__new")[F.get(s["m"], i)], F.get(s["m"], i), F.lit("")))), "")
    hits = lambda s: F.size(F.filter(s["m"], lambda e: F.col("__new")[e].isNotNull())).cast("long")
    changed = F.when(F.col("__new").isNull(), F.struct(F.col(text).alias("t"), F.lit(0).cast("long").alias("n"))).otherwise(
        F.get(F.transform(cut, lambda s: F.struct(put(s).alias("t"), hits(s).alias("n"))), F.lit(0))
    )
    rest = [c for c in docs.columns if c not in (text, "n_entities")]
    out = joined.select(*rest, changed.alias("__out"))
    order = [F.col("__out.t").alias(text) if c == text else F.col(c) for c in docs.columns if c != "n_entities"]
    return out.select(*order, F.col("__out.n").alias("n_entities"))
