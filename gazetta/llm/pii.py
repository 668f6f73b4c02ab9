"""Surrogates for personal data, in DataFrame functions only.

Every distinct entity (its kind and its value without formatting; each part of a person's name is an entity, so that
"Mr John Smith" and "Mr Smith" keep one surname) gets one
surrogate from a keyed function, so that all mentions in all documents agree. Digits are
permuted by a keyed Feistel network on numbers of the same length, which is
one-to-one; letters are replaced by letters of the same script, class and
case; titles stay, as do endings that tell gender (two letters of inflected names, a last vowel
of others). A check over all entities
finds surrogates that coincide with each other or with a real value and redraws them
until there are none; values that are too short for it grow by
a letter or digit a draw. Each mention keeps its own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, salted_left_join, scratch, written

#: Fixed patterns by kind, in the order in which they are tried at a place.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\dA-Za-z])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\dA-Za-z])",
    "phone": r"\+\d{1,3}[ -]?(?:\(\d{2,4}\)|\d{2,4})(?:[ -]\d{2,4}){2,3}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": r"(?<![\p{L}\p{N}])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Господин|Госпожа|Κύριος|Κυρία)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
#: Fixed classes of letters that may stand for each other.
CLASSES = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "āăąēĕėęěīĭįōŏőūŭůűųãåæõøœÿý", "çćčďđðğłńñňŕřśşšťþźżž",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "ёєіїй", "ґђјљњћџў", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋ",
    "աեէըիոօ", "բգդզթժլխծկհձղճմյնշչպջռսվտրցփքֆ",
)
#: Fixed country calling codes of two digits; 1 and 7 are of one, all others of three.
_TWO_DIGIT_CODES = r"^(?:2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ROUNDS = 6
_TITLE = r"^((?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Господин|Госпожа|Κύριος|Κυρία)\.? )"
_ENDING = 2  # letters of an inflected (Cyrillic or Greek) name that keep its gender, if two others remain
_LENGTHEN = 8  # draws after which names and addresses get a letter more in each
_LONGER = 24  # draws after which numbers get a digit more in each


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _pattern() -> str:
    named = KINDS["card"].replace(r"\1", r"\k<sep>").replace("([ -]?)", "(?<sep>[ -]?)")
    return "|".join(named if k == "card" else p for k, p in KINDS.items())


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def identity(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    bare = F.regexp_replace(value, _TITLE, "")
    return (
        F.when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "name", bare)
        .when(kind == "email", F.lower(value))
        .otherwise(value)
    )


def _permuted(digits: Column, key: str, tweak: Column) -> Column:
    """Another number with as many digits, one-to-one for a key and tweak."""
    half = F.floor(F.length(digits) / 2).cast("int")
    a, b = F.substring(digits, 1, half), F.substring(digits, half + 1, F.length(digits))

    def number(s: Column) -> Column:
        return F.when(s == "", F.lit(0)).otherwise(s.cast("long")).cast("long")

    state = F.struct(number(a).alias("a"), number(b).alias("b"), F.length(a).alias("m"), F.length(b).alias("n"))

    def size(n: Column) -> Column:
        return F.pow(F.lit(10.0), n).cast("long")

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        mixed_a = F.pmod(s["a"] + F.pmod(F.xxhash64(F.lit(key), tweak, r, s["b"]), size(s["m"])), size(s["m"]))
        mixed_b = F.pmod(s["b"] + F.pmod(F.xxhash64(F.lit(key), tweak, r, s["a"]), size(s["n"])), size(s["n"]))
        return F.struct(F.when(even, mixed_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(mixed_b).alias("b"), s["m"].alias("m"), s["n"].alias("n"))

    def text(x: Column, n: Column) -> Column:
        return F.when(n == 0, F.lit("")).otherwise(F.lpad(x.cast("string"), n, "0"))

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, state, turn, lambda s: F.concat(text(s["a"], s["m"]), text(s["b"], s["n"])))


def _luhn_digit(body: Column) -> Column:
    """The last digit that makes body + digit pass the Luhn check."""
    n = F.length(body)

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.transform(F.split(body, ""), term), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _address(value: Column, key: str, tweak: Column) -> Column:
    """Another IPv4 address, one-to-one."""
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    state = _let(o, lambda o: F.struct((F.get(o, 0) * 256 + F.get(o, 1)).cast("long").alias("a"), (F.get(o, 2) * 256 + F.get(o, 3)).cast("long").alias("b")))

    def turn(s: Column, r: Column) -> Column:
        mixed = F.pmod(s["a"] + F.pmod(F.xxhash64(F.lit(key), tweak, r, s["b"]), F.lit(65536)), F.lit(65536))
        return F.struct(s["b"].alias("a"), mixed.alias("b"))

    def dotted(s: Column) -> Column:
        parts = [F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256]
        return F.concat_ws(".", *[p.cast("int").cast("string") for p in parts])

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), state, turn, dotted)


def _letters(value: Column, key: str, tweak: Column, kept: Column) -> Column:
    """Letters and digits replaced within their class; the last `kept` characters stay."""
    length = F.length(value)

    def one(c: Column, i: Column) -> Column:
        low = F.lower(c)
        draw = F.xxhash64(F.lit(key), tweak, F.lower(value), i)
        unlisted = F.substring(F.lit("eainorst"), F.pmod(draw, F.lit(8)).cast("int") + 1, F.lit(1))  # no real letter stays
        out = F.when(c.rlike("^[0-9]$"), F.pmod(draw, F.lit(10)).cast("string")).when(c.rlike(r"^\p{L}$"), unlisted).otherwise(c)
        for letters in CLASSES:
            other = F.substring(F.lit(letters), F.pmod(draw, F.lit(len(letters))).cast("int") + 1, F.lit(1))
            out = F.when((low != "") & (F.instr(F.lit(letters), low) > 0), F.when(c == low, other).otherwise(F.upper(other))).otherwise(out)
        return F.when(i < length - kept, out).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def surrogate(kind: Column, core: Column, key: str, attempt: Column) -> Column:
    """The keyed surrogate of an identity."""
    tweak = F.concat_ws("/", kind, attempt.cast("string"))
    digits = _permuted(core, key, tweak)  # of a social-security number
    issuer, body, last = F.substring(core, 1, 1), F.substring(core, 2, F.length(core) - 2), F.substring(core, -1, 1)
    valid = _luhn_digit(F.concat(issuer, body)) == last
    checked = _let(F.concat(issuer, _permuted(body, key, tweak)), lambda b: F.concat(b, _luhn_digit(b)))
    card = F.when(valid, checked).otherwise(F.concat(issuer, _permuted(F.concat(body, last), key, tweak)))
    code = F.when(core.rlike("^[17]"), 1).when(core.rlike(_TWO_DIGIT_CODES), 2).otherwise(3)  # digits of the country code
    phone = F.concat(F.substring(core, F.lit(1), code), _permuted(F.substring(core, code + 1, F.length(core)), key, tweak))
    iban = F.concat(F.substring(core, 1, 2), _permuted(F.substring(core, 3, F.length(core)), key, tweak))
    top = F.length(F.substring_index(core, ".", -1)) + 1  # the top-level domain stays
    inflected = core.rlike(r"\p{IsCyrillic}|\p{IsGreek}")
    vowel_ending = core.rlike("^.{3,}[aeo]$")  # a last vowel tells gender in many languages
    ending = F.when(inflected, F.least(F.lit(_ENDING), F.greatest(F.lit(0), F.length(core) - 2))).when(vowel_ending, F.lit(1)).otherwise(F.lit(0))
    more = F.greatest(F.lit(0), attempt - (_LENGTHEN - 1))
    vowel = F.when(core.rlike(r"\p{IsCyrillic}"), F.lit("а")).when(inflected, F.lit("α")).otherwise(F.lit("a"))
    name = F.concat(F.substring(core, F.lit(1), F.length(core) - ending), F.repeat(vowel, more), F.substring(core, F.length(core) - ending + 1, ending))
    longer = F.repeat(F.pmod(F.xxhash64(F.lit(key), tweak, core), F.lit(10)).cast("string"), F.greatest(F.lit(0), attempt - (_LONGER - 1)))
    return (
        F.when(kind == "card", F.concat(card, longer))
        .when(kind == "phone", F.concat(phone, longer))
        .when(kind == "iban", F.concat(iban, longer))
        .when(kind == "ip", _address(core, key, tweak))
        .when(kind == "email", _letters(F.concat(F.repeat(F.lit("a"), more), core), key, tweak, top))
        .when(kind == "name", _letters(name, key, tweak, ending))
        .otherwise(F.concat(digits, longer))
    )


def entity_table(mentions: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """kind, core, surrogate for distinct entities: no two surrogates of a kind
    are equal and none is a real value of that kind."""
    distinct = mentions.select("kind", "core").distinct()
    now = written(distinct.select("kind", "core", surrogate(F.col("kind"), F.col("core"), key, F.lit(0)).alias("surrogate")), "entities")
    for attempt in range(1, most_rounds):
        real = now.select("kind", F.col("core").alias("surrogate"), F.lit(True).alias("real"))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "core"))
        if "attempt" not in now.columns:
            now = now.withColumn("attempt", F.lit(0))
        checked = now.join(real, ["kind", "surrogate"], "left").withColumn("bad", F.col("real").isNotNull() | (rank > 1)).drop("real")
        if checked.filter("bad").isEmpty():
            return now.drop("attempt")
        again = F.when(F.col("bad"), surrogate(F.col("kind"), F.col("core"), key, F.lit(attempt))).otherwise(F.col("surrogate"))
        now = written(checked.select("kind", "core", again.alias("surrogate"), F.when(F.col("bad"), F.lit(attempt)).otherwise(F.col("attempt")).alias("attempt")), "entities")
    raise ValueError("surrogates still coincide; some kind has more values than its format allows")


def _in_format(value: Column, kind: Column, core: Column) -> Column:
    """The surrogate with the mention's own marks, spaces, title and case."""

    def digit(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("^[0-9]$"), F.substring(core, before + 1, F.lit(1))).otherwise(c)

    def alphanumeric(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), " ", ""))
        return F.when(c == " ", c).otherwise(F.substring(core, before + 1, F.lit(1)))

    def cased(c: Column, i: Column) -> Column:
        new = F.substring(core, i + 1 + longer, F.lit(1))
        return F.when(c != F.lower(c), F.upper(new)).otherwise(new)

    longer = F.length(core) - F.length(value)  # letters that a mail address got in front

    def extra(marks: str) -> Column:
        return F.substring(core, F.length(F.regexp_replace(value, marks, "")) + 1, F.length(core))

    chars = F.split(value, "")
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.concat(F.array_join(F.transform(chars, digit), ""), extra(r"[^0-9]")))
        .when(kind == "iban", F.concat(F.array_join(F.transform(chars, alphanumeric), ""), extra(" ")))
        .when(kind == "email", F.concat(F.substring(core, F.lit(1), longer), F.array_join(F.transform(chars, cased), "")))
        .otherwise(core)
    )


def replace_personal_data(df: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions replaced) for every row.

    Equal entities get equal surrogates in all documents, different ones different ones that no document has.

    A null text stays null with 0 mentions; a null id stays null; documents with
    equal texts, and repeated rows, get equal results; other columns are
    ignored; an empty table gives an empty result.
    """
    pattern = _pattern()
    plain = picked(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    text = F.coalesce("text", F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    texts = plain.select(blob.alias("blob"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    mentions = texts.filter(F.size("found") > 0).select("blob", F.posexplode("found").alias("place", "value")).distinct()
    mentions = mentions.withColumn("kind", kind_of(F.col("value")))
    core = identity(F.col("kind"), F.col("value"))
    cores = F.when(F.col("kind") == "name", F.split(core, " ")).otherwise(F.array(core))
    mentions = written(mentions.select("blob", "place", "value", "kind", F.posexplode(cores).alias("part", "core")), "mentions")
    with scratch(df.sparkSession):
        entities = written(entity_table(mentions, key), "surrogates", lasting=True)
    named = salted_left_join(mentions.withColumn("__who", F.concat_ws(":", "kind", "core")), entities.select(F.concat_ws(":", "kind", "core").alias("__who"), "surrogate"), "__who")
    # what comes before a part: the title before a name's first, a space before its second
    lead = F.when(F.col("kind") != "name", F.lit("")).when(F.col("part") > 0, F.lit(" ")).otherwise(F.regexp_extract("value", _TITLE, 1))
    placed = named.select("blob", "place", "part", F.concat(lead, _in_format(F.col("value"), F.col("kind"), F.col("surrogate"))).alias("new"))
    lists = placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("place", "part", "new"))).alias("__parts"))
    found = F.filter("__parts", lambda x: x["part"] == 0)
    second = F.map_from_entries(F.transform(F.filter("__parts", lambda x: x["part"] == 1), lambda x: F.struct(x["place"], x["new"])))
    whole = F.get(F.transform(F.array(second), lambda m: F.transform(found, lambda x: F.struct(x["place"].alias("place"), F.concat(x["new"], F.coalesce(F.element_at(m, x["place"]), F.lit(""))).alias("new")))), 0)
    lists = lists.select("blob", whole.alias("new"))
    rows = salted_left_join(plain.withColumn("blob", blob), lists, "blob")
    parts = F.split("text", pattern, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(parts, F.transform("new", lambda x: x["new"]), lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    return rows.select("doc_id", F.when(F.col("new").isNull(), F.col("text")).otherwise(rebuilt).alias("text"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_entities"))
