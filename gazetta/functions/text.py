"""Names as text: cleaning, characters, affixes, n-grams, prefixes, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK main block, with Extension A, and with the planes beyond.
CJK_MAIN = r"\x{4E00}-\x{9FFF}"
CJK_ALL = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2EBEF}"

#: Fixed values of the prefix rules: what ends a parish name, what qualifies one, how some are also written.
DELIMITERS = ("社区", "村", "寨", "片", "管区", "农场", "区")
MODIFIERS = ("大", "小", "新", "老", "東", "西", "南", "北", "上", "下")
HOMOPHONES = {"湖下": ("湖厦", "湖夏"), "石": ("时",)}
CONFIDENCE = {"rule1_delimiter": 1.0, "rule2_admin_match": 0.9, "rule3_modifier": 0.9, "rule5_identical": 1.0, "none": 0.0, "empty_name": 0.0}
NUMERALS = "一二三四五六七八九十"
#: Administrative endings; what a remainder can't begin with or be; characters with a dialect variant.
ADMIN_SUFFIXES = ("社区居民委员会", "村民委员会", "居民委员会", "社区居委会", "村委会", "居委会", "行政村", "管理区", "社区", "村")
BAD_STARTS = "仔圩围里片社街坡塘尾冲"
BARE_NAMES = ("农场", "林场", "石场", "渔业", "渔村", "社区", "祠堂", "水坝", "茶店", "瑶族", "路口")
DIALECT = {
    "朗": "㙟", "㙟": "朗", "涌": "冲", "冲": "埇", "埇": "冲", "滘": "窖", "窖": "滘", "坭": "泥", "泥": "坭",
    "冚": "坎", "輋": "畲", "磜": "礤", "迳": "径", "径": "迳", "崀": "良",
}


def is_cjk(c: Column, extended: bool = True) -> Column:
    return c.rlike(f"^[{CJK_ALL if extended else CJK_MAIN}]$")


def strip_notes(name: Column) -> Column:
    return F.regexp_replace(name, r"[（(].*?[）)]", "")


def only(name: Column, letters: str = CJK_ALL) -> Column:
    return F.regexp_replace(name, f"[^{letters}]", "")


def cleaned(raw: Column, letters: str = CJK_ALL, keep_notes: bool = False, least: int = 1) -> Column:
    """struct<clean_name, had_brackets, had_noise, is_valid, invalid_reason>."""
    blank = raw.isNull() | (F.trim(raw) == "")
    trimmed = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(trimmed, r"[（()）]", "") if keep_notes else strip_notes(trimmed)
    text = only(bare, letters)
    reason = (
        F.when(blank, F.lit("null_or_empty"))
        .when(text == "", F.lit("no_chinese_chars" if letters == CJK_ALL else "no_letters"))
        .when(F.length(text) < least, F.concat(F.lit("too_short_"), F.length(text).cast("string")))
    )
    return F.struct(
        F.when(blank, F.lit("")).otherwise(text).alias("clean_name"),
        (~blank & (trimmed != strip_notes(trimmed))).alias("had_brackets"),
        (~blank & (text != bare)).alias("had_noise"),
        reason.isNull().alias("is_valid"),
        reason.alias("invalid_reason"),
    )


def characters(name: Column) -> Column:
    """All characters in order; none for an empty or null name."""
    return F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: c != "")


def character_set(name: Column) -> Column:
    return F.array_sort(F.array_distinct(characters(name)))


def suffix(name: Column, n: int = 1) -> Column:
    return F.when(F.length(name) >= n, F.substring(name, -n, n))


def prefix(name: Column, n: int = 1) -> Column:
    return F.when(F.length(name) >= n, F.substring(name, 1, n))


def ngrams(name: Column, n: int) -> Column:
    """All runs of n characters, repeats included."""
    count = F.length(name) - n + 1
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(name, i, F.lit(n)))
    return F.when(count >= 1, runs).otherwise(F.expr("cast(array() as array<string>)"))


def positional_ngrams(name: Column, n: int) -> Column:
    """array<struct<position, ngram>>: every run as 'all', the first as 'prefix',
    the last as 'suffix', those between as 'middle'; a single run is both ends."""
    runs = ngrams(name, n)

    def at(position: str, xs: Column) -> Column:
        return F.transform(xs, lambda g: F.struct(F.lit(position).alias("position"), g.alias("ngram")))

    inner = F.when(F.size(runs) > 2, F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 2, F.lit(0)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(at("all", runs), at("prefix", F.slice(runs, 1, 1)), at("suffix", F.reverse(F.slice(F.reverse(runs), 1, 1))), at("middle", inner))


def numbered(name: Column) -> Column:
    """struct<is_numbered, base, numeral> of names that end in a numeral."""
    with_ending, plain = f"^(.+?)([{NUMERALS}]+)村$", f"^(.+?)([{NUMERALS}]+)$"
    base = F.when(name.rlike(with_ending), F.regexp_extract(name, with_ending, 1)).when(name.rlike(plain), F.regexp_extract(name, plain, 1))
    numeral = F.when(name.rlike(with_ending), F.regexp_extract(name, with_ending, 2)).when(name.rlike(plain), F.regexp_extract(name, plain, 2))
    return F.struct(F.coalesce(name.rlike(plain) | name.rlike(with_ending), F.lit(False)).alias("is_numbered"), F.coalesce(base, name).alias("base"), numeral.alias("numeral"))


def without_delimiters(text: Column, delimiters: tuple[str, ...] = DELIMITERS) -> Column:
    return reduce(lambda t, d: F.replace(t, F.lit(d), F.lit("")), delimiters, text)


def count_cjk(text: Column) -> Column:
    return F.length(only(F.coalesce(text, F.lit("")), CJK_MAIN))


def admin_base(name: Column, suffixes: tuple[str, ...] = ADMIN_SUFFIXES, least: int = 2) -> Column:
    """The name without its longest administrative ending, if enough stays."""
    out = name
    for s in sorted(suffixes, key=len):
        cut = F.substring(name, F.lit(1), F.length(name) - len(s))
        out = F.when(name.endswith(s) & (F.length(name) - len(s) >= least), cut).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """Evaluates `value` once for all its uses in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def clean_prefix(natural: Column, admin: Column, least: int = 2) -> Column:
    """struct<name, removed, rule, confidence>: the village name without the parish name before it.

    In this order: equal names stay; a prefix that ends in a delimiter goes; a
    prefix equal to the parish name, qualified or bare or in another spelling, goes, with a
    delimiter rather than without. A prefix with a delimiter that would leave fewer than
    `least` CJK characters ends the search and the name stays.
    """
    both = F.struct(F.trim(F.coalesce(natural, F.lit(""))).alias("name"), F.trim(F.coalesce(admin, F.lit(""))).alias("parish"))

    def with_bare(s: Column) -> Column:
        return _let(without_delimiters(s["parish"]), lambda bare: with_hit(s["name"], s["parish"], bare))

    def with_hit(name: Column, parish: Column, bare: Column) -> Column:
        # (text, whether it settles the matter even if too little is left, condition), in the order in which they are tried
        tries = [(F.concat(F.lit(m), bare, F.lit(d)), d != "", F.lit(True)) for m in MODIFIERS for d in (*DELIMITERS, "")]
        tries += [(F.concat(bare, F.lit(d)), True, F.lit(True)) for d in DELIMITERS] + [(bare, False, F.length(bare) >= 2)]
        tries += [(F.lit(v + d), True, bare == standard) for standard, vs in HOMOPHONES.items() for v in vs for d in (*DELIMITERS, "")]
        options = F.array(*[F.struct(t.alias("t"), F.lit(final).alias("final"), F.coalesce(ok, F.lit(False)).alias("ok")) for t, final, ok in tries])

        def enough(t: Column) -> Column:
            return count_cjk(F.substring(name, F.length(t) + 1, F.length(name))) >= least

        first = F.get(F.filter(options, lambda o: (parish != "") & o["ok"] & F.startswith(name, o["t"]) & (o["final"] | enough(o["t"]))), 0)
        # the delimiter that begins last, with something before it; where two begin at one place the first listed counts
        ends = []
        for k, d in enumerate(DELIMITERS):
            before = F.length(name) - F.instr(F.reverse(name), d[::-1]) + 1 - len(d)
            ends.append(F.when(F.instr(name, d) > 0, F.struct(before.alias("before"), F.lit(-k).alias("order"), (before + len(d)).alias("end"))))
        last = F.greatest(*ends)
        found = F.struct(first["t"].alias("hit"), F.when(last["before"] > 0, last["end"]).alias("cut"))
        return _let(found, lambda f: decided(name, parish, f["hit"], f["cut"]))

    def decided(name: Column, parish: Column, hit: Column, cut: Column) -> Column:
        length = F.length(name)

        def rest(n: Column) -> Column:
            return F.substring(name, n + 1, length)

        rule1 = cut.isNotNull() & (count_cjk(rest(cut)) >= least)
        rule2 = hit.isNotNull() & (hit != "") & (count_cjk(rest(F.length(hit))) >= least)
        label = F.when(F.substring(hit, 1, 1).isin(*MODIFIERS), "rule3_modifier").otherwise("rule2_admin_match")
        same = name == parish
        rule = F.when(name == "", "empty_name").when(same, "rule5_identical").when(rule1, "rule1_delimiter").when(rule2, label).otherwise("none")
        sure = F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])
        return F.struct(
            F.when(same, name).when(rule1, rest(cut)).when(rule2, rest(F.length(hit))).otherwise(name).alias("name"),
            F.when(same, F.lit("")).when(rule1, F.substring(name, F.lit(1), cut)).when(rule2, hit).otherwise(F.lit("")).alias("removed"),
            rule.alias("rule"),
            F.element_at(sure, rule).alias("confidence"),
        )

    return _let(both, with_bare)


def shared_ratio(a: Column, b: Column) -> Column:
    """Characters in common, with repeats, over the longer length."""
    xs, ys = characters(a), characters(b)

    def common(c: Column) -> Column:
        return F.least(F.size(F.filter(xs, lambda x: x == c)), F.size(F.filter(ys, lambda y: y == c)))

    n = F.aggregate(F.array_distinct(xs), F.lit(0), lambda s, c: s + common(c))
    return n / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)).cast("double")


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest.cast("double"))


def limited_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, most + 1 beyond it."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


#: Fixed accents of romanised tones.
_ACCENTED, _PLAIN = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜüńňǹḿ", "aaaaeeeeiiiioooouuuuuuuuunnnm"


def romanised_key(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN), "[^a-z0-9]", "")


def variants(text: Column, swaps: dict[str, str]) -> Column:
    """All texts with one character replaced by its variant."""
    table = F.create_map(*[F.lit(x) for pair in swaps.items() for x in pair])

    def swapped(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.concat(F.substring(text, F.lit(1), i - 1), F.try_element_at(table, c), F.substring(text, i + 1, F.length(text)))

    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.map_contains_key(table, F.substring(text, i, F.lit(1))))
    return F.array_distinct(F.transform(positions, swapped))


def any_of(name: Column, terms: list[str]) -> Column:
    """The terms that the name contains."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(name, t))


def term_strength(name: Column, term: str, weak: tuple[str, ...] = (), medium: tuple[str, ...] = (), protected: tuple[str, ...] = (), forms: tuple[str, ...] = ()) -> Column:
    """'weak' for protected terms in names with a usual ending and for weak terms that aren't
    the whole name, then 'medium' for medium terms, else 'strong'."""
    usual = F.lit(False)
    if term in protected:
        for f in forms:
            usual = usual | name.endswith(f)
    part = (name != term) if term in weak else F.lit(False)
    return F.when(usual | part, "weak").otherwise("medium" if term in medium else "strong")


def risk(strengths: Column) -> Column:
    """high, medium or weak by the strongest hit; none without hits."""
    return F.when(F.array_contains(strengths, "strong"), "high").when(F.array_contains(strengths, "medium"), "medium").when(F.size(strengths) > 0, "weak").otherwise("none")


def number_text(value: Column, precision: int = 0) -> Column:
    return F.format_number(value, precision)


def percent_text(value: Column, precision: int = 2) -> Column:
    return F.concat(F.format_number(value * 100, precision), F.lit("%"))


def time_text(value: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(value, pattern)


def truncated(text: Column, most: int = 50, ending: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(ending)), F.lit(ending))).otherwise(text)


def latex_text(text: Column) -> Column:
    """Text with the characters escaped that LaTeX reads as commands."""
    hold = "\x00"
    out = F.replace(text, F.lit("\\"), F.lit(hold))
    out = F.regexp_replace(out, r"([&%$#_{}])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
    return F.replace(out, F.lit(hold), F.lit(r"\textbackslash{}"))
