"""Cleaning, affixes, n-grams and prefixes on hand-made names."""

import pytest
from pyspark.sql import functions as F

from gazetta.functions import text


def one(spark, column, **values):
    names = [*values]
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("natural", "admin", "name", "removed", "rule"),
    [
        ("青岗村北坡", "青岗村", "北坡", "青岗村", "rule1_delimiter"),
        ("柳塘村白沙社区东园", "红星二村", "东园", "柳塘村白沙社区", "rule1_delimiter"),
        ("云台小店尾", "云台村", "小店尾", "云台", "rule2_admin_match"),
        ("长桥坊里", "云台村", "长桥坊里", "", "none"),
        ("大青岗渡口", "青岗村", "渡口", "大青岗", "rule3_modifier"),
        ("", "青岗村", "", "", "empty_name"),
        ("柳塘村西", "柳塘村", "柳塘村西", "", "none"),
        ("云台村", "云台村", "云台村", "", "rule5_identical"),
    ],
)
def test_prefixes(spark, natural, admin, name, removed, rule):
    got = one(spark, text.clean_prefix(F.col("n"), F.col("a")), n=natural, a=admin)
    assert (got["name"], got["removed"], got["rule"]) == (name, removed, rule)


@pytest.mark.parametrize(("name", "base"), [("东村一村", "东村"), ("南岭二", "南岭"), ("岭二十三", "岭"), ("石一桥", "石一桥"), ("一", "一"), ("", "")])
def test_numbered(spark, name, base):
    got = one(spark, text.numbered(F.col("n")), n=name)
    assert got["base"] == base and got["is_numbered"] == (base != name)


@pytest.mark.parametrize(
    ("raw", "clean", "brackets", "noise", "reason"),
    [
        ("石岭村", "石岭村", False, False, None),
        ("石岭（旧）村", "石岭村", True, False, None),
        ("石岭(old)村2", "石岭村", True, True, None),
        ("abc123", "", False, True, "no_chinese_chars"),
        ("  ", "", False, False, "null_or_empty"),
        (None, "", False, False, "null_or_empty"),
        ("𠀀㐀村", "𠀀㐀村", False, False, None),
    ],
)
def test_cleaning(spark, raw, clean, brackets, noise, reason):
    got = one(spark, text.cleaned(F.col("n")), n=raw)
    assert (got["clean_name"], got["had_brackets"], got["had_noise"], got["invalid_reason"]) == (clean, brackets, noise, reason)
    assert got["is_valid"] == (reason is None)


def test_too_short(spark):
    assert one(spark, text.cleaned(F.col("n"), least=2), n="村")["invalid_reason"] == "too_short_1"


def test_cjk_ranges(spark):
    assert one(spark, text.is_cjk(F.col("n")), n="㐀") and not one(spark, text.is_cjk(F.col("n"), False), n="㐀")


def test_characters_and_affixes(spark):
    assert one(spark, text.character_set(F.col("n")), n="石石岭岭村") == sorted("石岭村")
    assert one(spark, text.characters(F.col("n")), n="a𡌶b") == ["a", "𡌶", "b"]
    assert one(spark, text.suffix(F.col("n"), 2), n="石岭村") == "岭村" and one(spark, text.suffix(F.col("n"), 4), n="石岭村") is None
    assert one(spark, text.prefix(F.col("n"), 2), n="石岭村") == "石岭"


def test_ngrams(spark):
    got = [(r["position"], r["ngram"]) for r in one(spark, text.positional_ngrams(F.col("n"), 2), n="abcd")]
    assert got == [("all", "ab"), ("all", "bc"), ("all", "cd"), ("prefix", "ab"), ("suffix", "cd"), ("middle", "bc")]
    got = [(r["position"], r["ngram"]) for r in one(spark, text.positional_ngrams(F.col("n"), 2), n="ab")]
    assert got == [("all", "ab"), ("prefix", "ab"), ("suffix", "ab")]
    assert one(spark, text.positional_ngrams(F.col("n"), 2), n="a") == []


def test_admin_names(spark):
    assert one(spark, text.admin_base(F.col("n")), n="石桥社区居委会") == "石桥"
    assert one(spark, text.admin_base(F.col("n")), n="李村") == "李村"
    assert one(spark, text.without_delimiters(F.col("n")), n="陈家村石桥社区") == "陈家石桥"


def test_distances(spark):
    assert one(spark, text.limited_distance(F.col("a"), F.col("b"), 1), a="石岭村", b="石山村") == 1
    assert one(spark, text.limited_distance(F.col("a"), F.col("b"), 1), a="石岭村", b="大山村") == 2
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="abcd", b="abce") == 0.75
    assert one(spark, text.shared_ratio(F.col("a"), F.col("b")), a="aab", b="abb") == pytest.approx(2 / 3)


def test_keys_and_formats(spark):
    assert one(spark, text.romanised_key(F.col("n")), n="Shí Lǐng-cūn") == "shilingcun"
    assert one(spark, text.variants(F.col("n"), {"石": "时", "下": "夏"}), n="石下") == ["时下", "石夏"]
    assert one(spark, text.truncated(F.col("n"), 8), n="abcdefghij") == "abcde..."
    assert one(spark, text.latex_text(F.col("n")), n=r"a_b & 5% \x ~") == r"a\_b \& 5\% \textbackslash{}x \textasciitilde{}"
    assert one(spark, text.percent_text(F.lit(0.1234)), n="") == "12.34%"
    strength = text.term_strength(F.col("n"), "厂", weak=("厂",), medium=("厂",))
    assert one(spark, strength, n="砖厂") == "weak" and one(spark, strength, n="厂") == "medium"
    assert one(spark, text.risk(F.array(F.lit("weak"), F.lit("strong"))), n="") == "high" and one(spark, text.risk(F.array().cast("array<string>")), n="") == "none"
