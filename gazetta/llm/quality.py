"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects a row. What a rule costs and how much it
rejects is measured on a bounded sample; the rules are then tried in the order of
rejections per cost, and a row's later rules aren't evaluated
after its first rejection. The order changes the cost, never the verdict: a row
is kept exactly when no rule rejects it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, picked, place

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 512
_BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than U+0020 and U+0009 to U+000D."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    The windows' 64-bit hashes are sorted as numbers, each with its position in
    as many low bits as the text needs; equal neighbours are compared by their whole
    hash. Texts without a repeated window end at the first test.
    """
    return _let(words, _repeated)  # bound once: an optimiser that moves the expression must not split the text for each word


def _repeated(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h)))

        def at(sorted_: Column, i: Column) -> Column:
            return F.call_function("shiftrightunsigned", F.get(sorted_, i), bits)

        def position(sorted_: Column, i: Column) -> Column:
            return F.get(sorted_, i).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))

        def marked(s: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return (at(s, i) == at(s, j)) & (F.get(h, position(s, i)) == F.get(h, position(s, j)))

            last = F.size(s) - 1
            twins = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < last, same(k, k + 1)).otherwise(False))
            starts = F.transform(twins, lambda k: position(s, k))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

        return _let(packed, marked)

    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 3, F.lit(0)).otherwise(counted).cast("long")


def _let(value: Column, body) -> Column:
    """Evaluates `value` once for all its uses in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules by name: the measures each one reads, and what it rejects. The first two are
#: the base rules; the others reject texts that are mostly marks, or whose words have lengths that
#: prose doesn't have, or that repeat most of their lines.
RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "too_few_words": (("n_words",), "n_words < 50"),
    "repetitive": (("n_repeat_words", "n_words"), "100 * n_repeat_words > 50 * n_words"),
    "symbols": (("n_symbols", "n_words"), "n_symbols > n_words"),
    "word_length": (("word_chars", "n_words"), "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    "duplicate_lines": (("n_dup_lines", "n_lines"), "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
}


def _prepared(df: DataFrame, text_col: str) -> DataFrame:
    """df with its columns numbered, __text and __words."""
    text = F.coalesce(F.col(place(df, text_col)).cast("string"), F.lit(""))
    return numbered(df).withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")


def _measure(name: str, text: Column | None = None, words: Column | None = None) -> Column:
    t, w = F.col("__text") if text is None else text, F.col("__words") if words is None else words
    made = {
        "n_words": lambda: F.size(w),
        "word_chars": lambda: F.length(F.translate(t, _BLANKS, "")),
        "n_symbols": lambda: F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_lines": lambda: F.size(_lines(t)),
        "n_dup_lines": lambda: _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": lambda: repeated_words(w),
    }
    return made[name]().cast("long")


def _rejects(rule: str, known: set[str], text: Column | None = None, words: Column | None = None) -> Column:
    """The rule's predicate, with those measures written out that aren't columns yet."""
    names, predicate = RULES[rule]
    struct = F.struct(*[(F.col(n) if n in known else _measure(n, text, words)).alias(n) for n in names])
    return _let(struct, lambda m: _predicate(predicate, m))


def _predicate(text: str, m: Column) -> Column:
    """A predicate text over fields of m: numbers, names, + * < > >= AND OR."""

    def value(term: str) -> Column:
        out = None
        for factor in term.split("*"):
            f = F.lit(int(factor)) if factor.strip().isdigit() else m[factor.strip()]
            out = f if out is None else out * f
        return out

    def compare(part: str) -> Column:
        for op, fn in ((">=", lambda a, b: a >= b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b)):
            if op in part:
                a, b = part.split(op)
                return fn(value(a), value(b))
        raise ValueError(f"no comparison in {part!r}")

    ors = None
    for clause in text.split(" OR "):
        ands = None
        for part in clause.split(" AND "):
            ands = compare(part) if ands is None else ands & compare(part)
        ors = ands if ors is None else ors | ands
    return ors


def estimate(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Cost (seconds) and share of rejected rows of each rule on a sample.

    The sample holds about `sample_rows` rows whatever the table's size. A rule's cost is the least time
    of two passes over it, less that of a pass without a rule, so that the start of a job isn't counted. An
    empty table gives zero shares, which keeps the rules' given order.
    """
    total = df.count()
    share = min(1.0, 1.2 * sample_rows / max(1, total))
    sample = _prepared(picked(df, text=(text_col, "string")).sample(share, seed).limit(sample_rows), "text").select("__text", "__words").persist()
    try:
        rows = sample.count()

        def passes(measure: Column) -> tuple[float, int]:
            best = float("inf")
            for _ in range(2):
                started = time.perf_counter()
                hit = sample.select(F.sum(measure).alias("n")).first()["n"]
                best = min(best, time.perf_counter() - started)
            return best, hit or 0

        idle, _ = passes(F.size("__words"))
        found = []
        for rule in RULES:
            took, hit = passes(_rejects(rule, set()).cast("int"))
            found.append({"rule": rule, "cost": max(took - idle, 1e-4), "rejected": hit / max(1, rows)})
        return found
    finally:
        sample.unpersist()


def ordered(estimates: list[dict]) -> list[str]:
    """Rules by rejections per cost, the given order among equals."""
    return [e["rule"] for e in sorted(estimates, key=lambda e: -e["rejected"] / max(e["cost"], 1e-9))]


def cascade(order: list[str], known: set[str], text: Column | None = None, words: Column | None = None) -> Column:
    """True when no rule rejects; later rules aren't evaluated after a rejection."""
    out = F.lit(True)
    for rule in reversed(order):
        out = F.when(_rejects(rule, known, text, words), F.lit(False)).otherwise(out)
    return out


def quality_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row.

    A null text has no words and fails; a null id stays null; repeated rows
    are each judged, alike; one very long text is one task's work, in time n log n;
    other columns are ignored; an empty table gives an empty result.
    """
    order = order or ordered(estimate(df, text_col))
    rows = _prepared(picked(df, doc_id=(id_col, "long"), text=(text_col, "string")), "text")
    measured = rows.select(F.col("__c0").alias("doc_id"), *[_measure(n).alias(n) for n in (*MEASURES, "n_lines")])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.select("doc_id", *MEASURES, failed.alias("base_failed"), cascade(order, {*MEASURES, "n_lines"}).alias("kept"))
    return out


def keep_good(df: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of df that no rule rejects, with df's own columns.

    A null text has no words and goes; null ids, repeated rows and clashing names stay as they are; a very
    long text is one task's work; an empty table stays empty.
    """
    order = order or ordered(estimate(df, text_col))
    text = F.coalesce(F.col(place(df, text_col)).cast("string"), F.lit(""))
    # text and words are bound once a row: a filter is moved below projections with all that it refers to
    both = F.struct(text.alias("t"), words_of(text).alias("w"))
    return numbered(df).filter(_let(both, lambda s: cascade(order, set(), s["t"], s["w"]))).toDF(*df.columns)
