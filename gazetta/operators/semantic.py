"""Lexicon-driven tags, term frequencies, indices, sequences and co-occurrence.

A lexicon is a few hundred characters: its maps go into the plan as literals, so
tagging needs neither a join nor a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import stats, text


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def by_category(labels: dict[str, str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for char, category in labels.items():
        out.setdefault(category, []).append(char)
    return out


def tags(places: DataFrame, labels: dict[str, str], name: str = "name", prefix: str = "sem_") -> DataFrame:
    """A 0/1 column per category: whether the name has one of its characters."""
    chars = text.characters(F.col(name))
    return places.withColumns({f"{prefix}{c}": F.arrays_overlap(chars, _literals(members)).cast("int") for c, members in by_category(labels).items()})


def scores(places: DataFrame, groups: dict[str, list[str]], name: str = "name") -> DataFrame:
    """id columns and, per category, how many of its characters the name has."""
    chars = text.character_set(F.col(name))
    return places.withColumns({f"score_{c}": F.size(F.array_intersect(chars, _literals(members))) for c, members in groups.items()})


def term_frequency(frequency: DataFrame, lex: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """Per region and category the sum of its characters' document counts, zeros included.

    A place counts once for each different character, so the rate may pass 1.
    """
    cats = lex.select(category).distinct()
    members = lex.select(category, "char").distinct()
    sums = frequency.join(F.broadcast(members), "char").groupBy(*keys, category).agg(F.sum("village_count").alias("vtf_count"))
    regions = frequency.select(*keys, "total_villages").distinct()
    dense = regions.join(F.broadcast(cats))  # a few categories beside each region
    out = dense.join(sums, [*keys, category], "left").fillna({"vtf_count": 0})
    return out.withColumn("frequency", stats.ratio(F.col("vtf_count"), F.col("total_villages")))


def term_tendency(regional: DataFrame, overall: DataFrame, category: str = "category") -> DataFrame:
    g = overall.select(category, F.col("vtf_count").alias("global_count"), F.col("total_villages").alias("global_total"), F.col("frequency").alias("global_frequency"))
    out = regional.join(F.broadcast(g), category)
    p, q = F.col("frequency"), F.col("global_frequency")
    out = out.withColumn("lift", F.coalesce(stats.lift(p, q), F.lit(0.0)))
    return out.withColumns(
        {
            "log_lift": F.when(F.col("lift") > 0, F.ln("lift")).otherwise(F.lit(0.0)),
            "log_odds": stats.log_odds(p, q),
            "z_score": stats.z_rate(F.col("vtf_count"), F.col("total_villages"), F.col("global_count"), F.col("global_total")),
            "support_flag": F.col("vtf_count") >= 10,
        }
    )


def indices(scored: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Per region and category: mean score, its ratio to the corpus's, z, rank among regions."""
    long = scored.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"score_{c}").alias("score")) for c in categories])).alias("s")).select(*keys, "s.*")
    here = long.dropna(subset=keys).groupBy(*keys, "category").agg(F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("village_count"))
    everywhere = long.groupBy("category").agg(stats.ratio(F.sum("score"), F.count(F.lit(1))).alias("global_intensity"))
    out = here.join(F.broadcast(everywhere), "category").withColumn("raw_intensity", stats.ratio(F.col("score_sum"), F.col("village_count")))
    out = out.withColumns(
        {
            "normalized_index": F.coalesce(stats.ratio(F.col("raw_intensity"), F.col("global_intensity")), F.lit(0.0)),
            "z_score": stats.z_sum(F.col("score_sum"), F.col("village_count"), F.col("global_intensity")),
        }
    )
    rank = F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc("normalized_index")))
    return out.withColumn("rank_within_province", rank.cast("long"))


def sequence(name: Column, labels: dict[str, str], letters: str | None = None) -> Column:
    """The category of each character, 'other' without one; `letters` limits which count."""
    chars = text.characters(name)
    if letters:
        chars = F.filter(chars, lambda c: c.rlike(f"[{letters}]"))
    table = F.create_map(*[F.lit(x) for p in labels.items() for x in p])
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("other")))


def runs(seq: Column, n: int) -> Column:
    """All runs of n labels, as arrays."""
    count = F.size(seq) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(seq, i, n))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def label_ngrams(sequences: DataFrame, n: int, column: str = "sequence") -> DataFrame:
    rows = sequences.select(F.explode(runs(F.col(column), n)).alias("labels"))
    counts = rows.groupBy("labels").agg(F.count(F.lit(1)).alias("frequency"))
    total = F.sum("frequency").over(Window.partitionBy())
    return counts.withColumn("percentage", 100 * stats.ratio(F.col("frequency"), total)).select(*[F.get("labels", i).alias(f"label_{i + 1}") for i in range(n)], "frequency", "percentage")


def bigram_pmi(bigrams: DataFrame) -> DataFrame:
    """PMI of adjacent labels; a label's mass counts both its places."""
    both = bigrams.select(F.explode(F.array("label_1", "label_2")).alias("label"), "frequency")
    single = both.groupBy("label").agg(F.sum("frequency").alias("mass"))
    total = F.sum("frequency").over(Window.partitionBy())
    out = bigrams.withColumn("total", total)
    out = out.join(F.broadcast(single.withColumnsRenamed({"label": "label_1", "mass": "mass_1"})), "label_1")
    out = out.join(F.broadcast(single.withColumnsRenamed({"label": "label_2", "mass": "mass_2"})), "label_2")
    value = stats.pmi(F.col("frequency"), F.col("mass_1"), F.col("mass_2"), F.col("total"), 2 * F.col("total"))
    return out.withColumn("pmi", value).withColumn("is_positive", F.col("pmi") > 0).select("label_1", "label_2", "frequency", "pmi", "is_positive")


def pattern_rules(bigrams: DataFrame, rules: list[tuple[str, set[str], set[str]]]) -> DataFrame:
    """The first rule (name, first labels, second labels) that a bigram meets, with its
    share of all bigrams that meet one."""
    chosen = F.lit(None).cast("string")
    for label, first, second in reversed(rules):
        chosen = F.when(F.col("label_1").isin(*sorted(first)) & F.col("label_2").isin(*sorted(second)), label).otherwise(chosen)
    out = bigrams.filter("label_1 <> 'other' AND label_2 <> 'other'").withColumn("pattern", chosen).filter("pattern IS NOT NULL")
    return out.withColumn("pattern_share", 100 * stats.ratio(F.col("frequency"), F.sum("frequency").over(Window.partitionBy())))


def conflicts(sequences: DataFrame, pairs: list[tuple[str, str]], below: int, column: str = "sequence") -> DataFrame:
    """Sequences rarer than `below` that hold an incompatible pair of labels."""
    counts = sequences.groupBy(F.array_join(column, "-").alias("sequence")).agg(F.count(F.lit(1)).alias("frequency"), F.first(column).alias("labels")).filter(F.col("frequency") < below)
    clash = reduce(lambda a, b: a | b, [F.array_contains("labels", x) & F.array_contains("labels", y) for x, y in pairs])
    return counts.filter(clash).select("sequence", "frequency")


def structures(places: DataFrame, labels: dict[str, str], name: str = "name", least: float = 0.5, roles: dict[str, set[str]] | None = None) -> DataFrame:
    """Label sequences of names whose characters are labelled to at least `least`."""
    seq = sequence(F.col(name), labels)
    out = places.withColumn("sequence", seq)
    known = F.size(F.filter("sequence", lambda c: c != "other"))
    out = out.withColumn("coverage", stats.ratio(known, F.size("sequence"))).filter(F.col("coverage") >= least)
    return out.withColumns({f"has_{role}": F.arrays_overlap("sequence", _literals(sorted(cats))) for role, cats in (roles or {}).items()})


def cooccurrence(places: DataFrame, labels: dict[str, str], name: str = "name") -> DataFrame:
    """first, second, n_both, n_first, n_second, total: in how many places two
    categories (also one with itself) occur; total counts all places."""
    seq = F.array_sort(F.array_distinct(F.filter(sequence(F.col(name), labels), lambda c: c != "other")))
    rows = places.select(seq.alias("cats"))
    total = places.agg(F.count(F.lit(1)).alias("total"))
    pairs = rows.select(F.explode(F.flatten(F.transform("cats", lambda a: F.transform(F.filter("cats", lambda b: b >= a), lambda b: F.struct(a.alias("first"), b.alias("second")))))).alias("p"))
    counts = pairs.groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n_both"))
    single = counts.filter("first = second")
    out = counts.join(F.broadcast(single.select("first", F.col("n_both").alias("n_first"))), "first")
    out = out.join(F.broadcast(single.select("second", F.col("n_both").alias("n_second"))), "second")
    return out.join(F.broadcast(total))  # a single row


def cooccurrence_measures(pairs: DataFrame) -> DataFrame:
    """PMI, contingency test, conditional probabilities and lift of each pair."""
    both, a, b, t = (F.col(c) for c in ("n_both", "n_first", "n_second", "total"))
    out = pairs.withColumn("chi2", stats.chi2_yates(both, a, b, t))
    return out.withColumns(
        {
            "support": stats.ratio(both, t),
            "pmi": stats.log2_pmi(both, a, b, t),
            "p_second_given_first": stats.ratio(both, a),
            "p_first_given_second": stats.ratio(both, b),
            "lift": stats.ratio(both * t, a * b),
            "is_significant": F.col("chi2") > stats.CRITICAL[0],
        }
    )


def category_entropy(pairs: DataFrame) -> DataFrame:
    """Entropy of each category's partners (itself left out) and their number."""
    both = pairs.filter("first <> second")
    rows = both.select(F.col("first").alias("category"), "n_both").unionByName(both.select(F.col("second").alias("category"), "n_both"))
    share = stats.ratio(F.col("n_both"), F.sum("n_both").over(Window.partitionBy("category")))
    return rows.withColumn("share", share).groupBy("category").agg((-F.sum(F.col("share") * F.log2(F.col("share") + 1e-10))).alias("entropy"), F.count(F.lit(1)).alias("partners"))


def coverage(places: DataFrame, known: list[str], keys: list[str], name: str = "name") -> DataFrame:
    """Per region: characters (with repeats) in the lexicon, and places covered in full or part."""
    chars = text.characters(F.col(name))
    lit = _literals(known)
    rows = places.select(*keys, F.size(chars).alias("n"), F.size(F.filter(chars, lambda c: F.array_contains(lit, c))).alias("k"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("villages"), F.sum("n").alias("occurrences"), F.sum("k").alias("labelled"),
        F.count_if((F.col("k") == F.col("n")) & (F.col("n") > 0)).alias("fully"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("partly"),
    )


def marginal_gain(places: DataFrame, known: list[str], name: str = "name") -> DataFrame:
    """Per unlabelled character: its document frequency, the places that it alone would complete, and their weight."""
    missing = F.array_except(text.character_set(F.col(name)), _literals(known))
    rows = places.select(F.explode(missing).alias("char"), (F.size(missing) == 1).alias("alone"))
    out = rows.groupBy("char").agg(F.count(F.lit(1)).alias("frequency"), F.count_if("alone").alias("unlocked"))
    out = out.withColumn("roi", 10 * F.col("unlocked") + F.col("frequency"))
    running = F.sum("unlocked").over(Window.orderBy(F.desc("roi"), "char").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("cumulative_unlocked", running)


def subcategory_tendency(frequency: DataFrame, overall: DataFrame, lex: DataFrame, keys: list[str]) -> DataFrame:
    """Per region and subcategory: characters, count, rate and its difference from the corpus's."""
    members = F.broadcast(lex.select("char", "category", "subcategory").distinct())
    name = ["category", "subcategory"]
    g = overall.join(members, "char").groupBy(*name).agg(stats.ratio(F.sum("village_count"), F.max("total_villages")).alias("global_share"))
    r = frequency.join(members, "char").groupBy(*keys, *name).agg(
        F.countDistinct("char").alias("chars"), F.sum("village_count").alias("vtf_count"), stats.ratio(F.sum("village_count"), F.max("total_villages")).alias("share")
    )
    return r.join(F.broadcast(g), name).withColumn("tendency", F.col("share") - F.col("global_share"))
