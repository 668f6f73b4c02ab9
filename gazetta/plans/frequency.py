"""Queries on character, affix and n-gram frequencies over parts as places."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetta.functions import stats, text
from gazetta.operators import api, frequency, ngrams, regions
from gazetta.sources.schema import PARTS, PLACES_SQL, places

from .registry import query, rounded

CITY, COUNTY, TOWN = ["city"], ["city", "county"], ["city", "county", "township"]
LETTERS = r"a-z"


def _items():
    return F.filter(text.character_set(F.col("name")), lambda c: c != " ")


_CHARS = f"{PLACES_SQL}, chars AS (SELECT id, city, county, township, unnest(list_distinct(string_split(replace(name, ' ', ''), ''))) AS char FROM places WHERE length(replace(name, ' ', '')) > 0)"
_GLOBAL = "tot AS (SELECT count(*) AS total_villages FROM places), g AS (SELECT char, count(*) AS village_count FROM chars GROUP BY char)"
_REG = "rt AS (SELECT {k}, count(*) AS total_villages FROM places GROUP BY {k}), r AS (SELECT {k}, char, count(*) AS village_count FROM chars GROUP BY {k}, char)"


def _joined_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    rk = ", ".join(f"r.{x}" for x in keys)
    return (
        f"WITH {_CHARS}, {_GLOBAL}, {_REG.format(k=k)}, "
        f"j AS (SELECT {rk}, r.char, r.village_count AS n, rt.total_villages AS t, g.village_count AS gc, (SELECT total_villages FROM tot) AS gt, "
        f"r.village_count::DOUBLE / rt.total_villages AS p, g.village_count::DOUBLE / (SELECT total_villages FROM tot) AS q "
        f"FROM r JOIN rt USING ({k}) JOIN g USING (char)) "
    )


def _joined(spark, sf_dir, keys):
    p = places(spark, sf_dir)
    return frequency.with_global(frequency.regional_frequency(p, _items(), keys), frequency.global_frequency(p, _items()))


@query(f"WITH {_CHARS}, {_GLOBAL} SELECT char, village_count, total_villages, round(village_count::DOUBLE / total_villages, 6) AS frequency, row_number() OVER (ORDER BY village_count DESC, char) AS rank FROM g, tot")
def char_freq_global(spark, sf_dir):
    return rounded(frequency.global_frequency(places(spark, sf_dir), _items()))


@query(
    _joined_sql(COUNTY)
    + "SELECT city, county, char, n AS village_count, t AS total_villages, round(p, 6) AS frequency, dense_rank() OVER (PARTITION BY city, county ORDER BY p DESC) AS rank_within_region FROM j"
)
def char_freq_region(spark, sf_dir):
    return rounded(frequency.regional_frequency(places(spark, sf_dir), _items(), COUNTY))


_LOGIT = "ln(least(greatest({x}, 1e-10), 1 - 1e-10) / (1 - least(greatest({x}, 1e-10), 1 - 1e-10)))"
_ZB = "CASE WHEN t * q * (1 - q) < 1e-10 THEN 0.0 ELSE (n - t * q) / sqrt(t * q * (1 - q)) END"
_TEND = (
    "z AS (SELECT *, p / q AS lift, ln(p / q) AS log_lift, "
    + _LOGIT.format(x="p") + " - " + _LOGIT.format(x="q")
    + f" AS log_odds, {_ZB} AS z_score, (gc >= 20 AND n >= 5) AS support_flag FROM j)"
)


@query(
    _joined_sql(COUNTY) + ", " + _TEND
    + " SELECT city, county, char, n AS village_count, gc AS global_count, round(lift, 6) AS lift, round(log_lift, 6) AS log_lift, round(log_odds, 6) AS log_odds, round(z_score, 6) AS z_score, support_flag, "
    "dense_rank() OVER (PARTITION BY city, county ORDER BY round(lift, 9) DESC) AS rank_overrepresented, dense_rank() OVER (PARTITION BY city, county ORDER BY round(lift, 9)) AS rank_underrepresented FROM z"
)
def char_tendency(spark, sf_dir):
    joined = _joined(spark, sf_dir, COUNTY).withColumn("lift", F.round("lift", 9))
    out = frequency.tendency(joined, COUNTY)
    return rounded(out.select(*COUNTY, "char", "village_count", "global_count", "lift", "log_lift", "log_odds", "z_score", "support_flag", "rank_overrepresented", "rank_underrepresented"))


@query(
    _joined_sql(COUNTY) + ", " + _TEND
    + " SELECT city, county, char, round(z_score, 6) AS z_score, dense_rank() OVER (PARTITION BY city, county ORDER BY round(z_score, 6) DESC) AS rank_overrepresented FROM z"
)
def tendency_rank_z(spark, sf_dir):
    joined = _joined(spark, sf_dir, COUNTY)
    rank = F.dense_rank().over(frequency.Window.partitionBy(*COUNTY).orderBy(F.desc("z_score")))
    out = rounded(frequency.tendency(joined, COUNTY, by="z_score").select(*COUNTY, "char", "z_score"))
    return out.withColumn("rank_overrepresented", rank.cast("long"))


_YATES = (
    "CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <= 0 THEN 0.0 ELSE pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0.0), 2) * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d)) END"
)
_CELLS = "k AS (SELECT *, n::DOUBLE AS a, (t - n)::DOUBLE AS b, (gc - n)::DOUBLE AS c, (gt - t - (gc - n))::DOUBLE AS d FROM j), y AS (SELECT *, " + _YATES + " AS chi2 FROM k)"
_STARS = "CASE WHEN chi2 > 10.827566 THEN '***' WHEN chi2 > 6.634897 THEN '**' WHEN chi2 > 3.841459 THEN '*' ELSE 'ns' END"


@query(
    _joined_sql(COUNTY) + ", " + _CELLS
    + f" SELECT city, county, char, round(chi2, 6) AS chi2, round({stats.erfc_sql('sqrt(chi2 / 2)')}, 6) AS p_value, {_STARS} AS significance, round(sqrt(chi2 / gt), 6) AS cramers_v, "
    "CASE WHEN sqrt(chi2 / gt) < 0.1 THEN 'small' WHEN sqrt(chi2 / gt) < 0.3 THEN 'medium' ELSE 'large' END AS effect FROM y"
)
def char_chi2_yates(spark, sf_dir):
    out = frequency.significance(_joined(spark, sf_dir, COUNTY))
    return rounded(out.select(*COUNTY, "char", "chi2", "p_value", "significance", "cramers_v", "effect"))


@query(
    _joined_sql(COUNTY)
    + ", y AS (SELECT *, CASE WHEN t * q <= 0 OR t * (1 - q) <= 0 THEN 0.0 ELSE pow(n - t * q, 2) / (t * q) + pow(n - t * q, 2) / (t * (1 - q)) END AS chi2 FROM j) "
    "SELECT city, county, char, round(chi2, 6) AS chi2, chi2 > 3.841459 AS is_significant, round(sqrt(chi2 / t), 6) AS effect_size, "
    "CASE WHEN sqrt(chi2 / t) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / t) < 0.3 THEN 'small' WHEN sqrt(chi2 / t) < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM y"
)
def char_chi2_gof(spark, sf_dir):
    out = frequency.goodness_of_fit(_joined(spark, sf_dir, COUNTY))
    return rounded(out.select(*COUNTY, "char", "chi2", "is_significant", "effect_size", "effect"))


@query(
    _joined_sql(CITY)
    + ", w AS (SELECT *, 1.959963984540054 AS z FROM j) SELECT city, char, "
    "round(greatest(0, (p + z * z / (2 * t) - z * sqrt(p * (1 - p) / t + z * z / (4.0 * t * t))) / (1 + z * z / t)), 6) AS ci_lower, "
    "round(least(1, (p + z * z / (2 * t) + z * sqrt(p * (1 - p) / t + z * z / (4.0 * t * t))) / (1 + z * z / t)), 6) AS ci_upper FROM w"
)
def wilson_ci(spark, sf_dir):
    return rounded(frequency.significance(_joined(spark, sf_dir, CITY)).select("city", "char", "ci_lower", "ci_upper"))


@query(
    _joined_sql(CITY) + ", " + _TEND
    + " SELECT city, char, round(log_odds, 6) AS log_odds FROM z WHERE support_flag ORDER BY round(abs(log_odds), 6) DESC, city, char LIMIT 20"
)
def polarized_topk(spark, sf_dir):
    out = rounded(frequency.tendency(_joined(spark, sf_dir, CITY), CITY).select("city", "char", "log_odds", "support_flag"))
    return frequency.polarised(out, "log_odds", 20, ["city", "char"]).drop("support_flag")


@query(
    _joined_sql(CITY) + ", " + _TEND
    + ", x AS (SELECT city, char, round(z_score, 6) AS z_score FROM z) SELECT * FROM (SELECT city, char, z_score, row_number() OVER (PARTITION BY city ORDER BY z_score DESC, char) AS position FROM x) WHERE position <= 5"
)
def region_profile_topk(spark, sf_dir):
    out = rounded(frequency.tendency(_joined(spark, sf_dir, CITY), CITY).select("city", "char", "z_score"))
    return frequency.top_per_region(out, CITY, [F.desc("z_score"), F.asc("char")], 5)


_AFFIX = f"{PLACES_SQL}, a AS (SELECT city, county, right(name, 2) AS pattern FROM places WHERE length(name) >= 2)"


@query(f"WITH {_AFFIX}, t AS (SELECT count(*) AS total_villages FROM a) SELECT pattern, count(*) AS village_count, any_value(total_villages) AS total_villages, round(count(*)::DOUBLE / any_value(total_villages), 6) AS frequency, row_number() OVER (ORDER BY count(*) DESC, pattern) AS rank FROM a, t GROUP BY pattern")
def affix_freq_global(spark, sf_dir):
    a = frequency.affix(places(spark, sf_dir), "suffix", 2)
    return rounded(frequency.global_frequency(a, F.array("pattern"), "pattern"))


@query(
    f"WITH {_AFFIX}, tot AS (SELECT count(*) AS gt FROM a), g AS (SELECT pattern, count(*) AS gc FROM a GROUP BY pattern), rt AS (SELECT city, count(*) AS t FROM a GROUP BY city), r AS (SELECT city, pattern, count(*) AS n FROM a GROUP BY city, pattern), "
    f"j AS (SELECT r.city, r.pattern, n, t, gc, gt, n::DOUBLE / t AS p, gc::DOUBLE / gt AS q FROM r JOIN rt USING (city) JOIN g USING (pattern), tot), {_TEND} "
    "SELECT city, pattern, n AS village_count, round(lift, 6) AS lift, round(log_odds, 6) AS log_odds, round(z_score, 6) AS z_score, support_flag FROM z"
)
def affix_tendency(spark, sf_dir):
    a = frequency.affix(places(spark, sf_dir), "suffix", 2)
    items = F.array("pattern")
    joined = frequency.with_global(frequency.regional_frequency(a, items, CITY, "pattern"), frequency.global_frequency(a, items, "pattern"), "pattern")
    return rounded(frequency.tendency(joined, CITY, item="pattern").select("city", "pattern", "village_count", "lift", "log_odds", "z_score", "support_flag"))


_GRAMS = (
    f"{PLACES_SQL}, seqs AS (SELECT id, city, county, n, [substr(name, i, n) for i in range(1, length(name) - n + 2)] AS grams FROM places, (VALUES (2), (3)) s(n) WHERE length(name) >= n), "
    "occ AS (SELECT city, county, n, 'all' AS position, unnest(grams) AS ngram FROM seqs UNION ALL SELECT city, county, n, 'prefix', grams[1] FROM seqs UNION ALL SELECT city, county, n, 'suffix', grams[len(grams)] FROM seqs "
    "UNION ALL SELECT city, county, n, 'middle', unnest(grams[2:len(grams) - 1]) FROM seqs WHERE len(grams) > 2), "
    "gf AS (SELECT n, position, ngram, count(*) AS frequency FROM occ GROUP BY ALL), gg AS (SELECT *, CAST(sum(frequency) OVER (PARTITION BY n, position) AS BIGINT) AS total FROM gf), "
    "cf AS (SELECT city, n, position, ngram, count(*) AS frequency FROM occ GROUP BY ALL), cc AS (SELECT *, CAST(sum(frequency) OVER (PARTITION BY city, n, position) AS BIGINT) AS total FROM cf)"
)


def _grams(spark, sf_dir, keys):
    return ngrams.ngram_counts(ngrams.ngram_rows(places(spark, sf_dir), (2, 3), keys), keys)


@query(f"WITH {_GRAMS} SELECT n, position, ngram, frequency, total, round(100 * frequency::DOUBLE / total, 6) AS percentage FROM gg")
def ngram_freq_positional(spark, sf_dir):
    return rounded(_grams(spark, sf_dir, []))


@query(f"WITH {_GRAMS} SELECT * FROM (SELECT city, n, position, ngram, frequency, total, round(100 * frequency::DOUBLE / total, 6) AS percentage, row_number() OVER (PARTITION BY city, n, position ORDER BY frequency DESC, ngram) AS position_rank FROM cc) WHERE position_rank <= 3")
def ngram_region_share_topk(spark, sf_dir):
    return rounded(ngrams.top_share(_grams(spark, sf_dir, CITY), CITY, 3))


_NT = (
    "nj AS (SELECT cc.city, n, position, ngram, cc.frequency AS rc, cc.total AS rt, gg.frequency AS gc, gg.total AS gt FROM cc JOIN gg USING (n, position, ngram)), "
    "ny AS (SELECT *, rc::DOUBLE AS a, (rt - rc)::DOUBLE AS b, (gc - rc)::DOUBLE AS c, (gt - rt - (gc - rc))::DOUBLE AS d FROM nj), nz AS (SELECT *, " + _YATES + " AS chi2 FROM ny)"
)


@query(
    f"WITH {_GRAMS}, {_NT} SELECT city, n, position, ngram, rc AS regional_count, gc AS global_count, round((rc::DOUBLE / rt) / (gc::DOUBLE / gt), 6) AS lift, "
    "round(ln((rc::DOUBLE / (rt - rc + 1)) / (gc::DOUBLE / (gt - gc + 1))), 6) AS log_odds, "
    "round(CASE WHEN rt * (gc::DOUBLE / gt) * (1 - gc::DOUBLE / gt) < 1e-10 THEN 0.0 ELSE (rc - rt * (gc::DOUBLE / gt)) / sqrt(rt * (gc::DOUBLE / gt) * (1 - gc::DOUBLE / gt)) END, 6) AS z_score FROM nj"
)
def ngram_tendency(spark, sf_dir):
    out = ngrams.ngram_tendency(_grams(spark, sf_dir, CITY), _grams(spark, sf_dir, []))
    return rounded(out.select("city", "n", "position", "ngram", "regional_count", "global_count", "lift", "log_odds", "z_score"))


@query(f"WITH {_GRAMS}, {_NT} SELECT city, n, position, ngram, round(chi2, 4) AS chi2, chi2 > 3.841459 AS is_significant, round(sqrt(chi2 / gt), 6) AS cramers_v FROM nz")
def ngram_significance_flag(spark, sf_dir):
    out = ngrams.ngram_significance(ngrams.ngram_tendency(_grams(spark, sf_dir, CITY), _grams(spark, sf_dir, [])))
    return out.select("city", "n", "position", "ngram", F.round("chi2", 4).alias("chi2"), "is_significant", F.round("cramers_v", 6).alias("cramers_v"))


@query(
    f"WITH {_GRAMS}, {_NT}, sig AS (SELECT city, n, position, ngram FROM nz WHERE chi2 > 3.841459 AND ((n = 2 AND rc >= 3) OR (n = 3 AND rc >= 2)) AND ((n = 2 AND gc >= 5) OR (n = 3 AND gc >= 3))) "
    "SELECT city, n, position, ngram, frequency, total FROM cc WHERE EXISTS (SELECT 1 FROM sig WHERE sig.city = cc.city AND sig.n = cc.n AND sig.position = cc.position AND sig.ngram = cc.ngram)"
)
def ngram_prune_semi(spark, sf_dir):
    regional = _grams(spark, sf_dir, CITY)
    test = ngrams.ngram_significance(ngrams.ngram_tendency(regional, _grams(spark, sf_dir, [])))
    keep = test.filter("is_significant").filter(ngrams.at_least("regional_count", {2: 3, 3: 2}) & ngrams.at_least("global_count", {2: 5, 3: 3}))
    return ngrams.prune(keep, regional, ["city", "n", "position", "ngram"]).select("city", "n", "position", "ngram", "frequency", "total")


@query(
    f"WITH {_GRAMS}, base AS (SELECT n, ngram, frequency FROM gf WHERE position = 'all'), ends AS (SELECT n, ngram, frequency, 'suffix' AS pattern_type, 'X' || right(ngram, 1) AS pattern FROM base UNION ALL SELECT n, ngram, frequency, 'prefix', left(ngram, 1) || 'X' FROM base "
    "UNION ALL SELECT n, ngram, frequency, 'frame', left(ngram, 1) || 'X' || right(ngram, 1) FROM base WHERE n > 2), ok AS (SELECT *, ((n = 2 AND frequency >= 10) OR (n = 3 AND frequency >= 5)) AS often FROM ends) "
    "SELECT n, pattern_type, pattern, count(*) AS distinct_ngrams, CAST(sum(CASE WHEN often THEN frequency ELSE 0 END) AS BIGINT) AS total, arg_min(ngram, (frequency, ngram)) FILTER (often) AS example FROM ok GROUP BY n, pattern_type, pattern HAVING count(*) >= 3 AND count(*) FILTER (often) > 0"
)
def ngram_templates(spark, sf_dir):
    return ngrams.templates(_grams(spark, sf_dir, []), {2: 10, 3: 5}, support=3)


@query(f"WITH {_GRAMS} SELECT city, n, position, count(*) AS distinct_total FROM cc GROUP BY ALL")
def ngram_distinct_totals(spark, sf_dir):
    return ngrams.distinct_totals(_grams(spark, sf_dir, CITY), CITY)


@query(
    f"WITH {PLACES_SQL} SELECT id, [substr(name, i, 2) for i in range(1, length(name))] AS bigrams, substr(name, 1, 2) AS prefix_bigram, right(name, 2) AS suffix_bigram, substr(name, 1, 3) AS prefix_trigram, right(name, 3) AS suffix_trigram FROM places"
)
def village_ngrams(spark, sf_dir):
    return ngrams.place_ngrams(places(spark, sf_dir)).select("id", "bigrams", "prefix_bigram", "suffix_bigram", "prefix_trigram", "suffix_trigram")


@query(
    f"WITH {_CHARS}, ch AS (SELECT city, county, township, char, grouping(county) AS gc, grouping(township) AS gt, count(*) AS village_count FROM chars GROUP BY GROUPING SETS ((city, char), (city, county, char), (city, county, township, char))), "
    "pl AS (SELECT city, county, township, grouping(county) AS gc, grouping(township) AS gt, count(*) AS total_villages FROM places GROUP BY GROUPING SETS ((city), (city, county), (city, county, township))) "
    "SELECT CASE WHEN ch.gc = 1 THEN 'city' WHEN ch.gt = 1 THEN 'county' ELSE 'township' END AS region_level, ch.city, ch.county, ch.township, char, village_count, total_villages, round(village_count::DOUBLE / total_villages, 6) AS frequency "
    "FROM ch JOIN pl ON ch.gc = pl.gc AND ch.gt = pl.gt AND ch.city = pl.city AND ch.county IS NOT DISTINCT FROM pl.county AND ch.township IS NOT DISTINCT FROM pl.township"
)
def char_freq_all_levels(spark, sf_dir):
    out = frequency.all_levels(places(spark, sf_dir), _items(), PARTS.hierarchy)
    return rounded(out.select("region_level", *TOWN, "char", "village_count", "total_villages", "frequency"))


@query(
    f"WITH {PLACES_SQL} SELECT CASE WHEN grouping(county) = 1 THEN 'city' WHEN grouping(township) = 1 THEN 'county' ELSE 'township' END AS region_level, city, county, township, count(*) AS villages, count(DISTINCT name) AS names, round(avg(length(name)), 6) AS avg_length FROM places GROUP BY GROUPING SETS ((city), (city, county), (city, county, township))"
)
def hierarchy_counts_rollup(spark, sf_dir):
    out = regions.rollup(places(spark, sf_dir), PARTS.hierarchy, F.count(F.lit(1)).alias("villages"), F.countDistinct("name").alias("names"), F.avg(F.length("name")).alias("avg_length"))
    return rounded(out.select("region_level", *TOWN, "villages", "names", "avg_length"))


@query(
    f"WITH {_CHARS} SELECT count(*) AS villages, count(DISTINCT city) AS n_city, count(DISTINCT (city, county)) AS n_county, count(DISTINCT (city, county, township)) AS n_township, (SELECT count(DISTINCT char) FROM chars) AS n_chars FROM places"
)
def metadata_overview(spark, sf_dir):
    return regions.overview(places(spark, sf_dir), PARTS.hierarchy, _items())


@query(f"WITH {PLACES_SQL} SELECT city, county, count(*) AS villages, count(DISTINCT township) AS townships, min(length(name)) AS shortest, max(length(name)) AS longest FROM places GROUP BY city, county")
def region_basic_stats(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.groupBy(*COUNTY).agg(F.count(F.lit(1)).alias("villages"), F.countDistinct("township").alias("townships"), F.min(F.length("name")).cast("long").alias("shortest"), F.max(F.length("name")).cast("long").alias("longest"))


@query(f"WITH {PLACES_SQL} SELECT DISTINCT city, county FROM places WHERE city IS NOT NULL AND county IS NOT NULL")
def regional_hierarchy(spark, sf_dir):
    return places(spark, sf_dir).select(*COUNTY).dropna().distinct()


@query(f"WITH {PLACES_SQL}, top AS (SELECT city, right(name, 2) AS value, count(*) AS n, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, right(name, 2)) AS rk FROM places WHERE length(name) >= 2 GROUP BY city, right(name, 2)) SELECT city, string_agg(value || ':' || n, ',' ORDER BY rk) AS top_suffixes FROM top WHERE rk <= 5 GROUP BY city")
def region_aggregates_topn(spark, sf_dir):
    m = frequency.morphology(places(spark, sf_dir))
    out = regions.top_values(m, CITY, "suffix_2", 5)
    return out.select("city", F.array_join(F.transform("top_suffix_2", lambda x: F.concat_ws(":", x["value"], x["n"])), ",").alias("top_suffixes"))


@query(
    f"WITH {PLACES_SQL}, f AS (SELECT city, count(*)::DOUBLE AS villages, avg(length(name)) AS avg_length FROM places GROUP BY city) "
    "SELECT city, round((villages - avg(villages) OVER ()) / stddev_samp(villages) OVER (), 3) AS villages_z, round((avg_length - avg(avg_length) OVER ()) / stddev_samp(avg_length) OVER (), 3) AS avg_length_z FROM f"
)
def region_feature_zscores(spark, sf_dir):
    f = places(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).cast("double").alias("villages"), F.avg(F.length("name")).alias("avg_length"))
    return regions.feature_z(f, ["villages", "avg_length"]).select("city", "villages_z", "avg_length_z")


@query(
    _joined_sql(CITY) + ", " + _CELLS
    + f", pv AS (SELECT city, char, round({stats.erfc_sql('sqrt(chi2 / 2)')}, 9) AS p_value FROM y), rk AS (SELECT *, row_number() OVER (ORDER BY p_value, city, char) AS r, count(*) OVER () AS m FROM pv), "
    "raw AS (SELECT *, p_value * m / r AS x FROM rk) SELECT city, char, round(p_value, 6) AS p_value, round(least(1.0, min(x) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS q_value FROM raw"
)
def bh_fdr(spark, sf_dir):
    out = frequency.significance(_joined(spark, sf_dir, CITY)).select("city", "char", F.round("p_value", 9).alias("p_value"))
    out = regions.benjamini_hochberg(out, "p_value", ["city", "char"])
    return out.select("city", "char", F.round("p_value", 6).alias("p_value"), F.round("q_value", 5).alias("q_value"))


@query(f"WITH {PLACES_SQL} SELECT id, city, county, name FROM places WHERE contains(name, 're') AND city = 'Brand#12' ORDER BY id LIMIT 10 OFFSET 5")
def search_page(spark, sf_dir):
    found = api.search(places(spark, sf_dir), "re", city="Brand#12")
    return found.orderBy("id").offset(5).limit(10).select("id", "city", "county", "name")


@query(f"WITH {PLACES_SQL} SELECT id, name FROM places WHERE starts_with(name, 's') AND length(name) BETWEEN 5 AND 14 AND substr(name, 2, 1) = 'm'")
def subset_filter(spark, sf_dir):
    wanted = api.Subset(starts="s", length=(5, 14), character_at=(2, "m"))
    return api.subset(places(spark, sf_dir), wanted).select("id", "name")


@query(
    f"WITH {PLACES_SQL}, o AS (SELECT id, city, md5('42|' || id) AS d FROM places), r AS (SELECT id, city, row_number() OVER (PARTITION BY city ORDER BY d, id) AS r, greatest(1, floor(count(*) OVER (PARTITION BY city) * 0.1)) AS q FROM o) SELECT id, city FROM r WHERE r <= q"
)
def stratified_hash_sample(spark, sf_dir):
    return regions.stratified_sample(places(spark, sf_dir), "city", 0.1, "id").select("id", "city")


@query(
    f"WITH {_CHARS}, {_GLOBAL}, best AS (SELECT char, village_count FROM g ORDER BY village_count DESC, char LIMIT 1000) SELECT md5(string_agg(char || ':' || village_count, '' ORDER BY village_count DESC, char)) AS checksum FROM best"
)
def checksum(spark, sf_dir):
    from gazetta.sources.storage import checksum as digest

    return digest(frequency.global_frequency(places(spark, sf_dir), _items()), "char", "village_count")


@query(
    f"WITH {_CHARS}, {_GLOBAL}, e AS (SELECT min(village_count) AS lo, max(village_count) AS hi FROM g) SELECT least(floor((village_count - lo) / ((hi - lo) / 10.0)), 9)::BIGINT AS bin, count(*) AS n FROM g, e GROUP BY 1"
)
def frequency_histogram(spark, sf_dir):
    return api.histogram(frequency.global_frequency(places(spark, sf_dir), _items()), "village_count", 10).select("bin", "n")


@query(
    _joined_sql(CITY) + ", " + _TEND
    + ", best AS (SELECT char, max(lift) AS max_lift FROM z GROUP BY char), gr AS (SELECT char, row_number() OVER (ORDER BY village_count DESC, char) AS rank FROM g) "
    "SELECT char, CAST((CASE WHEN rank <= 10 THEN 10 WHEN rank <= 30 THEN 5 WHEN rank <= 50 THEN 3 ELSE 0 END) + (CASE WHEN max_lift > 10 THEN 10 WHEN max_lift > 5 THEN 7 WHEN max_lift > 2 THEN 5 ELSE 0 END) + (CASE WHEN char IN ('a', 'e', 'i', 'o', 'u') THEN 3 ELSE 0 END) AS BIGINT) AS score FROM gr JOIN best USING (char)"
)
def character_scores(spark, sf_dir):
    overall = frequency.global_frequency(places(spark, sf_dir), _items())
    best = _joined(spark, sf_dir, CITY).groupBy("char").agg(F.max("lift").alias("max_lift"))
    return api.character_score(overall, best, list("aeiou")).select("char", "score")
