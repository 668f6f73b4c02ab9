"""Queries on set operations, outer joins, pivots, rank tests, prefixes, datums and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetta.functions import geo, stats, text
from gazetta.operators import frequency, ngrams, regions, semantic
from gazetta.operators.dedup import deletions
from gazetta.sources.lexicon import LETTERS, label_pairs
from gazetta.sources.schema import PLACES_SQL, POINTS_SQL, places, points

from .frequency import _CHARS, _GRAMS, _TEND, CITY, COUNTY, _grams, _items, _joined, _joined_sql
from .registry import query, rounded

_ROLL = (
    f"WITH {_GRAMS}, dc AS (SELECT city, county, n, position, ngram, count(*) AS frequency FROM occ GROUP BY ALL), up AS (SELECT city, n, position, ngram, CAST(sum(frequency) AS BIGINT) AS frequency FROM dc GROUP BY ALL), "
    "ut AS (SELECT *, CAST(sum(frequency) OVER (PARTITION BY city, n, position) AS BIGINT) AS total, count(*) OVER (PARTITION BY city, n, position) AS distinct_total FROM up) "
)


@query(_ROLL + "SELECT ut.city, ut.n, ut.position, ut.ngram, ut.frequency, ut.distinct_total, round((ut.frequency::DOUBLE / ut.total) / (gg.frequency::DOUBLE / gg.total), 6) AS lift, round((ut.frequency::DOUBLE / ut.distinct_total) / (gg.frequency::DOUBLE / gg.total), 6) AS lift_of_distinct FROM ut JOIN gg ON gg.n = ut.n AND gg.position = ut.position AND gg.ngram = ut.ngram")
def ngram_rollup_lift(spark, sf_dir):
    """County counts summed up to cities, with lift over occurrences and over distinct n-grams."""
    county = _grams(spark, sf_dir, COUNTY)
    up = county.groupBy("city", "n", "position", "ngram").agg(F.sum("frequency").alias("frequency"))
    w = frequency.Window.partitionBy("city", "n", "position")
    up = up.withColumns({"total": F.sum("frequency").over(w), "distinct_total": F.count(F.lit(1)).over(w)})
    g = _grams(spark, sf_dir, []).select("n", "position", "ngram", stats.ratio(F.col("frequency"), F.col("total")).alias("q"))
    out = up.join(g, ["n", "position", "ngram"])
    f = F.col("frequency")
    return rounded(out.select("city", "n", "position", "ngram", "frequency", "distinct_total", stats.lift(stats.ratio(f, F.col("total")), F.col("q")).alias("lift"), stats.lift(stats.ratio(f, F.col("distinct_total")), F.col("q")).alias("lift_of_distinct")))


#: How part numbers become names: a parish, what may come between, and a hamlet, each by a remainder of the number.
_PARISHES, _BETWEEN, _HAMLETS = ("青岗", "柳塘", "云台"), ("村", "", "社区", "大"), ("北坡", "东园", "渡口", "尾")


def _nth(values: tuple[str, ...], by: int) -> str:
    return f"CASE (p_partkey // {by}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(
    f"WITH n AS (SELECT p_partkey AS id, {_nth(_PARISHES, 1)} AS parish, {_nth(_BETWEEN, 3)} AS between_, {_nth(_HAMLETS, 12)} AS hamlet, (p_partkey // 48) % 2 = 0 AS own FROM part), "
    "s AS (SELECT *, CASE WHEN between_ = '大' THEN '大' || parish ELSE parish || between_ END AS lead_, CASE WHEN own THEN parish ELSE '红星' END AS bare FROM n), "
    "r AS (SELECT *, CASE WHEN length(hamlet) < 2 THEN 'none' WHEN between_ IN ('村', '社区') THEN 'rule1_delimiter' WHEN NOT own THEN 'none' WHEN between_ = '大' THEN 'rule3_modifier' ELSE 'rule2_admin_match' END AS rule FROM s) "
    "SELECT id, CASE WHEN rule = 'none' THEN lead_ || hamlet ELSE hamlet END AS name, CASE WHEN rule = 'none' THEN '' ELSE lead_ END AS removed, rule FROM r"
)
def prefix_clean(spark, sf_dir):
    """Prefix rules over names made of every part's number; the SQL takes the names apart the way they were put together."""
    def nth(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / by) % len(values) + 1).cast("int"))

    parish, between, hamlet = nth(_PARISHES, 1), nth(_BETWEEN, 3), nth(_HAMLETS, 12)
    lead = F.when(between == "大", F.concat(between, parish)).otherwise(F.concat(parish, between))
    admin = F.concat(F.when(F.floor(F.col("p_partkey") / 48) % 2 == 0, parish).otherwise(F.lit("红星")), F.lit("村"))
    out = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), text.clean_prefix(F.concat(lead, hamlet), admin).alias("c"))
    return out.select("id", "c.name", "c.removed", "c.rule")  # confidence follows from the rule


@query(
    f"WITH {_CHARS}, s AS (SELECT city, count(*) AS size_a, count(*) FILTER (contains(name, 'e')) AS ones_a FROM places GROUP BY city), t AS (SELECT count(*) AS n, count(*) FILTER (contains(name, 'e')) AS k FROM places), "
    "u AS (SELECT city, ones_a, size_a, k - ones_a AS ones_b, n - size_a AS size_b FROM s, t), "
    "x AS (SELECT *, ones_a::DOUBLE * (size_b - ones_b) + 0.5 * (ones_a::DOUBLE * ones_b + (size_a - ones_a)::DOUBLE * (size_b - ones_b)) AS uu, (size_a + size_b)::DOUBLE AS n, (ones_a + ones_b)::DOUBLE AS t1, (size_a + size_b - ones_a - ones_b)::DOUBLE AS t0 FROM u), "
    "v AS (SELECT *, size_a::DOUBLE * size_b / 12 * ((n + 1) - ((t1 * t1 * t1 - t1) + (t0 * t0 * t0 - t0)) / (n * (n - 1))) AS vv FROM x), z AS (SELECT *, greatest(abs(uu - size_a::DOUBLE * size_b / 2) - 0.5, 0) / sqrt(vv) AS zz FROM v) "
    f"SELECT city, round(uu, 6) AS u, round(least(1.0, {stats.erfc_sql('(zz / sqrt(2.0))')}), 6) AS p_value FROM z"
)
def mann_whitney(spark, sf_dir):
    """Whether a city's places have a letter more often than all others', from counts alone."""
    p = places(spark, sf_dir).withColumn("has", F.col("name").contains("e"))
    here = p.groupBy("city").agg(F.count(F.lit(1)).alias("size_a"), F.count_if("has").alias("ones_a"))
    whole = p.agg(F.count(F.lit(1)).alias("n"), F.count_if("has").alias("k"))
    both = here.join(F.broadcast(whole))  # a single row
    u, pv = stats.mann_whitney_binary(F.col("ones_a"), F.col("size_a"), F.col("k") - F.col("ones_a"), F.col("n") - F.col("size_a"))
    return rounded(both.select("city", u.alias("u"), pv.alias("p_value")))


_T3 = _joined_sql(CITY) + ", " + _TEND + ", x AS (SELECT city, char, round(z_score, 9) AS z_score FROM z), gr AS (SELECT char, row_number() OVER (ORDER BY village_count DESC, char) AS rank FROM g) "


def _tend(spark, sf_dir):
    out = frequency.tendency(_joined(spark, sf_dir, CITY), CITY)
    return out.select("city", "char", F.round("z_score", 9).alias("z_score"))


@query(_T3 + "SELECT char FROM gr WHERE rank <= 8 UNION SELECT char FROM x WHERE abs(z_score) >= 1.5")
def feature_chars_union(spark, sf_dir):
    """The most frequent characters and those with an extreme z somewhere."""
    top = frequency.global_frequency(places(spark, sf_dir), _items()).filter("rank <= 8").select("char")
    return top.union(_tend(spark, sf_dir).filter(F.abs("z_score") >= 1.5).select("char")).distinct()


@query(_T3 + "SELECT char FROM x WHERE city = 'Brand#1' AND z_score >= 0 INTERSECT SELECT char FROM x WHERE city = 'Brand#2' AND z_score >= 0")
def common_chars_intersect(spark, sf_dir):
    t = _tend(spark, sf_dir).filter("z_score >= 0")
    return t.filter("city = 'Brand#1'").select("char").intersect(t.filter("city = 'Brand#2'").select("char"))


@query(_T3 + "SELECT char FROM x WHERE city = 'Brand#1' AND z_score >= 0 EXCEPT SELECT char FROM x WHERE city = 'Brand#2' AND z_score >= 0")
def distinctive_chars_except(spark, sf_dir):
    t = _tend(spark, sf_dir).filter("z_score >= 0")
    return t.filter("city = 'Brand#1'").select("char").subtract(t.filter("city = 'Brand#2'").select("char"))


@query(
    f"WITH {PLACES_SQL}, a AS (SELECT city, count(*) AS long_names FROM places WHERE length(name) > 14 GROUP BY city), b AS (SELECT city, count(*) AS short_names FROM places WHERE length(name) < 9 GROUP BY city) "
    "SELECT city, coalesce(long_names, 0) AS long_names, coalesce(short_names, 0) AS short_names FROM a FULL JOIN b USING (city)"
)
def feature_tables_full_outer(spark, sf_dir):
    p = places(spark, sf_dir)
    a = p.filter(F.length("name") > 14).groupBy("city").agg(F.count(F.lit(1)).alias("long_names"))
    b = p.filter(F.length("name") < 9).groupBy("city").agg(F.count(F.lit(1)).alias("short_names"))
    return regions.full_outer([a, b], ["city"])


_CATS = [*LETTERS]
_MEMBERS = {c: "".join(k for k, v in label_pairs(LETTERS).items() if v == c) for c in _CATS}


@query(f"WITH {PLACES_SQL} SELECT city, count(DISTINCT name) AS names, round(avg(length(name)), 6) AS avg_length, " + ", ".join(f"round(100.0 * count(*) FILTER (regexp_matches(name, '[{_MEMBERS[c]}]')) / count(*), 6) AS pct_{c}" for c in _CATS) + " FROM places GROUP BY city")
def city_aggregates_pivot(spark, sf_dir):
    tagged = semantic.tags(places(spark, sf_dir), label_pairs(LETTERS))
    return rounded(tagged.groupBy("city").agg(F.countDistinct("name").alias("names"), F.avg(F.length("name")).alias("avg_length"), *[(100.0 * F.sum(f"sem_{c}") / F.count(F.lit(1))).alias(f"pct_{c}") for c in _CATS]))


@query(f"WITH {PLACES_SQL}, s AS (SELECT city, right(name, 1) AS x, count(*)::DOUBLE AS n FROM places GROUP BY ALL), t AS (SELECT city, n / sum(n) OVER (PARTITION BY city) AS p FROM s) SELECT city, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS endings FROM t GROUP BY city")
def suffix_entropy(spark, sf_dir):
    c = places(spark, sf_dir).groupBy("city", text.suffix(F.col("name"), 1).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(c.groupBy("city").agg(F.collect_list("n").alias("ns")).select("city", stats.shannon(F.col("ns")).alias("entropy"), F.size("ns").cast("long").alias("endings")))


@query(
    f"WITH {PLACES_SQL}, n AS (SELECT DISTINCT name FROM places) SELECT a.name AS name_a, b.name AS name_b, levenshtein(a.name, b.name) AS distance, round(1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a JOIN n b ON a.name < b.name AND substr(a.name, 1, 4) = substr(b.name, 1, 4)"
)
def name_similarity(spark, sf_dir):
    """Edit similarity of distinct names with the same first four characters; name_similarity_edits has no such condition."""
    n = places(spark, sf_dir).select("name").distinct().withColumn("k", F.substring("name", 1, 4))
    a, b = n.alias("a"), n.alias("b")
    m = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.name") < F.col("b.name")))
    x, y = F.col("a.name"), F.col("b.name")
    return rounded(m.select(x.alias("name_a"), y.alias("name_b"), F.levenshtein(x, y).cast("long").alias("distance"), text.similarity(x, y).alias("similarity")))


@query(
    f"WITH {PLACES_SQL}, n AS (SELECT DISTINCT name FROM places) SELECT a.name AS name_a, b.name AS name_b, levenshtein(a.name, b.name) AS distance, round(1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 2"
)
def name_similarity_edits(spark, sf_dir):
    """Edit similarity of distinct names within two edits of each other.

    They meet by what is left of them without up to two characters, which loses no such pair.
    """
    n = places(spark, sf_dir).select("name").distinct()
    n = n.withColumn("k", F.explode(F.array_distinct(F.flatten(F.transform(deletions(F.col("name")), deletions)))))
    a, b = n.alias("a"), n.alias("b")
    x, y = F.col("a.name"), F.col("b.name")
    m = a.join(b, (F.col("a.k") == F.col("b.k")) & (x < y) & (text.limited_distance(x, y, 2) <= 2)).select(x.alias("name_a"), y.alias("name_b")).distinct()
    x, y = F.col("name_a"), F.col("name_b")
    return rounded(m.select(x, y, F.levenshtein(x, y).cast("long").alias("distance"), text.similarity(x, y).alias("similarity")))


_SX, _SY = "(lon - 105.0)", "(lat - 35.0)"


def _wave_sql(x: str, *pairs: tuple[float, float]) -> str:
    return "(" + " + ".join(f"{a!r} * sin({x} * {f!r} * 3.141592653589793)" for a, f in pairs) + ") * 2.0 / 3.0"


_DLON = f"(300.0 + {_SX} + 2.0 * {_SY} + 0.1 * {_SX} * {_SX} + 0.1 * {_SX} * {_SY} + 0.1 * sqrt(abs({_SX})) + {_wave_sql(_SX, (20.0, 6.0), (20.0, 2.0))} + {_wave_sql(_SX, (20.0, 1.0), (40.0, 1 / 3))} + {_wave_sql(_SX, (150.0, 1 / 12), (300.0, 1 / 30))})"
_MAGIC = "(1 - 0.00669342162296594323 * sin(radians(lat)) * sin(radians(lat)))"


@query(f"WITH {POINTS_SQL} SELECT id, round(lon + {_DLON} * 180.0 / (6378245.0 / sqrt({_MAGIC}) * cos(radians(lat)) * 3.141592653589793), 6) AS shifted_lon FROM points")
def datum_shift(spark, sf_dir):
    lon, _ = geo.wgs_to_gcj(F.col("lon"), F.col("lat"))
    return rounded(points(spark, sf_dir).select("id", lon.alias("shifted_lon")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created, CASE WHEN length(o_orderpriority) > 8 THEN substr(o_orderpriority, 1, 5) || '...' ELSE o_orderpriority END AS short FROM orders")
def formatted_fields(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), text.time_text(F.col("o_orderdate")).alias("created"), text.truncated(F.col("o_orderpriority"), 8).alias("short"))


@query(
    f"WITH {_CHARS}, f AS (SELECT city, char, count(*) AS village_count FROM chars GROUP BY city, char), r AS (SELECT *, dense_rank() OVER (PARTITION BY city ORDER BY village_count DESC) AS d FROM f) SELECT city, count(*) FILTER (d <= 3) AS leading, max(village_count) AS most, min(village_count) AS least, CAST(sum(village_count) AS BIGINT) AS occurrences FROM r GROUP BY city"
)
def char_rank_summary(spark, sf_dir):
    r = frequency.regional_frequency(places(spark, sf_dir), _items(), CITY)
    return r.groupBy("city").agg(F.count_if(F.col("rank_within_region") <= 3).alias("leading"), F.max("village_count").alias("most"), F.min("village_count").alias("least"), F.sum("village_count").alias("occurrences"))


@query(
    _joined_sql(CITY) + ", x AS (SELECT char, arg_max(city, (round(p / q, 9), city)) AS city, max(p / q) AS lift, count(*) AS regions FROM j GROUP BY char) SELECT char, city, round(lift, 6) AS lift, regions FROM x"
)
def strongest_region_per_char(spark, sf_dir):
    j = _joined(spark, sf_dir, CITY)
    return rounded(j.groupBy("char").agg(F.max_by("city", F.struct(F.round("lift", 9), "city")).alias("city"), F.max("lift").alias("lift"), F.count(F.lit(1)).alias("regions")))


@query("SELECT d.source, count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS good, round(avg(length(d.text)), 6) AS avg_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def source_label_coverage(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "labelled_id")
    j = d.join(lab, d["doc_id"] == lab["labelled_id"], "left")
    return rounded(j.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("labelled_id").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.avg(F.length("text")).alias("avg_chars")))


@query(f"WITH {_GRAMS} SELECT n, count(*) AS distinct_ngrams, CAST(sum(frequency) AS BIGINT) AS occurrences, count(*) FILTER (frequency = 1) AS once FROM gf WHERE position = 'all' GROUP BY n")
def ngram_statistics(spark, sf_dir):
    g = ngrams.ngram_counts(ngrams.ngram_rows(places(spark, sf_dir), (2, 3), [], positions=("all",)), [])
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("distinct_ngrams"), F.sum("frequency").alias("occurrences"), F.count_if(F.col("frequency") == 1).alias("once"))
