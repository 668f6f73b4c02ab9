"""Queries on lexicon-driven tags, indices, sequences and co-occurrence over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators import api, frequency, regions, semantic
from gazetta.sources.lexicon import LETTERS, flattened, label_pairs, lexicon, sql_values
from gazetta.sources.schema import places

from .frequency import _CHARS, _GLOBAL, _REG, CITY, _items
from .registry import query, rounded

_LABELS = label_pairs(LETTERS)
_CATS = [*LETTERS]
_LEX = sql_values(LETTERS)
_MEMBERS = {c: "".join(x for _, x, p, _ in flattened(LETTERS) if p == c) for c in LETTERS}
_GROUPS = {c: [*m] for c, m in _MEMBERS.items()}
_KNOWN = [c for c in _LABELS if c not in "qxzjkw"]


def _any_sql(column: str, category: str) -> str:
    return f"CAST(regexp_matches({column}, '[{_MEMBERS[category]}]') AS INTEGER)"



_SEQ = (
    f"{_CHARS}, {_LEX}, allc AS (SELECT id, city, i, substr(name, i, 1) AS char FROM places, range(1, 60) t(i) WHERE i <= length(name)), "
    "lab AS (SELECT id, city, i, coalesce(category, 'other') AS label FROM allc LEFT JOIN (SELECT char, arg_min(category, ord) AS category FROM lexicon GROUP BY char) USING (char)), "
    "seq AS (SELECT id, city, list(label ORDER BY i) AS labels FROM lab GROUP BY id, city)"
)


def _sequences(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.withColumn("sequence", semantic.sequence(F.col("name"), _LABELS))


@query(f"WITH {_CHARS} SELECT id, " + ", ".join(f"{_any_sql('name', c)} AS sem_{c}" for c in _CATS) + " FROM places")
def semantic_tags(spark, sf_dir):
    return semantic.tags(places(spark, sf_dir), _LABELS).select("id", *[f"sem_{c}" for c in _CATS])


@query("WITH t AS (SELECT " + ", ".join(f"sum({_any_sql('p_name', c)}) AS sem_{c}" for c in _CATS) + " FROM part) SELECT tag, CAST(villages AS BIGINT) AS villages FROM (UNPIVOT t ON " + ", ".join(f"sem_{c}" for c in _CATS) + " INTO NAME tag VALUE villages)")
def semantic_tag_statistics(spark, sf_dir):
    return api.long_tags(semantic.tags(places(spark, sf_dir), _LABELS), [f"sem_{c}" for c in _CATS])


_VTF = (
    f"WITH {_CHARS}, {_LEX}, {_GLOBAL}, {_REG.format(k='city')}, cats AS (SELECT DISTINCT category FROM lexicon), mem AS (SELECT DISTINCT category, char FROM lexicon), "
    "gv AS (SELECT category, CAST(coalesce(sum(village_count), 0) AS BIGINT) AS gc FROM cats LEFT JOIN mem USING (category) LEFT JOIN g USING (char) GROUP BY category), gt AS (SELECT total_villages AS gt FROM tot), "
    "rv AS (SELECT rt.city, cats.category, any_value(rt.total_villages) AS t, CAST(coalesce(sum(r.village_count), 0) AS BIGINT) AS n FROM rt CROSS JOIN cats LEFT JOIN mem ON mem.category = cats.category LEFT JOIN r ON r.city = rt.city AND r.char = mem.char GROUP BY rt.city, cats.category) "
)


@query(_VTF + "SELECT category, gc AS vtf_count, gt AS total_villages, round(gc::DOUBLE / gt, 6) AS frequency FROM gv, gt")
def vtf_global(spark, sf_dir):
    g = frequency.global_frequency(places(spark, sf_dir), _items())
    return rounded(semantic.term_frequency(g, lexicon(spark, LETTERS), []))


@query(_VTF + "SELECT city, category, n AS vtf_count, t AS total_villages, round(n::DOUBLE / t, 6) AS frequency FROM rv")
def vtf_region(spark, sf_dir):
    r = frequency.regional_frequency(places(spark, sf_dir), _items(), CITY)
    return rounded(semantic.term_frequency(r, lexicon(spark, LETTERS), CITY))


_LOGIT = "ln(least(greatest({x}, 1e-10), 1 - 1e-10) / (1 - least(greatest({x}, 1e-10), 1 - 1e-10)))"


@query(
    _VTF
    + ", j AS (SELECT city, rv.category, n, t, gc, gt, n::DOUBLE / t AS p, gc::DOUBLE / gt AS q FROM rv JOIN gv USING (category), gt) "
    + "SELECT city, category, n AS vtf_count, round(p / q, 6) AS lift, round(CASE WHEN p > 0 THEN ln(p / q) ELSE 0 END, 6) AS log_lift, round("
    + _LOGIT.format(x="p") + " - " + _LOGIT.format(x="q")
    + ", 6) AS log_odds, round((p - q) / sqrt(q / t), 6) AS z_score, n >= 10 AS support_flag FROM j"
)
def vtf_tendency(spark, sf_dir):
    lex, p = lexicon(spark, LETTERS), places(spark, sf_dir)
    g = semantic.term_frequency(frequency.global_frequency(p, _items()), lex, [])
    r = semantic.term_frequency(frequency.regional_frequency(p, _items(), CITY), lex, CITY)
    return rounded(semantic.term_tendency(r, g).select("city", "category", "vtf_count", "lift", "log_lift", "log_odds", "z_score", "support_flag"))


@query(
    f"WITH {_CHARS}, {_LEX}, sc AS (SELECT id, city, category, count(*) AS score FROM chars JOIN lexicon USING (char) GROUP BY id, city, category), "
    "gl AS (SELECT category, sum(score)::DOUBLE / (SELECT count(*) FROM places) AS gi FROM sc GROUP BY category), rc AS (SELECT city, count(*) AS n FROM places GROUP BY city), cats AS (SELECT DISTINCT category FROM lexicon), "
    "j AS (SELECT rc.city, cats.category, n, gi, coalesce((SELECT sum(score) FROM sc WHERE sc.city = rc.city AND sc.category = cats.category), 0)::BIGINT AS s FROM rc CROSS JOIN cats JOIN gl ON gl.category = cats.category) "
    "SELECT city, category, s AS score_sum, n AS village_count, round(s::DOUBLE / n, 6) AS raw_intensity, round(s::DOUBLE / n / gi, 6) AS normalized_index, round((s - n * gi) / sqrt(n * gi), 6) AS z_score, dense_rank() OVER (PARTITION BY category ORDER BY round(s::DOUBLE / n / gi, 9) DESC) AS rank_within_province FROM j"
)
def semantic_indices(spark, sf_dir):
    scored = semantic.scores(places(spark, sf_dir), _GROUPS)
    out = semantic.indices(scored, CITY, _CATS)
    return rounded(out.select("city", "category", "score_sum", "village_count", "raw_intensity", "normalized_index", "z_score", "rank_within_province"))


_BI = f"WITH {_SEQ}, bi AS (SELECT a.label AS label_1, b.label AS label_2, count(*) AS frequency FROM lab a JOIN lab b ON a.id = b.id AND b.i = a.i + 1 GROUP BY ALL) "


@query(
    _BI + ", m AS (SELECT label, sum(f) AS mass FROM (SELECT label_1 AS label, frequency AS f FROM bi UNION ALL SELECT label_2, frequency FROM bi) GROUP BY label), t AS (SELECT sum(frequency)::DOUBLE AS t FROM bi) "
    "SELECT bi.label_1, bi.label_2, frequency, round(ln((frequency / t) / ((m1.mass / (2 * t)) * (m2.mass / (2 * t)))), 6) AS pmi, ln((frequency / t) / ((m1.mass / (2 * t)) * (m2.mass / (2 * t)))) > 0 AS is_positive FROM bi JOIN m m1 ON m1.label = bi.label_1 JOIN m m2 ON m2.label = bi.label_2, t"
)
def category_bigrams_pmi(spark, sf_dir):
    return rounded(semantic.bigram_pmi(semantic.label_ngrams(_sequences(spark, sf_dir), 2)))


@query(f"WITH {_SEQ}, tri AS (SELECT a.label AS label_1, b.label AS label_2, c.label AS label_3, count(*) AS frequency FROM lab a JOIN lab b ON a.id = b.id AND b.i = a.i + 1 JOIN lab c ON c.id = a.id AND c.i = a.i + 2 GROUP BY ALL) SELECT *, round(100 * frequency::DOUBLE / sum(frequency) OVER (), 6) AS percentage FROM tri")
def category_trigrams(spark, sf_dir):
    return rounded(semantic.label_ngrams(_sequences(spark, sf_dir), 3))


_RULES = [("stop_vowel", {"stop"}, {"vowel"}), ("vowel_liquid", {"vowel"}, {"liquid"}), ("nasal_any", {"nasal"}, {"vowel", "stop"}), ("vowel_any", {"vowel"}, {"nasal", "stop", "fricative"})]
_RULE_SQL = (
    "CASE WHEN label_1 = 'stop' AND label_2 = 'vowel' THEN 'stop_vowel' WHEN label_1 = 'vowel' AND label_2 = 'liquid' THEN 'vowel_liquid' "
    "WHEN label_1 = 'nasal' AND label_2 IN ('vowel', 'stop') THEN 'nasal_any' WHEN label_1 = 'vowel' AND label_2 IN ('nasal', 'stop', 'fricative') THEN 'vowel_any' END"
)


@query(_BI + f", p AS (SELECT *, {_RULE_SQL} AS pattern FROM bi WHERE label_1 <> 'other' AND label_2 <> 'other') SELECT label_1, label_2, frequency, pattern, round(100 * frequency::DOUBLE / sum(frequency) OVER (), 6) AS pattern_share FROM p WHERE pattern IS NOT NULL")
def composition_patterns(spark, sf_dir):
    out = semantic.pattern_rules(semantic.label_ngrams(_sequences(spark, sf_dir), 2), _RULES)
    return rounded(out.select("label_1", "label_2", "frequency", "pattern", "pattern_share"))


@query(f"WITH {_SEQ} SELECT array_to_string(labels, '-') AS sequence, count(*) AS frequency FROM seq WHERE list_contains(labels, 'nasal') AND list_contains(labels, 'liquid') GROUP BY 1 HAVING count(*) < 100")
def conflicts(spark, sf_dir):
    return semantic.conflicts(_sequences(spark, sf_dir), [("nasal", "liquid")], 100)


@query(
    f"WITH {_SEQ}, c AS (SELECT id, labels, len(list_filter([x for x in labels if x <> 'other'], lambda x: true))::DOUBLE / len(labels) AS coverage FROM seq) "
    "SELECT id, array_to_string(labels, '-') AS sequence, round(coverage, 6) AS coverage, list_contains(labels, 'stop') AS has_onset, (list_contains(labels, 'nasal') OR list_contains(labels, 'liquid')) AS has_coda FROM c WHERE coverage >= 0.5"
)
def village_structure(spark, sf_dir):
    out = semantic.structures(places(spark, sf_dir), _LABELS, roles={"onset": {"stop"}, "coda": {"nasal", "liquid"}})
    return rounded(out.select("id", F.array_join("sequence", "-").alias("sequence"), "coverage", "has_onset", "has_coda"))


_CO = (
    f"WITH {_CHARS}, {_LEX}, pc AS (SELECT DISTINCT id, category FROM chars JOIN lexicon USING (char)), co AS (SELECT a.category AS first, b.category AS second, count(*) AS n_both FROM pc a JOIN pc b ON a.id = b.id AND a.category <= b.category GROUP BY ALL), "
    "s AS (SELECT first AS category, n_both AS n FROM co WHERE first = second), cj AS (SELECT first, second, n_both, s1.n AS n1, s2.n AS n2, (SELECT count(*) FROM places) AS t FROM co JOIN s s1 ON s1.category = first JOIN s s2 ON s2.category = second) "
)


def _pairs(spark, sf_dir):
    return semantic.cooccurrence(places(spark, sf_dir), _LABELS)


@query(_CO + "SELECT first, second, n_both, n1 AS n_first, n2 AS n_second, round(log2((n_both::DOUBLE / t) / ((n1::DOUBLE / t) * (n2::DOUBLE / t))), 6) AS pmi FROM cj")
def cooccurrence_log2pmi(spark, sf_dir):
    return rounded(semantic.cooccurrence_measures(_pairs(spark, sf_dir)).select("first", "second", "n_both", "n_first", "n_second", "pmi"))


@query(_CO + "SELECT first, second, round(n_both::DOUBLE / t, 6) AS support, round(n_both::DOUBLE / n1, 6) AS p_second_given_first, round(n_both::DOUBLE / n2, 6) AS p_first_given_second, round(n_both::DOUBLE * t / (n1::DOUBLE * n2), 6) AS lift FROM cj WHERE first <> second ORDER BY n_both DESC, first, second LIMIT 20")
def cooccurrence_rules(spark, sf_dir):
    out = semantic.cooccurrence_measures(_pairs(spark, sf_dir)).filter("first <> second")
    best = api.top(out, [F.desc("n_both"), F.asc("first"), F.asc("second")], 20)
    return rounded(best.select("first", "second", "support", "p_second_given_first", "p_first_given_second", "lift"))


@query(_CO + ", u AS (SELECT first AS category, n_both FROM cj WHERE first <> second UNION ALL SELECT second, n_both FROM cj WHERE first <> second), w AS (SELECT category, n_both::DOUBLE / sum(n_both) OVER (PARTITION BY category) AS s FROM u) SELECT category, round(-sum(s * log2(s + 1e-10)), 6) AS entropy, count(*) AS partners FROM w GROUP BY category")
def category_entropy(spark, sf_dir):
    return rounded(semantic.category_entropy(_pairs(spark, sf_dir)))


_KNOWN_SQL = "".join(_KNOWN)


@query(
    f"WITH {_CHARS}, c AS (SELECT city, length(name) AS n, length(regexp_replace(name, '[^{_KNOWN_SQL}]', '', 'g')) AS k FROM places) "
    "SELECT city, count(*) AS villages, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(k) AS BIGINT) AS labelled, count(*) FILTER (k = n AND n > 0) AS fully, count(*) FILTER (k > 0 AND k < n) AS partly FROM c GROUP BY city"
)
def lexicon_coverage(spark, sf_dir):
    return semantic.coverage(places(spark, sf_dir), _KNOWN, CITY)


@query(
    f"WITH {_CHARS}, m AS (SELECT id, char, count(*) OVER (PARTITION BY id) AS missing FROM chars WHERE NOT regexp_matches(char, '[{_KNOWN_SQL}]')), a AS (SELECT char, count(*) AS frequency, count(*) FILTER (missing = 1) AS unlocked FROM m GROUP BY char) "
    "SELECT char, frequency, unlocked, 10 * unlocked + frequency AS roi, CAST(sum(unlocked) OVER (ORDER BY 10 * unlocked + frequency DESC, char ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_unlocked FROM a"
)
def marginal_gain(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("name", F.replace("name", F.lit(" "), F.lit("")))
    return semantic.marginal_gain(p, _KNOWN)


@query(
    f"WITH {_CHARS}, {_LEX}, {_GLOBAL}, {_REG.format(k='city')}, mem AS (SELECT DISTINCT char, category, subcategory FROM lexicon), "
    "gs AS (SELECT category, subcategory, sum(village_count)::DOUBLE / (SELECT total_villages FROM tot) AS global_share FROM g JOIN mem USING (char) GROUP BY ALL) "
    "SELECT r.city, category, subcategory, count(DISTINCT r.char) AS chars, CAST(sum(r.village_count) AS BIGINT) AS vtf_count, round(sum(r.village_count)::DOUBLE / any_value(rt.total_villages), 6) AS share, round(any_value(global_share), 6) AS global_share, round(sum(r.village_count)::DOUBLE / any_value(rt.total_villages) - any_value(global_share), 6) AS tendency "
    "FROM r JOIN rt USING (city) JOIN mem USING (char) JOIN gs USING (category, subcategory) GROUP BY r.city, category, subcategory"
)
def subcategory_vtf(spark, sf_dir):
    p = places(spark, sf_dir)
    r, g = frequency.regional_frequency(p, _items(), CITY), frequency.global_frequency(p, _items())
    out = semantic.subcategory_tendency(r, g, lexicon(spark, LETTERS), CITY)
    return rounded(out.select("city", "category", "subcategory", "chars", "vtf_count", "share", "global_share", "tendency"))


_FLAGS = "f AS (SELECT (p_size <= 25) AS g, " + ", ".join(f"{_any_sql('p_name', c)} AS sem_{c}" for c in _CATS) + " FROM part), u AS (UNPIVOT f ON " + ", ".join(f"sem_{c}" for c in _CATS) + " INTO NAME feature VALUE v)"


@query(
    f"WITH {_FLAGS}, c AS (SELECT feature, count(*) FILTER (g) AS n_a, count(*) FILTER (NOT g) AS n_b, CAST(sum(v) FILTER (g) AS BIGINT) AS k_a, CAST(sum(v) FILTER (NOT g) AS BIGINT) AS k_b FROM u GROUP BY feature), "
    "k AS (SELECT *, k_a::DOUBLE AS a, (n_a - k_a)::DOUBLE AS b, k_b::DOUBLE AS c, (n_b - k_b)::DOUBLE AS d FROM c) "
    "SELECT feature, n_a, n_b, k_a, k_b, round(k_a::DOUBLE / n_a, 6) AS share_a, round(k_b::DOUBLE / n_b, 6) AS share_b, round(k_a::DOUBLE / n_a - k_b::DOUBLE / n_b, 6) AS difference, "
    "round(CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <= 0 THEN 0.0 ELSE pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0.0), 2) * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d)) END, 6) AS chi2 FROM k"
)
def subset_compare(spark, sf_dir):
    tagged = semantic.tags(places(spark, sf_dir), _LABELS)
    out = regions.compare_groups(tagged, F.col("township").cast("int") <= 25, [f"sem_{c}" for c in _CATS])
    return rounded(out.select("feature", "n_a", "n_b", "k_a", "k_b", "share_a", "share_b", "difference", "chi2"))


_AUDIT = {"metal": ["steel", "brass", "tin", "copper", "nickel"], "size": ["large", "small", "medium"], "colour": ["red", "green", "blue", "gold"]}


_WEAK, _MEDIUM = ("tin", "red"), ("large", "small", "medium")


def _audit_sql() -> str:
    hits = ", ".join(f"CASE WHEN {' OR '.join(f"contains(name, '{w}')" for w in ws)} THEN '{r}' END" for r, ws in _AUDIT.items())
    words = [w for ws in _AUDIT.values() for w in ws]
    strength = {w: f"CASE WHEN name <> '{w}' THEN 1 ELSE 3 END" if w in _WEAK else "2" if w in _MEDIUM else "3" for w in words}
    worst = ", ".join(f"CASE WHEN contains(name, '{w}') THEN {strength[w]} ELSE 0 END" for w in words)
    return f"WITH {_CHARS} SELECT id, concat_ws(',', {hits}) AS rules, CASE greatest({worst}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'weak' ELSE 'none' END AS risk FROM places"


@query(_audit_sql())
def name_audit_rules(spark, sf_dir):
    from gazetta.operators.dedup import name_audit

    return name_audit(places(spark, sf_dir), _AUDIT, weak=_WEAK, medium=_MEDIUM).select("id", F.array_join("rules", ",").alias("rules"), "risk")


@query(
    "WITH d AS (SELECT doc_id, regexp_replace(trim(substr(text, 1, 200)), '[（(].*?[）)]', '', 'g') AS bare, trim(substr(text, 1, 200)) AS t FROM documents) "
    "SELECT doc_id, regexp_replace(bare, '[^a-z]', '', 'g') AS clean_name, t <> bare AS had_brackets, regexp_replace(bare, '[^a-z]', '', 'g') <> bare AS had_noise, length(regexp_replace(bare, '[^a-z]', '', 'g')) >= 60 AS is_valid FROM d"
)
def name_clean(spark, sf_dir):
    """Cleaning of a document's first 200 characters as a name, no more, as its SQL says; name_clean_whole reads all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs.select("doc_id", text.cleaned(F.substring("text", 1, 200), "a-z", least=60).alias("c"))
    return out.select("doc_id", "c.clean_name", "c.had_brackets", "c.had_noise", "c.is_valid")


@query(
    "WITH d AS (SELECT doc_id, regexp_replace(trim(text), '[（(].*?[）)]', '', 'g') AS bare, trim(text) AS t FROM documents) "
    "SELECT doc_id, regexp_replace(bare, '[^a-z]', '', 'g') AS clean_name, t <> bare AS had_brackets, regexp_replace(bare, '[^a-z]', '', 'g') <> bare AS had_noise, length(regexp_replace(bare, '[^a-z]', '', 'g')) >= 60 AS is_valid FROM d"
)
def name_clean_whole(spark, sf_dir):
    """Cleaning of a document's whole text as a name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs.select("doc_id", text.cleaned(F.col("text"), "a-z", least=60).alias("c"))
    return out.select("doc_id", "c.clean_name", "c.had_brackets", "c.had_noise", "c.is_valid")


@query("SELECT c_custkey, CASE WHEN regexp_matches(n, '^.+?[一二三四五六七八九十]+村?$') THEN regexp_extract(n, '^(.+?)[一二三四五六七八九十]+村?$', 1) ELSE n END AS base, regexp_matches(n, '^.+?[一二三四五六七八九十]+村?$') AS is_numbered FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '东村一村' WHEN 1 THEN '南岭二' WHEN 2 THEN '石一桥' ELSE '岭村' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '三' END AS n FROM customer)")
def numbered_normalize(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 4 == 0, "东村一村").when(k % 4 == 1, "南岭二").when(k % 4 == 2, "石一桥").otherwise("岭村"), F.when(k % 3 == 0, "").otherwise("三"))
    out = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.numbered(name).alias("n"))
    return out.select("c_custkey", "n.base", "n.is_numbered")
