"""DuckDB statements for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality import RULES as QUALITY_RULES
from .secrets import BASE_RULES, RULES

_BLANK = r"[\x20\x09-\x0D]"
_TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEX = "('0x' || substr({h}, {i}, 5))::BIGINT"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(h: str) -> str:
    """A hexadecimal digest of 160 bits in base 32, five digits (four letters) at a time."""
    out = []
    for i in range(1, 41, 5):
        n = _HEX.format(h=h, i=i)
        out += [f"substr('{_BASE32}', (({n} >> {s}) & 31)::INTEGER + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out)


OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS s, sha256(t) AS k FROM p),
o AS (SELECT k, max(page_id) AS owner FROM h GROUP BY k)
SELECT page_id, payload_bytes, {_base32("s")} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM h JOIN o USING (k)
"""

OP5 = rf"""
WITH {_TEXTS}, h AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '{_BLANK}', '', 'g')) AS text_sha256 FROM d),
k AS (SELECT text_sha256, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN k USING (text_sha256)
"""


def _op6() -> str:
    kinds = []
    for k, r in enumerate(RULES):
        p = _quoted(r.pattern)
        kinds.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, string_split_regex(t, {p}) AS s FROM d")
    base = len(BASE_RULES)
    joined = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k)"
    return f"""
    WITH {_TEXTS}, e AS ({" UNION ALL ".join(kinds)}), x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM e WHERE len(m) > 0),
    y AS (SELECT doc_id, k, kind, least, length(g[i]) AS size, length(m[i]) AS l, (list_sum([length(s[j]) for j in range(1, i + 1)]) + coalesce(list_sum([length(m[j]) for j in range(1, i)]), 0))::BIGINT AS a FROM x),
    f AS (SELECT doc_id, k, kind, a, a + l AS z FROM y WHERE size >= least),
    c AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {joined} FILTER (k < {base}) AS base, {joined} AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)
    """


def _op9() -> str:
    rejects = " OR ".join(f"({p})" for _, p in QUALITY_RULES.values())
    return rf"""
    WITH {_TEXTS}, w AS (SELECT doc_id, t, [x for x in string_split_regex(t, '{_BLANK}+') if x <> ''] AS words, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
    g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN c USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT ({rejects}) AS kept FROM m
    """


def _crc_table() -> list[int]:
    """The bytes' remainders by the reflected polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def _op7(shards: int = 16, seed: int = 42) -> str:
    bytes_ = "[('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(t)), '..')]"
    crc = f"xor(list_reduce({bytes_}, lambda acc, b: xor(acc >> 8, ({_crc_table()})[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295)"
    fraction = "('0x' || substr({h}, 1, 8))::BIGINT::DOUBLE / 4294967296.0"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0) || 'null') AS source, md5('{seed}|' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d),
    f AS (SELECT doc_id, t, source, digest, (k + {fraction.format(h=f"md5('{seed}|source|' || source)")}) / n AS x FROM r),
    p AS (SELECT doc_id, t, row_number() OVER (ORDER BY x, source, digest, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f)
    SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, {crc} AS text_crc32, 'rows' AS law, ((pos * {shards}) // n)::INTEGER AS shard, (pos - (((pos * {shards}) // n) * n + {shards - 1}) // {shards})::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
    """


ORACLES = {
    "op4_warc_bundles": OP4,
    "op5_content_sort_dedup": OP5,
    "op6_secret_ledger": _op6(),
    "op7_stratified_shards": _op7(),
    "op9_quality_cascade": _op9(),
}
