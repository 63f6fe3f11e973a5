"""DuckDB text of the queries, where SQL can express them.

Each states a contract by itself, over whole tables: windows are compared as strings, not by the operators' hashes.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alnum(text: str) -> str:
    return rf"coalesce(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def _solid(text: str) -> str:
    return rf"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"


TOPK = """
WITH r AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM r q JOIN r c ON q.rn <> c.rn WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_alnum("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_alnum("text")} AS w FROM benchmark),
places AS (SELECT id, w, least(10, len(w)) AS l, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT id, l, array_to_string(w[s : s + l - 1], ' ') AS k FROM places),
dw AS (
  SELECT rn, l, s, array_to_string(w[s : s + l - 1], ' ') AS k
  FROM (SELECT rn, w, l, unnest(generate_series(1, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), h AS (SELECT rn, id, l, s FROM dw JOIN bw USING (l, k)),
hit AS (
  SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(generate_series(s, s + l - 1)) AS p FROM (SELECT DISTINCT rn, s, l FROM h)) GROUP BY rn
), item AS (SELECT rn, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rn, id FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN item USING (rn)
"""

#: a string of 2n bytes is named by the names of its halves; two of 128 that overlap name one of 200
SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rn, doc_id, regexp_extract_all(h, '..') AS x, len(h) // 2 AS n FROM d),
h1 AS (SELECT rn, n, unnest(generate_series(1, n)) AS s, unnest(x) AS k FROM b WHERE n >= 200),
{doubled}
w AS (SELECT rn, s, k FROM (SELECT rn, n, s, hash(k, lead(k, 72) OVER (PARTITION BY rn ORDER BY s)) AS k FROM h128) WHERE s <= n - 199),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
steps AS (SELECT rn, s, s - lag(s, 1, -999) OVER (PARTITION BY rn ORDER BY s) AS gap FROM w JOIN twice USING (k)),
runs AS (SELECT rn, s, sum(CASE WHEN gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY s) AS run FROM steps),
spans AS (SELECT rn, min(s) AS a, max(s) + 199 AS e FROM runs GROUP BY rn, run),
cuts AS (SELECT rn, sum(e - a + 1) AS removed, count(*) AS spans, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM spans GROUP BY rn),
kept AS (
  SELECT rn, string_agg(array_to_string(x[CASE WHEN i = 0 THEN 1 ELSE c.e[i] + 1 END : CASE WHEN i = len(c.a) THEN n ELSE c.a[i + 1] - 1 END], ''), '' ORDER BY i) AS h
  FROM (SELECT cuts.*, x, n, unnest(generate_series(0, len(cuts.a))) AS i FROM cuts JOIN b USING (rn)) c GROUP BY rn
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d JOIN b USING (rn, doc_id) LEFT JOIN cuts USING (rn) LEFT JOIN kept USING (rn)
""".replace(
    "{doubled}",
    "\n".join(f"h{2 * n} AS (SELECT rn, n, s, hash(k, lead(k, {n}) OVER (PARTITION BY rn ORDER BY s)) AS k FROM h{n})," for n in (1, 2, 4, 8, 16, 32, 64)),
)

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_solid("text")} AS w FROM documents),
p AS (SELECT rn, doc_id, s, array_to_string(w[s : s + 49], ' ') AS k FROM (SELECT rn, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
late AS (SELECT rn, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM p) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
gone AS (SELECT DISTINCT rn, unnest(generate_series(s, s + 49)) AS p FROM late),
cut AS (SELECT rn, count(*) AS n, list(p) AS ps FROM gone GROUP BY rn),
kept AS (
  SELECT rn, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT rn, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d) v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rn = v.rn AND g.p = v.i)
  GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (rn) LEFT JOIN kept USING (rn)
"""

#: what the fixed phrases alone say; the method adds labels of its own
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_alnum("text")} AS w FROM documents),
phrase(words, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
p AS (
  SELECT rn, s, label FROM (SELECT rn, w, unnest(generate_series(1, len(w))) AS s FROM d WHERE len(w) > 0), phrase WHERE w[s : s + len(words) - 1] = words
), f AS (SELECT rn, count(*) AS n, min(s) - 1 AS a, max(s) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN f USING (rn)
"""

#: CRC-32 byte by byte, its table from the polynomial
SHARDING = """
WITH RECURSIVE step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS body FROM documents),
b AS (SELECT rn, doc_id, md5(body) AS m, strlen(body) + 8 AS size, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST(('0x' || x) AS BIGINT)) AS x FROM d),
c AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, x), lambda a, y: xor(a // 256, crc.t[CAST(xor(a % 256, y) + 1 AS BIGINT)])), 4294967295) AS crc FROM b, crc),
o AS (
  SELECT *, CAST(('0x' || m[1:15]) AS BIGINT) AS h FROM c
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, rn) - size AS before, sum(size) OVER () AS total FROM o
), dealt AS (SELECT *, CAST(least(23, (2 * before + size) * 24 // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, rn) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""

#: sizes and targets; which documents the mix takes is the method's own
MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_solid("text")}) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place,
    3.0::DOUBLE * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *, cap / weight AS rise, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER after AS level
  FROM s
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= rise THEN level END) OVER () * weight, cap)) AS target FROM l)
SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

_KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
_LEAST = {"assign": 12, "access": 18, "hex": 16}


def _found(at: int, kind: str) -> str:
    """Matches of a kind with their places: what stands between them comes from a split by the same pattern."""
    pattern, group = _KINDS[kind], 1 if kind == "assign" else 0
    return f"""
  SELECT rn, {at} AS kind_at, '{kind}' AS kind, n_before AS a, n_before + length(m) AS e FROM (
    SELECT rn, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY rn ORDER BY i) - length(m) AS n_before
    FROM (
      SELECT rn, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1 : len(ms)]) AS gap
      FROM (SELECT rn, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, string_split_regex(t, '{pattern}') AS gaps FROM d)
      WHERE len(ms) > 0
    )
  ) WHERE length(g) >= {_LEAST[kind]}"""


#: what the fixed patterns alone say; the method adds spans
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(i, k) for i, k in enumerate(_KINDS))}),
s AS (
  SELECT rn, count_if(kind_at = 0) AS na, count_if(kind_at = 1) AS nc, count_if(kind_at = 2) AS nh, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, kind_at) AS spans
  FROM (SELECT rn, kind_at, kind, CAST(a AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM f) GROUP BY rn
)
SELECT doc_id, CAST(coalesce(na, 0) AS BIGINT) AS n_assign, CAST(coalesce(nc, 0) AS BIGINT) AS n_access, CAST(coalesce(nh, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN s USING (rn)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, {_solid(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
g AS (
  SELECT DISTINCT rn, array_to_string(w[s : s + 4], ' ') AS k
  FROM (SELECT rn, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT rn, count(*) AS n FROM g GROUP BY rn),
one AS (SELECT rn, min(rn) OVER (PARTITION BY ks) AS class, n FROM (SELECT rn, md5(string_agg(k, chr(10) ORDER BY k)) AS ks, count(*) AS n FROM g GROUP BY rn)),
c AS (SELECT g.rn AS class, k, n FROM g JOIN one ON g.rn = one.rn AND one.class = g.rn),
both_of AS (SELECT x.class AS a, y.class AS b, x.n AS na, y.n AS nb, count(*) AS common FROM c x JOIN c y ON x.k = y.k AND x.class <> y.class GROUP BY ALL),
link AS (SELECT a, b FROM both_of WHERE 100 * common >= 80 * (na + nb - common)),
reach(a, b) AS (SELECT class, class FROM one UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a AS class, min(doc_id) AS least FROM reach JOIN one ON reach.b = one.class JOIN d ON one.rn = d.rn GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE component.least END AS component_id
FROM d LEFT JOIN n USING (rn) LEFT JOIN one USING (rn) LEFT JOIN component ON one.class = component.class
"""

#: features by their text; CRC-32 byte by byte for each different one
RESAMPLING = f"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS rn, doc_id, {_alnum("text")} AS w, TRUE AS own FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, {_alnum("text")}, FALSE FROM benchmark
), runs AS (
  SELECT rn, own, array_to_string(w[i : i + k - 1], ' ') AS f
  FROM (SELECT rn, own, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM texts, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)
), posted AS (SELECT rn, own, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST(('0x' || x) AS BIGINT)) AS x FROM (SELECT DISTINCT f FROM posted)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda a, y: xor(a // 256, crc.t[CAST(xor(a % 256, y) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM bytes, crc
), counted AS (SELECT rn, own, bucket, n FROM posted JOIN hashed USING (f)),
sums AS (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM counted GROUP BY bucket),
every AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS a, CAST(coalesce(sum(t), 0) AS DOUBLE) AS b FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (a + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (b + 10000)))) AS BIGINT) AS gain FROM sums, every
), weighed AS (SELECT rn, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE own GROUP BY rn),
scored AS (
  SELECT rn, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST(('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) AS h
  FROM texts LEFT JOIN weighed USING (rn) WHERE own
), final AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, rn) AS place, count(*) OVER (PARTITION BY able) AS able_rows FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * able_rows // 100 THEN place END AS rank FROM ranked
"""

SQL = {
    "op1_topk_search": TOPK,
    "op3_decontamination": DECONTAMINATION,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op7_sharding": SHARDING,
    "op13_resampling": RESAMPLING,
    "base_licenses": LICENSES,
    "base_mixing": MIXING,
    "base_secrets": SECRETS,
    "base_ngram_join": NGRAM_JOIN,
}
