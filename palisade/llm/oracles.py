"""The same results in SQL, by plain definitions: sorting, grouping and joining windows.

op1, op2 and op5 rest on trained models or tokenizer files, op7 and op10 on a hash that
DuckDB lacks, op12 on eigenvectors; they are tested against brute force instead.
"""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WORDS4 = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
chars AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE
      WHEN c = '' THEN []::BIGINT[]
      WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
      WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[]
      WHEN unicode(c) < 65536 THEN
        [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]::BIGINT[]
      ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63),
        128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]::BIGINT[] END)) AS b
  FROM documents),
d AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM chars, crc),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    sum(size) OVER () AS total FROM d),
s AS (SELECT *, (((before * 2 + size) * 8) // (total * 2))::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INTEGER AS grown_shard
FROM s
"""

OP4 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS4} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id::VARCHAR AS item_id, {_WORDS4} AS w FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, w[s:s + least(10, len(w)) - 1] AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS MATERIALIZED (
  SELECT rid, l, s, w[s:s + l - 1] AS p
  FROM (SELECT rid, l, w, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw))),
m AS MATERIALIZED (SELECT rid, s, l, item_id FROM dw JOIN iw USING (l, p)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS pos FROM m) GROUP BY rid),
ids AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
  FROM (SELECT DISTINCT rid, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

OP6 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '') || '|'
      || coalesce(md5(source), '') || '|' || (row_number() OVER (PARTITION BY doc_id, text, source) - 1)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, max(level) OVER () * weight) AS target FROM l),
g AS MATERIALIZED (
  SELECT *, target - whole * source_size AS need
  FROM (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t)),
c AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) - size AS before
  FROM (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h)),
x AS (
  SELECT c.source, c.h + ((need - before) * 2 > size)::INTEGER AS threshold
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE before <= need AND need < before + size)
SELECT doc_id, size, source_size, target, (size * (whole + (h < coalesce(threshold, 0))::INTEGER))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

OP8 = rf"""
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LETTERS}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM r),
f AS MATERIALIZED (
  SELECT page_id, host, path,
    CASE WHEN site <> '' THEN site || regexp_replace(path, '/+$', '') || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS form
  FROM (
    SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AS site,
      coalesce(array_to_string(list_filter(string_split(query, '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)=')), '&'), '') AS asked FROM p)),
listed AS (
  SELECT DISTINCT form FROM f WHERE form IS NOT NULL
    AND regexp_matches(host, '(^|[.])(casino-win|cheap-pills|free-bets|spam-farm|adult-x|ads-track)[.]')),
rules(verdict, h, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT page_id, max_by(h || start, len(h || start)) AS rule, max_by(rules.verdict, len(h || start)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id)
SELECT f.page_id, f.host, f.path, rule,
  coalesce(verdict, CASE WHEN listed.form IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN fit USING (page_id) LEFT JOIN listed ON f.form = listed.form
"""

OP9 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
win AS MATERIALIZED (
  SELECT rid, doc_id, s, w[s:s + 12] AS p FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
first AS (SELECT p, min(doc_id) AS least FROM win GROUP BY p),
gone AS MATERIALIZED (
  SELECT DISTINCT rid, pos
  FROM (SELECT rid, unnest(range(s, s + 13)) AS pos FROM win JOIN first USING (p) WHERE least < doc_id)),
n AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY pos) AS joined
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) x
  ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

_LOWER = f"translate(coalesce(text, ''), {_LETTERS})"

OP11 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT rid, doc_id, list_sort(list_distinct(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS own FROM d),
sets AS MATERIALIZED (
  SELECT own, row_number() OVER () AS sid, len(own) AS n, min(doc_id) AS least FROM s WHERE len(own) > 0 GROUP BY own),
tokens AS MATERIALIZED (SELECT sid, n, unnest(own) AS token FROM sets),
links AS MATERIALIZED (
  SELECT a.sid AS x, b.sid AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.sid <> b.sid
  GROUP BY a.sid, b.sid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT sid AS x, sid AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
class AS (SELECT x AS sid, min(least) AS component_id FROM reach JOIN sets ON reach.y = sets.sid GROUP BY x)
SELECT s.doc_id, len(s.own)::BIGINT AS n_shingles, CASE WHEN len(s.own) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN sets USING (own) LEFT JOIN class USING (sid)
"""

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 10),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, f AS a, cut, string_split(phrase, ' ') AS p
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, h.f AS l, t.f AS r, (1000000 * c.a * c.a) // (h.f * t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(p[:cut], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(p[cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a AS longer
  FROM cuts WHERE k = 3),
alone AS (
  SELECT lowest.* FROM lowest LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM longer GROUP BY ALL) x USING (lang, phrase)
  WHERE longer IS NULL OR k = 3 OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
JOIN size USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op3_sharding": OP3,
    "op4_decontamination": OP4,
    "op6_mixing": OP6,
    "op8_url_filter": OP8,
    "op9_substring_dedup": OP9,
    "op11_jaccard_join": OP11,
    "op13_collocations": OP13,
}
